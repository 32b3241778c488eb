"""The pipeline's stages, each against a plain version on its own input."""

import brute
import corpus_pipeline as P
import pytest

from ledgerlens.llm import decontamination, quality
from ledgerlens.llm.common import scratch, table, written


@pytest.fixture(scope="module")
def stages(spark, sf001):
    docs = [table(spark, sf001, "documents")]
    for name, stage in P.STAGES:
        docs.append(written(stage(spark, docs[-1], sf001), scratch(spark, name)))
    return docs


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stage_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert all(d.dtypes == stages[0].dtypes for d in stages[1:5])
    assert P.ORACLE_SQL is None


def test_quality_stage(spark, sf001, stages):
    docs = stages[0]
    scored = quality.score(docs, quality.train(docs, table(spark, sf001, "labels"))).collect()
    assert set(texts(stages[1])) == {r.doc_id for r in scored if r.predicted}


def test_simhash_stage(stages):
    groups = brute.simhash_components(list(texts(stages[1]).items()))
    assert set(texts(stages[2])) == {d for d, (_, c) in groups.items() if d == c}


def test_substring_stage(stages):
    before, after = texts(stages[2]), texts(stages[3])
    expected = brute.substring_dedup(list(before.items()))
    assert before.keys() == after.keys()
    for doc, (n, gone, _) in expected.items():
        assert (after[doc] == before[doc]) if not gone else len(brute.words(after[doc])) == n - gone
    assert all(r.n_chars == len(r.text) for r in stages[3].collect() if expected[r.doc_id][1])


def test_decontamination_stage(spark, sf001, stages):
    hits = {r.doc_id for r in decontamination.contaminated(stages[3], table(spark, sf001, "benchmark")).collect()}
    assert texts(stages[4]).keys() == texts(stages[3]).keys() - hits


def test_packing_stage_and_run(spark, sf001, stages):
    pieces = stages[5].collect()
    assert {r.doc_id for r in pieces} == set(texts(stages[4]))
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[k] for k in key) for r in P.run(spark, sf001).collect()) == sorted(tuple(r[k] for k in key) for r in pieces)


def test_stages_on_odd_rows(spark, sf001, messy, nothing):
    for docs in (messy, nothing):
        for name, stage in P.STAGES:
            out = written(stage(spark, docs, sf001), scratch(spark, name))
            if name != "best_fit_packing":
                assert out.dtypes == docs.dtypes
            docs = out
        assert (docs.count() > 0) == bool(docs.select("doc_id").distinct().count())
    assert docs.count() == 0


CLASH = ("__kept", "row", "kept", "others", "chunk", "first", "component_id", "fp", "_", "is.dotted")


@pytest.fixture(scope="module")
def shared_ids(spark, sf001):
    """Rows with one id and several texts, rows without an id, a leak without one, and columns with names the stages use."""
    leak = table(spark, sf001, "benchmark").first().text
    tail = " ".join(f"tail{i}" for i in range(40))
    own = [" ".join(f"own{k}x{i}" for i in range(30)) for k in range(5)]
    rows = [(1, own[0] + " " + tail), (2, own[1] + " " + tail), (2, own[2]), (2, own[2]), (5, own[3]), (5, own[4]), (None, f"some words before {leak} and after"),
            (None, "quiet words " + own[0][:60]), (None, "quiet words " + own[0][:60]), (7, None), (8, ""), (8, "x " + leak)]
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(i, t, None if t is None else len(t), *[f"{n}{c}" for c in CLASH]) for n, (i, t) in enumerate(rows)], schema).repartition(3), rows, tail, leak


def by_row(df):
    return {int(r["__kept"].removesuffix("__kept")): r for r in df.collect()}


def test_simhash_stage_with_shared_ids(spark, sf001, shared_ids):
    docs, rows, _, _ = shared_ids
    out = by_row(P.simhash_near_dedup(spark, docs, sf001))
    links = brute.simhash_components([(n, t) for n, (_, t) in enumerate(rows)])
    groups = {}
    for n, (_, c) in links.items():
        groups.setdefault(c, []).append(n)
    assert len(out) == len(groups)
    for members in groups.values():
        (kept,) = [n for n in members if n in out]
        assert (rows[kept][0] is None, rows[kept][0] or 0) == min((rows[n][0] is None, rows[n][0] or 0) for n in members)
    assert all(r.text == rows[n][1] and all(r[c] == f"{n}{c}" for c in CLASH) for n, r in out.items())


def test_substring_stage_with_shared_ids(spark, sf001, shared_ids):
    docs, rows, tail, _ = shared_ids
    out = by_row(P.substring_dedup(spark, docs, sf001))
    assert len(out) == len(rows)
    for n, (i, t) in enumerate(rows):
        want = t.removesuffix(" " + tail) if n == 1 else t
        if n == 11:  # a later copy of a leak that a row without an id holds first: that row has no place in the order
            want = t
        assert out[n].text == want and out[n].n_chars == (None if t is None else len(want)) and out[n].doc_id == i, n
        assert all(out[n][c] == f"{n}{c}" for c in CLASH)


def test_decontamination_stage_with_shared_ids(spark, sf001, shared_ids):
    docs, rows, _, leak = shared_ids
    out = by_row(P.benchmark_decontamination(spark, docs, sf001))
    assert set(out) == {n for n, (_, t) in enumerate(rows) if leak not in (t or "")}
    assert all(out[n].text == rows[n][1] and out[n].doc_id == rows[n][0] for n in out)


def test_quality_stage_with_shared_ids(spark, sf001, shared_ids):
    docs, rows, _, _ = shared_ids
    labelled = table(spark, sf001, "documents")
    model = quality.train(labelled, table(spark, sf001, "labels"))
    scores = {n: r.predicted for n, r in enumerate(quality.score(spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string")
                                                                 .coalesce(1), model).orderBy("doc_id").collect())}
    out = by_row(quality.keep_good(docs, model))
    assert set(out) == {n for n, p in scores.items() if p}

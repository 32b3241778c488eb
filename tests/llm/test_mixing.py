"""The mixing operator against a plain version of its targets, streams and bounds."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, source string, text string, size string, number string, start string, target string, taken string, block string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = sum(weight[s] for s in names if s not in capped)
        level = (total - sum(3 * sizes[s] for s in capped)) / left if left else 0
        more = {s for s in names if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= more


@pytest.fixture(scope="module")
def many(spark):
    rows, n = [], 0
    for s, (count, words) in {"a": (300, 40), "b": (5, 30), "zz": (80, 200), "é": (1, 3000), "Z": (40, 9), None: (60, 50), "none": (4, 0)}.items():
        for i in range(count):
            rows.append((n, s, " ".join(f"w{n}x{j}" for j in range(words + i % 7 if words else 0))))
            n += 1
    rows += [(None, "a", "no id\x0bhere"), (7, "a", None), (8, "b", " \t\r\n"), (9, "zz", "twice over"), (9, "zz", "twice over"), (9, "zz", "another")]
    return rows


def test_mix_report(spark, many):
    got = mixing.mix_report(docs_of(spark, many).repartition(5), block=8, shard_slots=100).collect()
    assert len(got) == len(many)
    sizes, taken = {}, {}
    assert sorted((r.doc_id or -1, r.source or "", r.size) for r in got) == sorted((i or -1, s or "", len(WORD.findall(t or ""))) for i, s, t in many)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = plain_targets(sizes)
    assert any(want[s] == 3 * sizes[s] for s in want if sizes[s]) and want["none"] == 0
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 24, s


def test_reruns_agree_and_slots_are_filled_once(spark, many):
    docs = docs_of(spark, many)
    mixed, documents, sources = mixing.mix(docs, block=8, shard_slots=100)
    again = mixing.mix(docs.repartition(7), block=8, shard_slots=100)[0]
    cols = ["shard", "slot", "pass", "block", "number", "start", "doc_id", "first", "words"]
    assert mixed.select(cols).exceptAll(again.select(cols)).count() == 0
    slots = mixed.groupBy("shard", "slot").agg(F.countDistinct("number", "block").alias("n"), F.sum("words").alias("w")).collect()
    total = sources.agg(F.sum("quota")).first()[0]
    assert len(slots) == total and all(r.n == 1 and r.w <= 8 for r in slots)
    assert {r.shard for r in slots} == set(range((total + 99) // 100))
    # a block is taken once in a pass, and passes are filled in order
    passes = mixed.select("number", "pass", "block", "shard", "slot").distinct().groupBy("number", "pass", "block").count()
    assert passes.filter("count > 1").count() == 0
    per = {(r.number, r["pass"]): r.n for r in mixed.groupBy("number", "pass").agg(F.countDistinct("block").alias("n")).collect()}
    blocks = {r.number: r.n_blocks for r in sources.collect()}
    assert all(per[n, p - 1] == blocks[n] for n, p in per if p)


def test_texts_of_a_mix(spark, many):
    docs = docs_of(spark, many)
    mixed, _, _ = mixing.mix(docs, block=8, shard_slots=100)
    words = {}
    for i, s, t in many:
        words.setdefault((i, s), []).append(WORD.findall(t or ""))
    rows = mixing.with_words(mixed, docs).collect()
    assert len(rows) == mixed.count()
    for r in rows:
        assert any(" ".join(w[r["first"]:r["first"] + r.words]) == r.text for w in words[r.doc_id, r.source])


@pytest.mark.parametrize("size", [1, 2, 3, 64, 1000])
def test_permuted_is_a_bijection(spark, size):
    df = spark.range(size).withColumn("n", F.lit(size).cast("long"))
    got = [[r.p for r in mixing.permuted(df.withColumn("k", F.lit(key).cast("long")), "id", "n", "k", "p").orderBy("id").collect()] for key in (1, 2)]
    assert all(sorted(g) == list(range(size)) for g in got)
    if size >= 64:
        assert got[0] != got[1] and sum(a == b for a, b in enumerate(got[0])) < size / 10


def test_shards_differ_and_no_python_in_the_plan(spark, many):
    mixed, _, _ = mixing.mix(docs_of(spark, many), block=8, shard_slots=100)
    counts = {(r.shard, r.number): r["count"] for r in mixed.select("shard", "slot", "number").distinct().groupBy("shard", "number").count().collect()}
    first = [counts.get((s, 1), 0) for s in range(5)]
    assert len(set(first)) > 1
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_and_wordless_tables(spark):
    assert mixing.mix_report(docs_of(spark, []), block=8).count() == 0
    rows = mixing.mix_report(docs_of(spark, [(1, "a", None), (2, None, " ")]), block=8).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in rows] == [(0, 0, 0.0, 0)] * 2

"""Substring dedup, SimHash, decontamination: against brute force, and the odd rows."""

import random
from collections import Counter

import brute
import numpy as np
import pytest

from ledgerlens.llm import decontamination as D
from ledgerlens.llm import queries, simhash, substrings
from ledgerlens.llm.components import components


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def removed(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("window,chunk", [(2, 8_192), (6, 4), (20, 8)])
def test_substrings_match_brute_force(spark, monkeypatch, window, chunk):
    monkeypatch.setattr(substrings, "CHUNK_ROWS", chunk)
    r = random.Random(window)
    passages = [[r.choice("abcdefgh") * r.randrange(1, 3) for _ in range(window + r.randrange(9))] for _ in range(6)]
    rows = []
    for i in r.sample(range(1_000), 60):
        text = []
        for _ in range(r.randrange(5)):
            text += r.choice(passages) if r.random() < 0.6 else [r.choice("abcdefghij") for _ in range(r.randrange(30))]
        rows.append((i, "  ".join(text)))
    rows += [(2_000, "a " * 50), (2_001, "b a " * 40)]  # windows that overlap themselves
    assert removed(substrings.dedup_substrings(docs_of(spark, rows), window)) == brute.substring_dedup(rows, window)


def test_substrings_of_odd_rows(messy, messy_pairs, nothing):
    found = substrings.dedup_substrings(messy).collect()
    assert len(found) == len(messy_pairs) + 2
    expected = brute.substring_dedup(messy_pairs)
    assert all(expected[r.doc_id] == (r.n_words, r.n_removed, r.kept_sha256) for r in found if r.doc_id is not None)
    (alone,) = [r for r in found if r.doc_id is None]
    assert alone.n_removed == 0 and alone.n_words == 30
    assert substrings.dedup_substrings(nothing).count() == 0


def test_substring_query_on_the_tables(spark, sf001):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()]
    assert removed(queries.op5_substring_dedup(spark, sf001)) == brute.substring_dedup(rows)


def marked(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_simhash_query_on_the_tables(spark, sf001):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()]
    assert marked(queries.op10_simhash(spark, sf001)) == brute.simhash_components(rows)


def test_simhash_of_odd_rows(messy, messy_pairs, nothing):
    found = simhash.near_duplicates(messy).collect()
    expected = brute.simhash_components(messy_pairs)
    assert len(found) == len(messy_pairs) + 2
    assert all(expected[r.doc_id] == (r.fingerprint, r.component_id) for r in found if r.doc_id is not None)
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("sample,shard", [(20_000, 8_192), (200, 40), (40, 7)])
def test_links_are_exact_whatever_the_shards(spark, sample, shard):
    """Chains and dense balls of fingerprints, so shards overlap and one shard needs many blocks."""
    r = random.Random(shard)
    values = {r.getrandbits(64) for _ in range(150)}
    ball = r.getrandbits(64)
    for _ in range(200):
        values.add(ball ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    at = r.getrandbits(64)
    for _ in range(60):
        values.add(at := at ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    values = sorted(values)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    points = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long").repartition(4)
    found = components(simhash.link(points, 3, sample, shard)).collect()
    sets = {}
    for x in found:
        sets.setdefault(x.root, set()).add(int(np.int64(x.node).view(np.uint64)))
    expected = {}
    for v in values:
        expected.setdefault(root(v), set()).add(v)
    assert sorted(map(sorted, sets.values())) == sorted(sorted(s) for s in expected.values() if len(s) > 1)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(5, 5), (3, 2)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_dedup_with_tiny_buckets(spark, monkeypatch):
    """Buckets follow the input's size: the same result with many of them."""
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 1_000)
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    shared = [" ".join(r.choice(words) for _ in range(30)) for _ in range(4)]
    rows = [(i, " ".join([f"a{i}b{k}" for k in range(r.randrange(20))] + [r.choice(shared)] + [f"c{i}d{k}" for k in range(r.randrange(20))])) for i in range(80)]
    assert removed(substrings.dedup_substrings(docs_of(spark, rows))) == brute.substring_dedup(rows)


def plain_alignment(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_is_smith_waterman():
    r = random.Random(3)
    items = [np.array([r.randrange(1, 6) for _ in range(r.randrange(1, 14))]) for _ in range(60)]
    texts = [np.array([r.randrange(1, 6) for _ in range(r.randrange(1, 30))]) for _ in range(60)]
    best, end = D.align(D.padded(items, -1), D.padded(texts, -2))
    assert best.tolist() == [plain_alignment(a.tolist(), b.tolist()) for a, b in zip(items, texts)]
    assert all(plain_alignment(a.tolist(), b[:e].tolist()) == s for a, b, e, s in zip(items, texts, end.tolist(), best.tolist()))


@pytest.mark.parametrize("block_bytes", [4 << 20, 300])
def test_edited_leaks_are_found_and_clean_texts_left(spark, block_bytes):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 8)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)] + [(50, None), (51, ""), (52, "--- !!"), (53, "Tiny Item"), (3, None)]
    clean = [(1_000 + i, " ".join(word() for _ in range(80))) for i in range(20)]
    leaks = []
    for i, text in items[:12]:
        w = text.split()
        for k in range(4, 30, 6):
            w[k] = word()  # every sixth word replaced
        w.insert(10, word())
        leaks.append((i, f"{word()} {word()}.\n" + " ".join(w).upper() + f"! {word()}"))
    rows = [*clean, *leaks, (2_000, "x tiny, ITEM y"), (2_001, None), (2_002, ""), leaks[0], (None, items[1][1])]
    found = D.contaminated(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    assert sorted((r.doc_id, r.item_id) for r in found if r.doc_id is not None) == sorted([*((i, i) for i in range(12)), (0, 0), (2_000, 53)])
    assert [r.item_id for r in found if r.doc_id is None] == [1]
    (one,) = [r for r in found if r.doc_id == 4]
    assert 0.5 <= one.score < 1 and (one.start_word, one.end_word) == (2, 33)


@pytest.mark.parametrize(("copies", "every"), [(3, 5), (100, 5), (1_000, 5), (100, 4), (1_000, 3.4)])
def test_leaks_in_many_documents_are_found(spark, copies, every):
    """One passage with 20 to 30% of its words replaced, in so many documents; some of its n-grams are in clean ones too."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 8)))
    item = [word() for _ in range(40)]
    edited = [word() if int((k + 1) / every) > int(k / every) else w for k, w in enumerate(item)]
    text = lambda w: " ".join([*(word() for _ in range(10)), *w, *(word() for _ in range(10))])
    rows = [(i, text(edited)) for i in range(copies)] + [(10_000 + i, text(item[i % 38:i % 38 + 3])) for i in range(76)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(word() for _ in range(40)))], "item_id long, text string")
    found = D.contaminated(docs_of(spark, rows), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, 1) for i in range(copies)]
    assert all(r.score == plain_alignment(item, edited) / 80 >= 0.5 for r in found)


def test_passages_left_out_cannot_reach_the_score():
    r = random.Random(6)
    items = D.Items(list(range(30)), [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 15))) for _ in range(30)])
    number = np.array([r.randrange(0, len(items.vocabulary) + 1) for _ in range(400)])
    first = np.array([r.randrange(0, 380) for _ in range(900)])
    last, item = first + 12, np.arange(900) % 30
    good = D.reachable(items, number, item, first, last, 0.5)
    score = [plain_alignment(items.words[i].tolist(), [x or -1 for x in number[a:b].tolist()]) / (2 * len(items.words[i])) for i, a, b in zip(item, first, last)]
    assert 0 < good.sum() < 900 and all(g or s < 0.5 for g, s in zip(good, score))


def edits_of(item, r):
    """The item with every 2nd to 6th word replaced, dropped or followed by others, or random edits."""
    kind, every = r.choice(["replace", "drop", "insert", "insert2", "mixed"]), r.choice([2, 3, 4, 5, 6])
    out = []
    for k, w in enumerate(item):
        hit = (k + 1) % every == 0 if kind != "mixed" else r.random() < 0.3
        do = kind if kind != "mixed" else r.choice(["replace", "drop", "insert"])
        if not hit:
            out.append(w)
        elif do == "replace":
            out.append(f"new{r.randrange(99)}")
        elif do.startswith("insert"):
            out += [w, *(f"more{r.randrange(99)}" for _ in range(2 if do == "insert2" else 1))]
    return out


def test_every_edit_that_reaches_the_score_is_found(spark):
    """Random edits of items of 3 to 40 words, in clean words or among words of other items, against plain alignment of the whole document."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randrange(2, 5)))
    common = [word() for _ in range(30)]
    items = [[r.choice(common) if r.random() < 0.4 else word() for _ in range(r.choice([3, 4, 5, 9, 18, 25, 40]))] for _ in range(40)]
    docs = []
    for _ in range(400):
        fill = lambda: [r.choice(common) for _ in range(r.randrange(0, 30))]
        docs.append([*fill(), *edits_of(r.choice(items), r), *fill()])
    docs.append([w for pair in zip(items[6], ["x"] * 40) for w in pair])  # a word after each word: no two words in a row are left
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    found = D.contaminated(docs_of(spark, rows), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()
    got = {(f.doc_id, f.item_id): f.score for f in found}
    want = {(i, j): s for i, d in enumerate(docs) for j, t in enumerate(items) if (s := plain_alignment(t, d) / (2 * len(t))) >= 0.5}
    assert len(want) > 300 and got == want


def test_query_equals_plain_alignment_on_the_tables(spark, sf001):
    """op7 on sf0.001: every document whole against every item, by a plain word-by-word alignment where enough words are shared."""
    read = lambda name: spark.read.parquet(f"{sf001}/{name}.parquet").collect()
    words = lambda t: [w for w in (D.plain(x) for x in (t or "").encode().split()) if w]
    items = {r.item_id: words(r.text) for r in read("benchmark")}
    got = {(f.doc_id, f.item_id): f.score for f in queries.op7_decontamination(spark, sf001).collect()}
    want = {}
    for r in read("documents"):
        own = np.array(words(r.text))
        for j, t in items.items():
            if t and sum((Counter(t) & Counter(own.tolist())).values()) >= len(t) / 2:
                number = {w: k for k, w in enumerate(dict.fromkeys(t))}
                line = np.array([[number.get(w, -9) for w in own]])
                best, _ = D.align(np.array([[number[w] for w in t]]), line)
                if best[0] / (2 * len(t)) >= 0.5:
                    want[r.doc_id, j] = best[0] / (2 * len(t))
    assert want and got == want


def test_ties_between_passages(spark):
    """Of equal passages of one document the first is reported."""
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    (one,) = D.contaminated(docs_of(spark, [(3, "x alpha beta gamma delta epsilon zeta " + "y " * 50 + "alpha beta gamma delta epsilon zeta")]), items).collect()
    assert (one.score, one.start_word, one.end_word) == (1.0, 1, 7)


def test_decontamination_of_odd_tables(spark, messy, nothing):
    items = spark.createDataFrame([(1, "river mountain light house window paper stone green quiet", "x")], "item_id long, text string, score string")
    assert {r.doc_id for r in D.contaminated(messy, items).collect()} <= {r.doc_id for r in messy.collect()}
    assert D.contaminated(nothing, items).count() == 0
    assert D.contaminated(messy, items.limit(0)).count() == 0

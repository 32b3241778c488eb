import math
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import packing, queries, token_files
from ledgerlens.llm.common import map_file, scratch


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def rows_of(df):
    return sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect())


def test_token_query_on_the_tables(spark, sf001, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    assert rows_of(queries.op9_token_files(spark, sf001)) == brute.token_rows(docs, tokenizer, 2)


def test_token_files_of_odd_rows(messy, messy_pairs, nothing, tokenizer):
    assert rows_of(token_files.token_files(messy)) == brute.token_rows([*messy_pairs, messy_pairs[8]], tokenizer, 2)
    assert token_files.token_files(nothing).count() == 0


def test_file_format(spark, messy, messy_pairs, tokenizer):
    uri = scratch(spark, "format")
    manifest = token_files.write_token_files(messy.filter("doc_id is not null").dropDuplicates(["doc_id"]), uri, partitions=4)
    ids, offsets = [], []
    for r in sorted(manifest.collect()):
        flat, own = map_file(f"{uri}/ids-{r.part:05d}.bin", "<u2"), map_file(f"{uri}/offsets-{r.part:05d}.bin", "<u8")
        assert int(own[0]) == len(ids) and int(own[-1]) == len(ids) + len(flat) and len(own) == r.n_docs + 1
        ids += flat.tolist()
        offsets += own[:-1].tolist()
    expected = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in messy_pairs]
    assert ids == [x for e in expected for x in e]
    assert offsets == np.cumsum([0, *map(len, expected)])[:-1].tolist()


def test_small_cache_changes_nothing(messy_pairs, tokenizer):
    own = token_files.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), cache=3)
    for _, t in messy_pairs:
        flat, bounds = own.encode([(t or "").encode(), None], 7)
        assert flat[:bounds[1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [7]
        assert flat[bounds[1]:].tolist() == [7]


def test_odd_words_are_encoded_as_the_whole_tokenizer_does(tokenizer):
    own = token_files.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(4)
    pool = "abcXYZ019'.,!?-_|<>#ßÀÉéñüÿ×÷İǆﬁ中文字한글🙂\u0301\u00ad\u0085\u2028\x1c\x00`~@µª²½" + "".join(map(chr, range(33, 127)))
    words = ["".join(r.choice(pool) for _ in range(r.randrange(1, 9))) for _ in range(6_000)]
    words += ["don't", "I'll'd", "''s", "<|endoftext|>", "a<|startoftext|>b", "<|", "it's.it's", "x" * 300, "é" * 40]
    for a in range(0, len(words), 50):
        text = " ".join(words[a:a + 50])
        flat, _ = own.encode([text.encode()], 1)
        assert flat[:-1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, words[a:a + 50]


def check_packing(found, docs, tokenizer, capacity):
    expected = []
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, a in enumerate(range(0, len(ids), capacity)):
            own = ids[a:a + capacity]
            expected.append((doc, piece, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    in_order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    assert in_order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == in_order(expected)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), math.ceil(sum(r.length for r in found) / capacity)


def test_packing_query_on_the_tables(spark, sf001, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    n, least = check_packing(queries.op8_best_fit_packing(spark, sf001).collect(), docs, tokenizer, 2048)
    assert n <= 1.05 * least + 1


@pytest.mark.parametrize("capacity,open_bins,merge", [(64, 4, 2), (2048, 256, 32)])
def test_packing_of_odd_rows(spark, messy, messy_pairs, nothing, tokenizer, capacity, open_bins, merge):
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    check_packing(packing.pack(messy.repartition(7), capacity, open_bins, merge=merge).collect(), docs, tokenizer, capacity)
    assert packing.pack(nothing).count() == 0


def test_bins_are_best_fit_and_the_fullest_closes_first():
    r = np.random.default_rng(2)
    bins, plain, closed = packing.OpenBins(100, 5, 0), {}, 0
    for length in r.integers(1, 101, 2_000).tolist():
        fits = [(100 - used, i) for i, used in plain.items() if 100 - used >= length]
        found, offset = bins.place(length)
        if fits:
            assert plain[found] == offset and 100 - offset == min(fits)[0]
        else:
            assert offset == 0 and found not in plain
            plain[found] = 0
        plain[found] += length
        if plain[found] == 100:
            del plain[found]
        if len(plain) > 5:
            fullest = max(plain.values())
            (gone,) = set(plain) - bins.still_open()
            assert plain.pop(gone) == fullest
            closed += 1
        assert set(plain) == bins.still_open()
    assert closed


def test_merges_hand_on_a_fixed_number_of_bins(spark, monkeypatch, tokenizer):
    """40 tasks with open bins: no merge group reads over merge * open_bins bins, and few sequences are lost."""
    docs = [(i, "word " * (i % 37 + 1)) for i in range(2_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    made, sizes = [], []

    class Seen(packing.OpenBins):
        def __init__(self, capacity, most, first_id):
            super().__init__(capacity, most, first_id)
            made.append(most)

    monkeypatch.setattr(packing, "written", lambda frame, uri, plain=packing.written: sizes.append((uri, plain(frame, uri))) or sizes[-1][1])
    found = packing.pack(df, 64, 3, merge=4).collect()
    n, least = check_packing(found, docs, tokenizer, 64)
    rounds = [frame for uri, frame in sizes if "/bins-" in uri]
    assert len(rounds) == 3
    for frame in rounds:
        width = 4 ** (rounds.index(frame) + 1) << packing.BINS_A_TASK
        for r in frame.selectExpr(f"sequence_id div {width} AS g", "again", "into").groupBy("g").agg({"into": "count"}).collect():
            assert r[1] <= 12
        assert max(r[1] for r in frame.filter("again").selectExpr(f"sequence_id div {width} AS g", "into").distinct().groupBy("g").count().collect()) <= 3
    assert n <= 1.15 * least + 1


def test_parts_follow_the_size_of_the_input(spark, monkeypatch, tokenizer):
    """Tiny parts: more files than the session has partitions, the same ids."""
    monkeypatch.setattr(token_files, "PART_BYTES", 2_000)
    docs = [(i, "some words of a text " * (i % 50)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = scratch(spark, "tiny-parts")
    manifest = token_files.write_token_files(df, out)
    assert manifest.count() > 20 and manifest.agg({"n_docs": "max"}).first()[0] < 60
    start = 0
    for r in sorted(token_files.read_token_files(manifest, out).collect()):
        ids = tokenizer.encode(docs[r.doc_id][1], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)

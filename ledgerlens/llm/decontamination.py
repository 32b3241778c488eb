"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman scores them.

Words are compared lower-cased and without characters other than letters and digits.

1. Seeds are pairs of words with at most one word between them (2-grams with a gap). An alignment that
   reaches the least score has so few errors that, of its matched words, most follow each
   other within a gap of one on both sides: an item of n words has n * least - 1 places
   at least where such a pair starts. So the most common places can be left out as seeds, one fewer than that, and
   every hit still holds a seed: the rare ones. How often each pair is in the corpus is counted over all documents, as
   they are cut into words; the words' numbers are stored, so that is done once.
2. A seed in a document joins the item to the passage around it, as wide as the errors allow. A passage is
   left out only where the words that it shares with the item, each as often as in both, or the places
   whose pairs it holds, are too few for the least score, so no hit is lost.
3. Passage and item are aligned (match +2, mismatch and gap -1); the score is the share of the
   item's full score.

The test items are read in blocks of about ``block_bytes``, each against all documents, so what
a task holds is bounded however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import CACHE_WORDS, PLAIN, as_bytes, groups, scratch, split_words, written

MATCH, MISS = 2, -1
#: Seeds that are looked at together, and words of their passages.
SEEDS, TOGETHER = 1 << 15, 1 << 20
HITS = "doc_id long, item_id long, score double, matched_words int, start_word int, end_word int"


def plain(word: bytes) -> str:
    low = word.decode("utf-8", "replace").lower()
    return low if low.isalnum() else PLAIN.sub("", low)


@dataclass
class Items:
    """A block of test items as word numbers (from 1), and their seeds: the pairs of words (from
    the same place at most two ahead; a single word is its own pair) with item and place, sorted by pair."""

    ids: list[int]
    texts: list[str]
    least: float = 0.5
    vocabulary: dict[str, int] = field(default_factory=dict)
    words: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        for text in self.texts:
            own = [w for w in map(plain, text.encode().split()) if w]
            self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own], np.int64))
        self.sizes = np.array(list(map(len, self.words)), np.int64)
        found = []
        for item, own in enumerate(self.words):
            for ahead in (1, 2):
                found += zip((own[:-ahead] * self.base + own[ahead:]).tolist(), repeat(item), range(len(own)))
            if len(own) == 1:
                found.append((int(own[0]), item, 0))
        self.pair, self.item, self.place = map(np.array, zip(*sorted(found))) if found else (np.empty(0, np.int64),) * 3
        self.distinct = np.unique(self.pair)
        # places whose pairs every hit has, and errors that it can have
        self.places = np.maximum(1, np.ceil(self.sizes * self.least - 1 - 1e-9)).astype(np.int64)
        self.errors = np.floor(MATCH * self.sizes * (1 - self.least) / -MISS + 1e-9).astype(np.int64)
        self.seed = np.ones(len(self.pair), bool)
        of_item = np.lexsort((self.pair, self.item))
        self.by_item = self.item[of_item] * self.base ** 2 + self.pair[of_item]
        self.by_item_place = self.place[of_item]
        pairs = np.repeat(np.arange(len(self.words)), self.sizes) * self.base + np.concatenate([np.empty(0, np.int64), *self.words])
        self.bags = np.unique(pairs, return_counts=True)

    @property
    def base(self) -> int:
        return len(self.vocabulary) + 1

    def keep_rare(self, counts: np.ndarray) -> None:
        """Leave the most common places of each item out of the seeds; ``counts`` are of ``distinct``."""
        often = counts[np.searchsorted(self.distinct, self.pair)]
        place = self.item * (int(self.sizes.max(initial=0)) + 1) + self.place
        key, at = np.unique(place, return_inverse=True)
        common = np.bincount(at, often, len(key))
        item = key // (int(self.sizes.max(initial=0)) + 1)
        order = np.lexsort((key, -common, item))
        rank = np.arange(len(key)) - np.searchsorted(item[order], item[order])
        left = np.ones(len(key), bool)
        left[order] = rank >= self.places[item[order]] - 1
        self.seed = left[at]


class Numbers(dict):
    """Word bytes to its number in the items' vocabulary, 0 if not there, -1 if nothing is left of it."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        left = plain(word)
        value = self[word] = self.vocabulary.get(left, 0) if left else -1
        return value


def numbered(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, word numbers end to end, each one's place among all words of its text, bounds)."""
    cache = Numbers(items.vocabulary)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
        for a, b in groups(texts):
            words, ends = split_words(texts[a:b])
            number = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
            place = np.arange(len(words)) - np.repeat(ends[:-1], np.diff(ends))
            kept = np.flatnonzero(number >= 0)
            yield ids[a:b], number[kept], place[kept], np.searchsorted(kept, ends)


def pairs_of(items: Items, number: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, keys) of the pairs of known words within each document, for each distance."""
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(number))
    if len(items.sizes) and items.sizes.min() < 2:  # only a single word is its own pair
        yield np.flatnonzero(number > 0), number[number > 0]
    for ahead in (1, 2):
        n = max(0, len(number) - ahead)
        at = np.flatnonzero((number[:n] > 0) & (number[ahead:] > 0) & (left[:n] > ahead))
        yield at, number[at] * items.base + number[at + ahead]


def seed_hits(items: Items, number: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, first and last+1 row of the items' pairs with the same pair), within documents."""
    for at, own in pairs_of(items, number, bounds):
        low, high = np.searchsorted(items.pair, own, side="left"), np.searchsorted(items.pair, own, side="right")
        hit = high > low
        yield at[hit], low[hit], high[hit]


def pieces(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries with at most ``most`` together (one entry at least)."""
    total, start = np.cumsum(size), 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, side="right")))
        yield start, end
        start = end


def laid_out(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each of ``first`` on, ``size`` of them, end to end."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def reachable(items: Items, number: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray, least: float) -> np.ndarray:
    """Whether each passage (words ``first`` to ``last``) shares so many words with its item, each as
    often as in both, that a score of ``least`` is possible."""
    out = np.zeros(len(item), bool)
    base = items.base
    word, times = items.bags
    for a, b in pieces(last - first, TOGETHER):
        size = (last - first)[a:b]
        words = number[laid_out(first[a:b], size)]
        key = np.repeat(item[a:b], size) * base + words
        at = np.minimum(np.searchsorted(word, key), len(word) - 1)
        shared = np.flatnonzero((word[at] == key) & (words > 0))
        pair, n = np.unique(np.repeat(np.arange(b - a), size)[shared] * len(word) + at[shared], return_counts=True)
        most = np.bincount(pair // len(word), np.minimum(n, times[pair % len(word)]), b - a)
        out[a:b] = most >= least * items.sizes[item[a:b]] - 1e-9
    return out


def paired(items: Items, number: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each passage holds pairs from as many places of its item as every hit does."""
    out = np.zeros(len(item), bool)
    for a, b in pieces(last - first, TOGETHER):
        size = (last - first)[a:b]
        words = number[laid_out(first[a:b], size)]
        bounds = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(b - a), size)
        seen = []
        for at, own in pairs_of(items, words, bounds):
            key = item[a:b][owner[at]] * items.base ** 2 + own
            low, high = np.searchsorted(items.by_item, key, side="left"), np.searchsorted(items.by_item, key, side="right")
            row = laid_out(low, high - low)
            seen.append(np.unique(np.repeat(owner[at], high - low) * (int(items.sizes.max()) + 1) + items.by_item_place[row]))
        held = np.unique(np.concatenate(seen)) // (int(items.sizes.max()) + 1)
        out[a:b] = np.bincount(held, minlength=b - a) >= items.places[item[a:b]]
    return out


def candidates(items: Items, number: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, item, first and last+1 word) of the passages around seeds that can reach the least score."""
    for at, low, high in seed_hits(items, number, bounds):
        for a, b in pieces(high - low, SEEDS):
            row = laid_out(low[a:b], (high - low)[a:b])
            where = np.repeat(at[a:b], (high - low)[a:b])[items.seed[row]]
            row = row[items.seed[row]]
            doc, item = np.searchsorted(bounds, where, side="right") - 1, items.item[row]
            bin_ = (where - items.place[row]) // items.sizes[item]  # passages that begin within an item's length of each other are one
            found = np.stack([doc, item, bin_], axis=1)
            found = found[np.lexsort(found.T[::-1])]
            found = found[np.r_[True, (found[1:] != found[:-1]).any(axis=1)]] if len(found) else found
            doc, item, bin_ = found.T
            size, errors = items.sizes[item], items.errors[item]
            first, last = np.maximum(bounds[doc], bin_ * size - errors), np.minimum(bounds[doc + 1], (bin_ + 2) * size + errors)
            good = np.flatnonzero(reachable(items, number, item, first, last, items.least))
            good = good[paired(items, number, item[good], first[good], last[good])]
            yield doc[good], item[good], first[good], last[good]


def align(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of row i of ``items`` with row i of ``passages`` (padded with -1 and -2):
    the best score and the passage's word after the best end. All rows advance together; a
    gap along the passage is a running maximum."""
    rows, width = passages.shape
    slope = np.arange(width) * -MISS
    best, end = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    before = np.zeros((rows, width + 1), np.int64)
    for i in range(items.shape[1]):
        hit = np.where(passages == items[:, i:i + 1], MATCH, MISS)
        now = np.maximum(np.maximum(before[:, :-1] + hit, before[:, 1:] + MISS), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        at = now.argmax(axis=1)
        top = now[np.arange(rows), at]
        end = np.where(top > best, at + 1, end)
        best = np.maximum(best, top)
        before[:, 1:] = now
    return best, end


def padded(parts: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(parts), max(map(len, parts), default=0)), fill, np.int64)
    for i, p in enumerate(parts):
        out[i, :len(p)] = p
    return out


def passages_aligned(items: Items, number: np.ndarray, found: list[tuple[int, int, int]], least: float) -> list[tuple[int, float, int, int, int]]:
    """Of candidates (item, first and last+1 word): (candidate, score, matched words, start, end) from ``least`` up."""
    out = []
    order = sorted(range(len(found)), key=lambda k: len(items.words[found[k][0]]))
    for a in range(0, len(order), 512):
        some = order[a:a + 512]
        own = [items.words[found[k][0]] for k in some]
        texts = [number[found[k][1]:found[k][2]] for k in some]
        texts = [np.where(t == 0, -3, t) for t in texts]
        best, end = align(padded(own, -1), padded(texts, -2))
        score = best / np.array([MATCH * len(w) for w in own])
        good = np.flatnonzero(score >= least)
        if len(good):
            back, start = align(padded([own[g][::-1] for g in good], -1), padded([texts[g][:end[g]][::-1] for g in good], -2))
            for g, length in zip(good.tolist(), start.tolist(), strict=True):
                x, y = found[some[g]][1], int(end[g])
                matched = int(np.isin(own[g], texts[g][y - length:y]).sum())
                out.append((some[g], float(score[g]), matched, x + y - length, x + y))
    return out


#: What is stored of a document: its word numbers and, where words were left out, their places; and each task's counts of pairs.
STORED = [T.StructField("words", T.BinaryType()), T.StructField("places", T.BinaryType()), T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())]


def with_words(docs: DataFrame, text: int, keep: int, items: Items) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the first ``keep`` columns of ``docs`` with the word numbers of column ``text``, stored, so that
    texts are cut into words once; and how often each of the items' distinct pairs (by number) is in all documents,
    counted by each task and then summed."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in plain.schema.fields[:keep]], *STORED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(items.distinct) + 1, np.int64)
        kinds: list = []
        names = [f.name for f in schema.fields]
        for batch in batches:
            kinds = [batch.column(i).type for i in range(keep)]
            words, places = [], []
            texts = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(text)], ["doc_id", "text"])
            for _, number, place, bounds in numbered([texts], items):
                for _, own in pairs_of(items, number, bounds):
                    at = np.minimum(np.searchsorted(items.distinct, own), len(items.distinct) - 1)
                    counts += np.bincount(np.where(items.distinct[at] == own, at, len(items.distinct)), minlength=len(counts))
                for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    words.append(number[x:y].astype("<i4").tobytes())
                    places.append(b"" if y == x or place[y - 1] == y - x - 1 else place[x:y].astype("<i4").tobytes())
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(keep)], pa.array(words, pa.binary()), pa.array(places, pa.binary()), none, none], names)
        some = np.flatnonzero(counts[:-1])
        if len(some):
            none = [pa.nulls(len(some), k) for k in [*kinds, pa.binary(), pa.binary()]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(some), pa.array(counts[some])], names)

    found = written(plain.mapInArrow(run, schema), scratch(docs.sparkSession, "words"))
    return found.filter("words is not null"), found.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))


def stored(ids: list, words: list[bytes], places: list[bytes]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """As ``numbered``, from stored word numbers."""
    for a, b in groups(words):
        number = [np.frombuffer(w, "<i4") for w in words[a:b]]
        bounds = np.concatenate([[0], np.cumsum([len(n) for n in number])])
        place = [np.frombuffer(p, "<i4") if p else np.arange(len(n)) for p, n in zip(places[a:b], number, strict=True)]
        yield ids[a:b], np.concatenate(number).astype(np.int64), np.concatenate(place).astype(np.int64), bounds


def find(items: Items, ids: list, words: list[bytes], places: list[bytes]) -> Iterator[tuple]:
    """(id, item, score, matched words, first and last+1 word) of the best passage of each document and item."""
    for own, number, place, bounds in stored(ids, words, places):
        found, docs_of = [], []
        for doc, *passage in candidates(items, number, bounds):
            found += zip(*(x.tolist() for x in passage), strict=True)
            docs_of += doc.tolist()
        best: dict[tuple[int, int], tuple] = {}
        for k, score, matched, x, y in passages_aligned(items, number, found, items.least):
            key, row = (docs_of[k], found[k][0]), (score, matched, -int(place[x]), int(place[y - 1]) + 1)
            best[key] = max(best.get(key, row), row)
        yield from ((own[d], items.ids[i], s, m, -x, y) for (d, i), (s, m, x, y) in best.items())


def block_hits(rows: DataFrame, items: Items) -> DataFrame:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = list(find(items, *(batch.column(i).to_pylist() for i in range(3))))
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits), kinds, strict=True)], HITS.replace(",", "").split()[::2])

    return rows.select("c0", "words", "places").mapInArrow(run, HITS)


def item_blocks(benchmark: DataFrame, least: float, block_bytes: int) -> Iterator[Items]:
    """The items in blocks of about ``block_bytes`` of text, which is what a task holds at a time."""
    spark = benchmark.sparkSession
    tests = written(benchmark.select("item_id", "text").filter(F.length(F.coalesce("text", F.lit(""))) > 0), scratch(spark, "items"))
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for b in range(blocks):
        own = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        items = Items([r.item_id for r in own], [r.text for r in own], least)
        if len(items.pair):
            yield items


def seeded(docs: DataFrame, text: int, keep: int, items: Items) -> DataFrame:
    """The stored rows of ``docs``; ``items`` keeps the seeds that are rare in them."""
    rows, counted = with_words(docs, text, keep, items)
    counts = np.zeros(len(items.distinct), np.int64)
    for r in counted.collect():  # the block's pairs at most
        counts[r.pair] = r.n
    items.keep_rare(counts)
    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, score, matched_words, start_word, end_word): for each document and each
    test item that it holds with a score of ``least`` or more, the best passage.

    ``start_word`` and ``end_word`` bound the passage among the document's words.

    Cases: null and empty texts hold nothing, and null or wordless items are held nowhere; an
    item of two words is held only where both stand in order, at most one word apart (a single word is its own seed); repeated rows of documents or items are
    reported as often as they come; a null doc_id is reported as null; an empty table on either
    side gives no row. Columns beside (doc_id, text) and (item_id, text) are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    out = spark.createDataFrame([], HITS)
    for items in item_blocks(benchmark, least, block_bytes):
        out = out.unionByName(written(block_hits(seeded(docs, 1, 1, items), items), scratch(spark, "leaks")))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item. Each row is judged by its own text where it stands."""
    at, n, names = docs.columns.index("text"), len(docs.columns), docs.columns

    def clean(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = {hit[0] for hit in find(items, list(range(batch.num_rows)), *(batch.column(n + i).to_pylist() for i in range(2)))}
                yield batch.select(range(n)).filter(pa.array([i not in held for i in range(batch.num_rows)], pa.bool_()))
        return run

    for items in item_blocks(benchmark, least, block_bytes):
        rows = seeded(docs, at, n, items).drop("pair", "n")
        docs = rows.mapInArrow(clean(items), T.StructType(rows.schema.fields[:n])).toDF(*names)
    return docs

"""SimHash near-duplicates, linked exactly by vantage-point trees.

1. ``fingerprints``: 64 bits a text, from the XXH64 hashes of its word shingles.
2. Equal fingerprints become one point. A vantage-point tree over a bounded sample splits the
   space into shards by Hamming distance: inside or outside a ball around each vantage point.
3. Every point lives in one shard. It also visits every later shard that its own ball of
   ``max_bits`` reaches: where the distance to a vantage point is within ``max_bits`` of the
   radius, both sides are visited, and triangle bounds prune the others. Each pair within
   ``max_bits`` meets in a shard, as the one's visit to the other's home.
4. A shard with many points is dealt as a grid of blocks, so no task holds more than a
   block of residents and one of visitors. Inside, another vantage-point tree finds the exact
   pairs, and only a spanning star of each linked set leaves the task.
5. Connected components over the stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerlens.llm.common import as_bytes, groups, scratch, written
from ledgerlens.llm.components import components

#: Points in the sample that lays out the shards (smallest hashes first, so it is the same each run).
SAMPLE = 20_000
#: Points that a shard, and a block of one, is meant to hold.
SHARD = 8_192
LEAF = 128
AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint_array(texts: list[bytes | None], words: int = 3, seed: int = 42) -> np.ndarray:
    """Of each text: A-Z lower-cased, words joined by a space in windows of ``words``, repeats
    counted; a bit is set if over half of the windows' hashes have it. Fewer words: the whole
    sequence is one window; none: zero."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in groups(texts, 1 << 21):
        hashes: list[int] = []
        ends = [0]
        for text in texts[a:b]:
            found = text.translate(AZ).split() if text else []
            if len(found) >= words:
                joined, at, bounds = b" ".join(found), 0, []
                for w in found:
                    bounds.append(at)
                    at += len(w) + 1
                tails = bounds[words:]
                tails.append(at)
                hashes += [xxh64_intdigest(joined[x:y - 1], seed) for x, y in zip(bounds, tails)]
            elif found:
                hashes.append(xxh64_intdigest(b" ".join(found), seed))
            ends.append(len(hashes))
        for i in range(a, b):
            x, y = ends[i - a], ends[i - a + 1]
            if y > x:
                own = np.array(hashes[x:y], "<u8").view(np.uint8).reshape(-1, 8)
                count = sum((np.unpackbits(own[k:k + 65_536], axis=1, bitorder="little").sum(0, dtype=np.int64)
                             for k in range(0, len(own), 65_536)), np.zeros(64, np.int64))
                out[i] = np.packbits(2 * count > y - x, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for each row; ``fp`` is the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprint_array(as_bytes(batch.column(1)), words, seed)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(fp.view(np.int64))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def bits_apart(points: np.ndarray, other: np.uint64 | np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ other).astype(np.int16)


class Split:
    """A node of a vantage-point tree: ``radius`` and nearer are inside. A leaf has no vantage point."""

    __slots__ = ("vantage", "radius", "inside", "outside", "points", "leaf")

    def __init__(self, points: np.ndarray | None = None):
        self.vantage, self.points, self.leaf = None, points, 0


def grow(values: np.ndarray, points: np.ndarray, leaf: int) -> Split:
    """A tree over ``values[points]``. The vantage point, of a few evenly spaced candidates, is
    the one whose distances spread most, as fewest points then lie at the boundary."""
    node = Split(points)
    if len(points) <= leaf:
        return node
    best = None
    for at in np.linspace(0, len(points) - 1, 5).astype(int):
        vantage = values[points[at]]
        d = bits_apart(values[points], vantage)
        radius = int(np.median(d))
        inside = d <= radius
        if inside.all():
            radius = int(d.max()) - 1
            inside = d <= radius
        n = int(inside.sum())
        if 0 < n < len(points):
            lost = int((np.abs(2 * (d - radius) - 1) <= 6).sum()) + abs(2 * n - len(points)) // 2
            if best is None or lost < best[0]:
                best = lost, vantage, radius, inside
    if best is None:  # all equal
        return node
    _, node.vantage, node.radius, inside = best
    node.points = None
    node.inside, node.outside = grow(values, points[inside], leaf), grow(values, points[~inside], leaf)
    return node


def number_leaves(root: Split) -> int:
    stack, n = [root], 0
    while stack:
        node = stack.pop()
        if node.vantage is None:
            node.leaf, n = n, n + 1
            node.points = None
        else:
            stack += [node.outside, node.inside]
    return n


def route(root: Split, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value its home leaf and the later leaves that its ball of ``bits`` reaches:
    parallel arrays (index of the value, leaf, whether it is home)."""
    out = []
    stack = [(root, np.arange(len(values)), np.ones(len(values), bool))]
    while stack:
        node, at, home = stack.pop()
        if node.vantage is None:
            out.append((at, np.full(len(at), node.leaf), home))
            continue
        d = bits_apart(values[at], node.vantage)
        near = d <= node.radius
        for child, goes in ((node.inside, near), (node.outside, ~near)):
            # leaves are numbered inside first; a point at home inside may go outside, not the other way
            reaches = goes | (d - bits <= node.radius if child is node.inside else d + bits > node.radius)
            if child is node.inside:
                reaches &= goes | ~home
            if reaches.any():
                stack.append((child, at[reaches], home[reaches] & goes[reaches]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Sets:
    """Union-find over 0..n-1, the smaller root wins."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join all pairs: the larger root of each hangs on the smallest that it meets."""
        while len(a):
            root = self.roots()
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if len(a):
                np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def linked(residents: np.ndarray, visitors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (value, smallest value of its set) of the sets that pairs within ``bits``
    link: pairs among residents, and of a resident with a visitor."""
    values = np.unique(np.concatenate([residents, visitors]))
    homes = np.unique(residents)
    if not len(homes):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    sets = Sets(len(values))
    place = np.searchsorted(values, homes)
    stack = [(grow(homes, np.arange(len(homes)), LEAF), np.arange(len(values)))]
    while stack:
        node, asking = stack.pop()
        if node.vantage is not None:
            d = bits_apart(values[asking], node.vantage)
            for child, near in ((node.inside, d - bits <= node.radius), (node.outside, d + bits > node.radius)):
                if near.any():
                    stack.append((child, asking[near]))
            continue
        for a in range(0, len(asking), 16_384):
            some = asking[a:a + 16_384]
            close = bits_apart(values[some][:, None], homes[node.points][None, :]) <= bits
            i, j = np.nonzero(close)
            x, y = some[i], place[node.points[j]]
            sets.join(x[x != y], y[x != y])
    root = sets.roots()
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]


def link(points: DataFrame, bits: int = 3, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(a, b) longs: spanning stars of all sets of distinct ``points`` (fp) linked within ``bits``."""
    spark = points.sparkSession
    total = points.count()
    some = np.sort(np.array([r.fp for r in points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64)
                   ).view(np.uint64)
    share = max(16, int(len(some) * shard / max(total, 1)))  # a leaf of the sample stands for about a shard
    tree = grow(some, np.arange(len(some)), share)
    number_leaves(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            if len(fp):
                at, leaf, home = route(tree, fp.view(np.uint64), bits)
                yield pa.RecordBatch.from_pydict({"fp": pa.array(fp[at]), "leaf": pa.array(leaf.astype(np.int64)), "home": pa.array(home)})

    dealt = written(points.select("fp").mapInArrow(deal, "fp long, leaf long, home boolean"), scratch(spark, "shards"))
    # a shard's grid: blocks of residents by blocks of visitors; a block of residents also visits every later one
    blocks = dealt.groupBy("leaf").agg(F.ceil(F.sum(F.col("home").cast("int")) / F.lit(shard)).cast("int").alias("nr"),
                                       F.greatest(F.lit(1), F.ceil(F.sum((~F.col("home")).cast("int")) / F.lit(4 * shard))).cast("int").alias("nv"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.greatest("nr", F.lit(1))).cast("int")
    third = F.pmod(F.xxhash64("fp", F.lit(11)), F.col("nv")).cast("int")
    laid = dealt.join(blocks.filter("nr > 0"), "leaf").withColumns({"own": own, "third": third})
    cells = F.when(F.col("home"), F.concat(
        F.transform(F.sequence(F.lit(0), F.col("nv") - 1), lambda v: F.struct(F.col("own").alias("r"), v.alias("v"), F.lit(True).alias("lives"))),
        F.when(F.col("own") > 0, F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda r: F.struct(
            r.alias("r"), third.alias("v"), F.lit(False).alias("lives")))).otherwise(F.array().cast("array<struct<r:int,v:int,lives:boolean>>"))
    )).otherwise(F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda r: F.struct(
        r.alias("r"), F.col("third").alias("v"), F.lit(False).alias("lives"))))
    cast = laid.select("fp", "leaf", F.explode(cells).alias("cell")).select("fp", "leaf", "cell.r", "cell.v", "cell.lives")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, lives = pdf["fp"].to_numpy().view(np.uint64), pdf["lives"].to_numpy(bool)
        a, b = linked(fp[lives], fp[~lives], bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cast.groupBy("leaf", "r", "v").applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, seed: int = 42, sample: int = SAMPLE,
                    shard: int = SHARD) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id for each row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links of at most ``bits`` bits reach, the
    row's own included.

    Cases: null and empty texts have fingerprint zero and are linked like any other; a row with
    a null ``doc_id`` links others like any row, and its component is that of the rows with an
    id (null if there is none); repeated rows are returned as often as they come; an empty
    table gives no row. Columns beside ``doc_id`` and ``text`` are not read.
    """
    spark = docs.sparkSession
    marked = written(fingerprints(docs, words, seed), scratch(spark, "fingerprints"))
    points = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), scratch(spark, "points"))
    found = written(components(link(points, bits, sample, shard)), scratch(spark, "components"))
    rooted = points.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

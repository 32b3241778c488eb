"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import scratch, written
from ledgerlens.llm.token_files import VOCABULARY, encoded

#: Bits of a sequence id below the partition's number.
BINS_A_TASK = 36


class OpenBins:
    """Bins keyed by free space: bit f of one integer is set while a bin with f free is open.

    ``place`` puts an item into the bin it fits best, which is the lowest set bit from its
    length on. Beyond ``most`` open bins the fullest closes first, the lowest set bit of all.
    """

    def __init__(self, capacity: int, most: int, first_id: int):
        self.capacity, self.most, self.next = capacity, most, first_id
        self.bits, self.open = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Sequence id and offset of an item of 1 to ``capacity`` tokens."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            found = self._take(free)
        else:
            free, found = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return found, self.capacity - free

    def still_open(self, most: int | None = None) -> set[int]:
        """The open bins; with ``most``, the fullest close first until that many are left."""
        while most is not None and self.open > most:
            self._take((self.bits & -self.bits).bit_length() - 1)
        return {x for bins in self.by_free for x in bins}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


def pack(docs: DataFrame, capacity: int = 2048, open_bins: int = 256, vocabulary: str | None = None, end: int = 0,
         merge: int = 32) -> DataFrame:
    """Place every document (ids, then ``end``) in sequences of at most ``capacity`` tokens.

    Only a longer document is cut, into pieces of ``capacity`` and a last shorter one. Each
    task packs its documents as they come with ``open_bins`` bins open. What is open at a
    task's end would be lost room, so the open bins of ``merge`` tasks at a time are packed
    again as items (at most merge * open_bins of them), repeatedly until one group is left. A
    group hands on ``open_bins`` bins at most, the emptiest, so no round holds more than the first.
    Pieces of a bin keep their order, so offsets stay gapless.

    Result: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Cases: a null text is empty, so one piece of the end id; a null ``doc_id`` is packed like
    any other; repeated rows are packed as often as they come; an empty table gives no row.
    """
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << BINS_A_TASK)
        rows: list[tuple] = []
        for ids, flat, bounds in encoded(batches, path, end):
            bytes_ = flat.astype("<u4").tobytes()
            for doc_id, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for piece, x in enumerate(range(a, b, capacity)):
                    n = min(capacity, b - x)
                    rows.append((doc_id, piece, x - a, n, zlib.crc32(bytes_[4 * x:4 * (x + n)]), *bins.place(n)))
        last = bins.still_open()
        names = PIECES.replace(",", "").split()[::2]
        for at in range(0, len(rows), 50_000):
            part = [(*r, r[5] in last) for r in rows[at:at + 50_000]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()), strict=True)], names)

    pieces = written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(fill, PIECES),
                     scratch(spark, "pieces"))

    def refill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bins = OpenBins(capacity, merge * open_bins, 0)
        pdf = pdf.sort_values(["size", "sequence_id"], ascending=[False, True])
        placed = [bins.place(int(n)) for n in pdf["size"]]
        first: dict[int, int] = {}
        for (bin_, offset), own in zip(placed, pdf["sequence_id"], strict=True):
            if not offset:
                first[bin_] = own
        last = bins.still_open(open_bins)
        return pd.DataFrame({"sequence_id": pdf["sequence_id"], "into": [first[b] for b, _ in placed],
                             "shift": [o for _, o in placed], "again": [b in last for b, _ in placed]})

    last_task = (pieces.agg(F.max("sequence_id")).first()[0] or 0) >> BINS_A_TASK
    tasks_together = 1
    while tasks_together <= last_task:
        tasks_together *= merge
        width = tasks_together << BINS_A_TASK
        bins = (pieces.filter("open").groupBy("sequence_id").agg(F.sum("length").alias("size"))
                .withColumn("group", F.expr(f"sequence_id div {width}")))
        moved = bins.groupBy("group").applyInPandas(refill, "sequence_id long, into long, shift long, again boolean")
        moved = written(moved, scratch(spark, "bins"))
        pieces = pieces.join(moved, "sequence_id", "left").select(
            "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "sequence_id").alias("sequence_id"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"), F.coalesce("again", F.lit(False)).alias("open"))
    return pieces.drop("open")

"""Substring dedup: repeated word windows, found level by level with doubled lengths.

A window is ``window`` consecutive words of one document; of equal windows all but the one
that starts first (smallest doc_id, then smallest start) lose their words.

Level 1 reads windows of half the length. Not all of them: of each full window's halves, the
one with the smallest hash stands for it (equal windows have equal halves, so the same one),
and every place where a half stands for some window counts. A half at one place in the whole
corpus stands for windows that occur once: those are done. Level 2 doubles: the windows
that a repeated half stands for are hashed in full, from the hashes of their two halves, and
compared. The doubling ends at ``window``: windows of twice that length repeat only
where all windows in them do, so longer levels remove no further word.

The documents are written once with a chunk number each, and every pass scans them where they
are. Texts are never shuffled. What tasks exchange is one packed array for each chunk and hash
bucket: the distinct hashes of the chunk there, and the verdicts back, as one file for each chunk
in the shared folder. A passage in a third of all documents is one entry a chunk.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import (WordHashes, as_bytes, dealt, groups, mix, pack_arrays, parts_for, scratch, slide, split_words,
                                   unpack_arrays, write_file, written)

#: Documents of a chunk; a chunk's distinct hashes are held by one task.
CHUNK_ROWS = 8_192
#: Bytes of text for each hash bucket, which one task compares.
BUCKET_BYTES = 32 << 20
PACKED = "bucket int, chunk long, data binary"


def chunked(docs: DataFrame, others: bool = False) -> DataFrame:
    """(doc_id, text, chunk), written once: the chunk numbers then hold for every later pass.
    ``others``: all other columns, in a struct of that name."""
    place = F.monotonically_increasing_id()
    chunk = F.shiftleft(F.shiftright(place, 33), 20) + F.shiftright(place.bitwiseAND((1 << 33) - 1), int(np.log2(CHUNK_ROWS)))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # a struct has a field at least
    more = [F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]).alias("others")] if others else []
    return written(docs.select("doc_id", "text", chunk.alias("chunk"), *more), scratch(docs.sparkSession, "chunks"))


def hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of each ``length`` consecutive words, by doubling."""
    out, done, power, size = None, 0, words, 1
    while length:
        if length & 1:
            out = power if out is None else mix(out[:max(0, len(power) - done)], power[done:done + len(out)])
            done += size
        length >>= 1
        if length:
            power = mix(power[:-size], power[size:]) if len(power) > size else power[:0]
            size *= 2
    return out


class Halves:
    """Of texts end to end: where full windows start, their standing halves, and the places of those."""

    def __init__(self, texts: list[bytes | None], cache: WordHashes, window: int):
        self.words, self.ends = split_words(texts)
        n, half = len(self.words), window // 2
        one = cache.array(self.words, n)
        self.half = hashes(one, half)
        self.window = window
        left = np.repeat(self.ends[1:], np.diff(self.ends)) - np.arange(n)
        self.full = np.flatnonzero(left >= window)
        span = window - half + 1
        lowest = slide(self.half, span, np.minimum)
        self.stands = lowest[self.full] if len(self.full) else lowest[:0]

    def places(self) -> np.ndarray:
        """Hashes of the halves, once for each place where they stand for a window."""
        span = self.window - self.window // 2 + 1
        value = np.zeros(len(self.half) + span - 1, np.uint64)
        value[self.full + span - 1] = self.stands
        highest = slide(value, span, np.maximum)  # over the windows that hold the half at this place
        return self.half[(highest == self.half) & (highest > 0)]

    def whole(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96-bit hashes of the full windows that start at ``at``."""
        half = self.window // 2
        a, b = self.half[at], self.half[at + self.window - half]
        return mix(a, b), (mix(b, a) >> np.uint64(32)).astype(np.uint32)


def merged(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    value, at = np.unique(np.concatenate(values), return_inverse=True)
    return value, np.bincount(at, np.concatenate(counts).astype(np.float64), len(value)).astype(np.int64)


def by_bucket(bucket: np.ndarray, chunk: int, arrays: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    for b, at in zip(found.tolist(), np.split(order, starts[1:])):
        yield b, chunk, pack_arrays(*(x[at] for x in arrays))


def packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, c, d = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["bucket", "chunk", "data"])


def in_batches(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += len(r[2])
        if size > 8 << 20:
            yield packed_batch(some)
            some, size = [], 0
    if some:
        yield packed_batch(some)


def chunk_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes | None], pa.RecordBatch]]:
    """(chunk, ids, texts, rows) of runs of rows (doc_id, text, chunk, ...) with one chunk."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
        chunks = batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(ids)]
        for x, y in zip(cuts, cuts[1:]):
            for a, b in groups(texts[x:y]):
                yield int(chunks[x]), ids[x + a:x + b], texts[x + a:x + b], batch.slice(x + a, b - a)


def send_back(answers: DataFrame, uri: str, dtypes: tuple[str, ...], n: int) -> None:
    """Write each chunk's arrays of all buckets as one file ``uri/chunk-<number>``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def write(chunk: int, parts: list[bytes]) -> None:
            arrays = [np.concatenate(x) for x in zip(*(unpack_arrays(p, *dtypes) for p in parts), strict=True)]
            write_file(f"{uri}/chunk-{chunk}", pack_arrays(*arrays))

        now, parts = None, []
        for batch in batches:
            for chunk, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if chunk != now and parts:
                    write(now, parts)
                    parts = []
                now = chunk
                parts.append(data)
        if parts:
            write(now, parts)
        yield packed_batch([])

    # sorted, so that a task holds one chunk's answers at a time
    answers.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(gather, PACKED).write.format("noop").mode("overwrite").save()


def answer_for(uri: str, chunk: int, dtypes: tuple[str, ...]) -> list[np.ndarray]:
    fs, path = pafs.FileSystem.from_uri(f"{uri}/chunk-{chunk}")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return [np.empty(0, t) for t in dtypes]
    with fs.open_input_file(path) as f:
        return unpack_arrays(f.read(), *dtypes)


def among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array ``some``."""
    if not len(some):
        return np.zeros(len(values), bool)
    at = np.searchsorted(some, values)
    return some[np.minimum(at, len(some) - 1)] == values


BACK = ("<u8",)
FIRST = ("<u8", "<i8", "<i8", "?")


def repeated_halves(chunks: DataFrame, uri: str, window: int, n: int) -> None:
    """Level 1: for each chunk, the standing halves that occur at two places or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        held: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for chunk, _, texts, _ in chunk_texts(batches):
            value, times = np.unique(Halves(texts, cache, window).places(), return_counts=True)
            values, counts = held[chunk]
            values.append(value)
            counts.append(times)
            if len(values) > 16:
                value, times = merged(values, counts)
                held[chunk] = [value], [times]
        for chunk, (values, counts) in held.items():
            value, times = merged(values, counts)
            yield from in_batches(by_bucket((value % np.uint64(n)).astype(np.int64), chunk, [value, np.minimum(times, 2).astype(np.uint8)]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(c, *unpack_arrays(d, "<u8", "u1")) for batch in batches
                for c, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        if not rows:
            return
        value, times = merged([r[1] for r in rows], [r[2] for r in rows])
        again = value[times > 1]
        yield from in_batches((0, c, pack_arrays(v[kept])) for c, v, _ in rows if (kept := among(v, again)).any())

    found = dealt(chunks.mapInArrow(count, PACKED), n, "bucket").mapInArrow(compare, PACKED)
    send_back(found, uri, BACK, n)


def first_windows(chunks: DataFrame, halves: str, uri: str, window: int, n: int) -> None:
    """Level 2: for each chunk, the hashes of its windows that occur again, whether the first of
    all is in this chunk, and that one's doc_id and start."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        held: dict[int, list] = defaultdict(list)
        known: dict[int, np.ndarray] = {}

        def squeeze(parts: list) -> list:
            a, b, doc, start, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, doc, b, a))
            a, b, doc, start, times = (x[order] for x in (a, b, doc, start, times))
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            return [(a[new], b[new], doc[new], start[new], np.minimum(np.add.reduceat(times, new), 2))]

        for chunk, ids, texts, _ in chunk_texts(batches):
            if chunk not in known:
                known = {chunk: np.sort(answer_for(halves, chunk, BACK)[0])}
            text = Halves(texts, cache, window)
            at = text.full[among(text.stands, known[chunk])]
            if len(at):
                a, b = text.whole(at)
                doc = np.searchsorted(text.ends, at, side="right") - 1
                own = np.array([-1 if i is None else i for i in ids], np.int64)
                named = np.array([i is not None for i in ids])[doc]
                a, b, doc, at = a[named], b[named], doc[named], at[named]
                held[chunk].append((a, b, own[doc], at - text.ends[doc], np.ones(len(a), np.int64)))
                if len(held[chunk]) > 8:
                    held[chunk] = squeeze(held[chunk])
        for chunk, parts in held.items():
            if sum(len(p[0]) for p in parts):
                a, b, doc, start, times = squeeze(parts)[0]
                order = np.lexsort((start, doc))
                a, b, doc, start, times = (x[order] for x in (a, b, doc, start, times))
                yield from in_batches(by_bucket((a % np.uint64(n)).astype(np.int64), chunk, [
                    a, b, doc, start, times.astype(np.uint8)]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(c, unpack_arrays(d, "<u8", "<u4", "<i8", "<i8", "u1")) for batch in batches
                for c, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        if not rows:
            return
        lengths = [len(r[1][0]) for r in rows]
        a, b, doc, start, times = (np.concatenate(x) for x in zip(*(r[1] for r in rows), strict=True))
        source = np.repeat(np.arange(len(rows)), lengths)
        order = np.lexsort((start, doc, b, a))
        sa, sb = a[order], b[order]
        new = np.flatnonzero(np.r_[True, (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])])
        group = np.empty(len(a), np.int64)
        group[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(a)]))
        again = np.add.reduceat(times[order].astype(np.int64), new) > 1
        first_doc, first_start = doc[order][new][group], start[order][new][group]
        here = (doc == first_doc) & (start == first_start)
        sent = np.flatnonzero(again[group])
        cuts = np.searchsorted(source[sent], np.arange(len(rows) + 1))

        def out() -> Iterator[tuple[int, int, bytes]]:
            for i, (chunk, _) in enumerate(rows):
                own = sent[cuts[i]:cuts[i + 1]]
                if len(own):
                    mine = here[own]
                    yield 0, chunk, pack_arrays(a[own], np.where(mine, first_doc[own], 0), np.where(mine, first_start[own], 0), mine)

        yield from in_batches(out())

    found = dealt(chunks.mapInArrow(candidates, PACKED), n, "bucket").mapInArrow(compare, PACKED)
    send_back(found, uri, FIRST, n)


def lost_words(batches: Iterator[pa.RecordBatch], first: str, window: int) -> Iterator[tuple[pa.RecordBatch, list, list[tuple[list[bytes], np.ndarray]]]]:
    """(rows, ids, words of each row and whether each is lost) of chunked rows, by the first windows stored at ``first``."""
    cache = WordHashes()
    known: dict[int, list[np.ndarray]] = {}
    for chunk, ids, texts, rows in chunk_texts(batches):
        if chunk not in known:
            own = answer_for(first, chunk, FIRST)
            order = np.argsort(own[0], kind="stable")
            own = [x[order] for x in own]
            # a chunk read by two tasks has sent a hash twice: one entry is left, the first's if it is here
            if len(own[0]):
                new = np.flatnonzero(np.r_[True, own[0][1:] != own[0][:-1]])
                least = np.lexsort((~own[3], own[0]))
                own = [x[least][new] for x in own]
            known = {chunk: own}
        hash_, doc_, start_, here_ = known[chunk]
        text = Halves(texts, cache, window)
        removed = np.zeros(len(text.words) + 1, np.int64)
        if len(hash_) and len(text.full):
            a, _ = text.whole(text.full)
            hit = among(a, hash_)
            at, a = text.full[hit], a[hit]
            doc = np.searchsorted(text.ends, at, side="right") - 1
            named = np.array([i is not None for i in ids])[doc]
            at, a, doc = at[named], a[named], doc[named]
            entry = np.searchsorted(hash_, a)
            own = np.array([-1 if i is None else i for i in ids], np.int64)[doc]
            stays = here_[entry] & (doc_[entry] == own) & (start_[entry] == at - text.ends[doc])
            gone = at[~stays]
            np.add.at(removed, gone, 1)
            np.add.at(removed, gone + window, -1)
        lost = np.cumsum(removed[:-1]) > 0
        yield rows, ids, [(text.words[x:y], lost[x:y]) for x, y in zip(text.ends[:-1].tolist(), text.ends[1:].tolist())]


def judged_windows(docs: DataFrame, window: int, others: bool = False) -> tuple[DataFrame, str]:
    """Chunked documents, and where the first place of each of their repeated windows is stored."""
    if window < 2 or window % 2:
        raise ValueError("window is an even number of words")
    spark = docs.sparkSession
    chunks = chunked(docs, others)
    bare = chunks.select("doc_id", "text", "chunk")
    n = parts_for(bare, BUCKET_BYTES)
    halves, first = scratch(spark, "halves"), scratch(spark, "windows")
    repeated_halves(bare, halves, window, n)
    first_windows(bare, halves, first, window, n)
    return chunks, first


def dedup_substrings(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text, spans for each row of ``docs``.

    ``kept_text`` has the kept words joined by one space, ``spans`` the removed runs of words
    as (start, end) word numbers, ``kept_sha256`` is of ``kept_text``.

    Cases: a null or empty text has no words, and its kept text is empty; a text of fewer
    words than a window keeps all; rows of one doc_id and one text start at the same
    places, so neither is earlier and both are kept; a row with a null doc_id has no place in
    the order: its windows remove nothing elsewhere, and it keeps all its words; an empty
    table gives no row. Columns beside ``doc_id`` and ``text`` are not read.
    """
    chunks, first = judged_windows(docs, window)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts in lost_words(batches, first, window):
            out = []
            for doc_id, (words, lost) in zip(ids, texts, strict=True):
                n, spans = len(words), []
                if lost.any():
                    words = [w for w, cut in zip(words, lost.tolist()) if not cut]
                    edge = np.flatnonzero(np.diff(np.r_[0, lost.astype(np.int8), 0]))
                    spans = [{"start": int(p), "end": int(q)} for p, q in zip(edge[::2], edge[1::2])]
                kept = b" ".join(words)
                out.append((doc_id, n, int(lost.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), spans))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(
                    pa.struct([("start", pa.int32()), ("end", pa.int32())]))), strict=True)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"])

    return chunks.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, "
                                     "spans array<struct<start:int,end:int>>")


def cut_repeats(docs: DataFrame, window: int = 20, length: str = "n_chars") -> DataFrame:
    """``docs``, all rows and columns, with the words that :func:`dedup_substrings` removes cut out: a text
    that loses words becomes its kept words joined by one space, and column ``length``, if there is one, its number
    of characters; the others stay as they are. Each row is cut where it stands, by its own text."""
    chunks, first = judged_windows(docs, window, others=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, texts in lost_words(batches, first, window):
            kept = [b" ".join([w for w, gone in zip(words, lost.tolist()) if not gone]).decode() if lost.any() else None for words, lost in texts]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(kept, pa.string())], [*rows.schema.names, "kept"])

    done = chunks.mapInArrow(cut, T.StructType([*chunks.schema.fields, T.StructField("kept", T.StringType())]))
    text = F.coalesce("kept", "text")
    out = []
    for field in docs.schema:
        own = F.col(field.name) if field.name == "doc_id" else text if field.name == "text" else F.col("others").getField(field.name)
        if field.name == length and length not in ("doc_id", "text"):
            own = F.when(F.col("kept").isNotNull(), F.length("kept").cast(field.dataType)).otherwise(own)
        out.append(own.alias(field.name))
    return done.select(*out)

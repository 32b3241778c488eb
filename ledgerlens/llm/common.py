"""Helpers shared by the operators: scratch folders, shared files, batches of texts."""

from __future__ import annotations

import os
import posixpath
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from ledgerlens.session import ensure_checkpoint_dir

#: Bytes of text that a task turns into arrays at a time; a longer text is one batch of its own.
BATCH_BYTES = 4 << 20
#: Entries of a worker's word caches; a full cache is emptied, which changes no result.
CACHE_WORDS = 400_000
PLAIN = re.compile(r"[\W_]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the cluster's shared ``spark.checkpoint.dir``."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:") and not base.startswith("file://"):
        base = "file://" + base[len("file:"):]
    elif "://" not in base:
        base = "file://" + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(docs: DataFrame, part_bytes: int) -> int:
    """Partitions that hold about ``part_bytes`` of text each, the session's number at least: the
    input's size sets what a task holds, whatever the session's setting."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // part_bytes))


def written(df: DataFrame, uri: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: cuts the lineage, survives lost executors."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def rows_kept(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` with the rows that ``run`` keeps of its batches; columns keep their places, and any names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


#: Rows of a chunk, as a power of two: the lost rows of one are a file, and held together.
CHUNK_BITS = 13


def without_rows(rows: DataFrame, row: str, lost: DataFrame) -> DataFrame:
    """``rows`` (a stored table) without those whose number, a long in column ``row``, is in column ``row`` of ``lost``;
    ``row`` is dropped. Rows are judged where they stand: what is shuffled is the numbers, which go to one
    file for each chunk of rows, and each task reads the files of its chunks."""
    spark = rows.sparkSession
    uri, names = scratch(spark, "lost-rows"), [c for c in rows.columns if c != row]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            chunk = number >> CHUNK_BITS
            for part in np.split(np.arange(len(number)), np.flatnonzero(np.diff(chunk)) + 1) if len(number) else []:
                if chunk[part[0]] != now:
                    if parts:
                        write_file(f"{uri}/chunk-{now}", np.concatenate(parts).astype("<i8"))
                    now, parts = int(chunk[part[0]]), []
                parts.append(number[part])
        if parts:
            write_file(f"{uri}/chunk-{now}", np.concatenate(parts).astype("<i8"))
        yield pa.RecordBatch.from_pydict({"n": pa.array([0], pa.int64())})

    numbers = lost.select(F.col(row).alias("row"), F.shiftright(row, CHUNK_BITS).alias("chunk"))
    dealt_out = numbers.repartition(shuffle_partitions(spark), "chunk").sortWithinPartitions("chunk", "row").select("row")
    dealt_out.mapInArrow(store, "n long").write.format("noop").mode("overwrite").save()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            number = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            chunks = number >> CHUNK_BITS
            gone = np.zeros(len(number), bool)
            for c in np.unique(chunks).tolist():
                if c not in known:
                    known = {c: np.array(map_file(f"{uri}/chunk-{c}", "<i8"))}
                gone |= (chunks == c) & np.isin(number, known[c])
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(~gone))

    plain = rows.select(*[F.col(f"`{c}`") for c in names], row).toDF(*[f"c{i}" for i in range(len(names))], "row")
    return plain.mapInArrow(run, StructType(plain.schema.fields[:-1])).toDF(*names)


def id_crc(col: str = "doc_id") -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))


def fold(col: str, modulus: int, held: int) -> Column:
    """Whether a row belongs to the held-out fold; false for a null id."""
    return F.coalesce(id_crc(col) % modulus == held, F.lit(False))


# ---------------------------------------------------------------- files in the shared folder

def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, *parts: bytes | np.ndarray) -> None:
    """Write a whole file under a temporary name and rename it, so a retried
    or doubled task leaves one complete file."""
    fs, path = _open_fs(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp) as out:
        for part in parts:
            out.write(part.tobytes() if isinstance(part, np.ndarray) else part)
    fs.move(temp, path)


def map_file(uri: str, dtype: str) -> np.ndarray:
    """A file's values, memory-mapped where the shared folder is mounted, else read."""
    fs, path = _open_fs(uri)
    size = fs.get_file_info(path).size
    if not size:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem) and os.path.exists(path):
        return np.memmap(path, dtype=dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


# ---------------------------------------------------------------- texts and words in tasks

def as_bytes(col: pa.Array) -> list[bytes | None]:
    return col.cast(pa.large_binary()).to_pylist() if col.type != pa.binary() else col.to_pylist()


def groups(texts: list[bytes | None], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together (one text at least)."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


class WordHashes(dict):
    """Word bytes to a 64-bit hash, computed once for each distinct word."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxh64_intdigest(word, self.seed)
        return value

    def array(self, words: Iterable[bytes], count: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, count)


def known(words: list[bytes], index: dict[bytes, int], learn: Callable[[list[bytes]], None]) -> np.ndarray:
    """Each word's number in ``index``; ``learn`` is given the distinct words that are not in it, and adds them."""
    at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
    fresh = np.flatnonzero(at < 0).tolist()
    if fresh:
        some = [words[i] for i in fresh]
        learn(list(dict.fromkeys(some)))
        at[fresh] = np.fromiter(map(index.__getitem__, some), np.int64, len(some))
    return at


def split_words(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, end to end, and the bounds of
    each text's words (one more than texts). ``bytes.split`` cuts at exactly those."""
    words: list[bytes] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        if text:
            words += text.split()
        ends[i + 1] = len(words)
    return words, ends


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Combine two arrays of 64-bit hashes, order mattering."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(31)
    return x


def gram_buckets(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of each word (itself first, then its character n-grams with marked ends) end to end, and bounds."""
    plain = [("<" + PLAIN.sub("", w.decode("utf-8", "replace").lower()) + ">").encode("utf-32-le") for w in words]
    size = np.array([len(p) // 4 for p in plain], np.int64)
    code = np.frombuffer(b"".join(plain), "<u4").astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(size)])
    n = len(code)
    left = np.repeat(starts[1:], size) - np.arange(n)
    word = np.repeat(np.arange(len(words)), size)
    rolled = np.zeros(n, np.uint64)
    whole = np.zeros(len(words), np.uint64)
    parts, owners = [], []
    for k in range(1, max(sizes) + 1):
        shifted = np.r_[code[k - 1:], np.zeros(min(n, k - 1), np.uint64)][:n]
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(1)
        if k in sizes:
            inside = left >= k
            parts.append(rolled[inside] ^ np.uint64(k))
            owners.append(word[inside])
    if n:
        place = np.arange(n) - np.repeat(starts[:-1], size)
        powers = np.cumprod(np.full(int(size.max()) + 1, 0xD6E8FEB86659FD93, np.uint64))
        whole = np.add.reduceat((code + np.uint64(7)) * powers[place], starts[:-1])
    keys = np.concatenate([whole, *parts])
    owner = np.concatenate([np.arange(len(words)), *owners])
    keys ^= keys >> np.uint64(31)
    keys *= np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(owner, kind="stable")
    return ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def slide(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` over each ``width`` consecutive values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = op(x[:-done], x[done:]) if len(x) > done else x[:0]
        done *= 2
    if done < width:
        rest = width - done
        x = op(x[:-rest], x[rest:]) if len(x) > rest else x[:0]
    return x


# ---------------------------------------------------------------- packed arrays between tasks

def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes, each compressed by itself."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = [squeeze(np.ascontiguousarray(a).tobytes()) for a in arrays]
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def unpack_arrays(data: bytes, *dtypes: str) -> list[np.ndarray]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    out, at = [], 4 * len(dtypes)
    for n, dtype in zip(np.frombuffer(data, "<u4", len(dtypes)).tolist(), dtypes, strict=True):
        out.append(np.frombuffer(expand(data[at:at + n]), dtype))
        at += n
    return out


def dealt(df: DataFrame, n: int, to: str) -> DataFrame:
    """Rows whose ``to`` is p, of 0 to n-1, to partition p."""
    return df.repartitionById(n, F.col(to).cast("int"))

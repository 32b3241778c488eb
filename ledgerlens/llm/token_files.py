"""Token ids of whole texts, flat binary files of them, and the public tokenizer in tasks."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import as_bytes, groups, known, map_file, parts_for, scratch, shuffle_partitions, split_words, write_file, written

VOCABULARY = "word_bpe_49k.json"


#: Words of these characters (but for the special tokens' brackets) are cut into the file's pieces
#: here: lower case and composition act on each of them alone. The file's pattern on them.
PLAIN_WORD = re.compile(r"(?!.*<\|)[!-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The byte-level alphabet above ASCII: bytes that do not print stand at 256 and up, after the 34 lower ones.
ABOVE = np.arange(256, dtype="<u4")
ABOVE[[*range(0x80, 0xA1), 0xAD]] = 290 + np.arange(34)
CACHED = 800_000


class WordTokenizer:
    """Ids of whole texts from a tokenizer whose pieces never cross white space.

    ``word_bpe_49k.json`` turns runs of white space into one space, which it then drops, and
    its other steps look at one character or one word. So a text's ids are its words' ids end
    to end, and each distinct word is encoded once. Words of plain characters go through the
    file's own merges many at a time, already cut into pieces; any other word goes through the
    whole tokenizer by itself. ``cache``: words kept; a full cache is emptied between batches.
    """

    def __init__(self, path: str, cache: int = CACHED):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.merges = Tokenizer.from_str(json.dumps(file | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        vocabulary = file["model"]["vocab"]
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.size = self.encoder.get_vocab_size()
        self.most = cache
        self._reset()

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for a in range(0, len(words), 2_000) for e in self.encoder.encode_batch_fast(words[a:a + 2_000], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for ids in found for x in ids), np.uint32, int(lengths.sum())), lengths

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [PIECE.findall(w.lower()) for w in words]
        text = " ".join([p for pieces in cut for p in pieces])
        if not text.isascii():
            text = ABOVE[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        pieces = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        if len(ends) != pieces[-1] or ends[-1] != len(ids):  # not as this file's merges do it
            return self._whole(words)
        return ids, np.diff(ends[pieces - 1], prepend=0)

    def _learn(self, words: list[bytes]) -> None:
        for a in range(0, len(words), 4_000):
            some = {w: w.decode("utf-8", "replace") for w in words[a:a + 4_000]}
            plain = {w: t for w, t in some.items() if PLAIN_WORD.fullmatch(t)}
            rest = {w: t for w, t in some.items() if w not in plain}
            for part, how in ((plain, self._plain), (rest, self._whole)):
                if part:
                    ids, lengths = how(list(part.values()))
                    base = len(self.index)
                    self.index.update((w, base + i) for i, w in enumerate(part))
                    self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
                    self.lengths, self.flat = np.concatenate([self.lengths, lengths]), np.concatenate([self.flat, ids])

    def encode(self, texts: list[bytes | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text's followed by ``end``; the bounds of each text."""
        words, ends = split_words(texts)
        if len(self.index) > self.most:
            self._reset()
        at = known(words, self.index, self._learn)
        lengths = self.lengths[at]
        before = np.concatenate([[0], np.cumsum(lengths)])
        doc = np.repeat(np.arange(len(texts)), np.diff(ends))  # each earlier text has put one end id before
        places = np.repeat(self.starts[at] - before[:-1], lengths) + np.arange(before[-1])
        out = np.full(before[-1] + len(texts), end, np.uint32)
        out[np.arange(before[-1]) + np.repeat(doc, lengths)] = self.flat[places]
        return out, before[ends] + np.arange(len(texts) + 1)


_KEPT: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file; it keeps its words from task to task."""
    if path not in _KEPT:
        _KEPT[path] = WordTokenizer(path)
    return _KEPT[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Of rows (doc_id, text): ids of some documents, their tokens end to end, and bounds."""
    tokenizer = tokenizer_at(path)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
        for a, b in groups(texts):
            yield ids[a:b], *tokenizer.encode(texts[a:b], end)


#: Bytes of text for each part, whose ids one task holds.
PART_BYTES = 64 << 20
MANIFEST = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n_docs", T.LongType()),
                         T.StructField("n_tokens", T.LongType())])


def write_token_files(docs: DataFrame, out_uri: str, vocabulary: str | None = None, end: int = 2,
                      partitions: int | None = None) -> DataFrame:
    """Write every text's ids, documents in ascending ``doc_id`` order, and return the manifest.

    Format, for each part p: ``ids-p.bin``, unsigned little-endian ids, nothing else, of 16 bits if
    the vocabulary has at most 65,536 of them and 32 otherwise (the manifest's ``bits`` says which);
    ``docs-p.bin``, signed 64-bit doc ids; ``offsets-p.bin``, unsigned 64-bit offsets into the
    ids of all parts together, one more than documents, so the last is the next part's first.
    The offsets' bases are prefix sums over the parts' token counts. Parts are ranges of
    ``(doc_id, hash of the text)``, so many rows of one id can be split.

    Cases: a null text is empty and has the end id only; a null ``doc_id`` is not written (it
    has no place in the order); repeated rows are written as often as they come, equal ids in
    the order of their texts' hashes; an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    n = partitions or parts_for(docs, PART_BYTES)
    bits = 16 if tokenizer_at(path).size <= 1 << 16 else 32
    width = f"<u{bits // 8}"

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, tokens, ends = TaskContext.get().partitionId(), [], [], [np.zeros(1, np.int64)]
        for doc_ids, flat, bounds in encoded(batches, path, end):
            ids += doc_ids
            tokens.append(flat.astype(width))
            ends.append(ends[-1][-1] + bounds[1:])
        total = int(ends[-1][-1])
        if ids:
            write_file(f"{out_uri}/ids-{part:05d}.bin", *tokens)
            write_file(f"{out_uri}/docs-{part:05d}.bin", np.array(ids, "<i8"))
            write_file(f"{out_uri}/local-{part:05d}.bin", np.concatenate(ends).astype("<u8"))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [len(ids)], "n_tokens": [total]})

    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
            .withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie"))
    parts = written(rows.select("doc_id", "text").mapInArrow(tokenise, MANIFEST), f"{out_uri}/manifest")

    # prefix sums over one row a part: (part, tokens) only, as many as tasks
    based, base = [], 0
    for r in sorted(parts.collect()):
        based.append((r.part, base, r.n_docs, bits))
        base += r.n_tokens
    schema = "part int, base long, n_docs long, bits int"

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                local = map_file(f"{out_uri}/local-{part:05d}.bin", "<u8")
                write_file(f"{out_uri}/offsets-{part:05d}.bin", local + np.uint64(base))
            yield batch

    manifest = spark.createDataFrame(based, schema)
    return written(manifest.repartition(max(1, min(n, len(based)))).mapInArrow(offsets, schema), f"{out_uri}/index")


def read_token_files(manifest: DataFrame, out_uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the memory-mapped files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, bits in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                ids = map_file(f"{out_uri}/ids-{part:05d}.bin", f"<u{bits // 8}")
                docs = map_file(f"{out_uri}/docs-{part:05d}.bin", "<i8")
                offsets = map_file(f"{out_uri}/offsets-{part:05d}.bin", "<u8").astype(np.int64)
                for a in range(0, len(docs), 10_000):
                    cut = offsets[a:a + 10_001]
                    sums = [zlib.crc32(ids[x - base:y - base].astype("<u4").tobytes()) for x, y in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs[a:a + 10_000], pa.int64()), "start": cut[:-1],
                                                      "n_tokens": np.diff(cut), "ids_crc32": pa.array(sums, pa.int64())})

    n = shuffle_partitions(manifest.sparkSession)
    return manifest.repartition(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str | None = None, end: int = 2) -> DataFrame:
    """Write into a new folder of the shared scratch space and read back."""
    out = scratch(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, out, vocabulary, end), out)

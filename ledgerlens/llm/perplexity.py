"""Quality rules, and rejection by the perplexity of a character n-gram model.

Model: modified Kneser-Ney over the ``ORDER`` last characters, one model for each language. Spark
counts the n-grams of all documents that pass the base rules; counts of lower orders are continuation counts (how many
characters stand before), three discounts for each order come from the counts of counts, and each
order is interpolated with the one below, all as DataFrame joins. N-grams that occur once are left
to the order below: a document must not be likely for what only it holds. The finished
probabilities and back-off weights are written as sorted arrays of 64-bit n-gram hashes beside their logarithms, in files that each hold a
range of hashes, at most about ``SHARD`` of them. Scoring tasks map the files they need and look up
each batch's distinct n-grams by binary search, so memory does not grow with the model.

Verdict: a document whose log perplexity lies outside its language's band is rejected. A band
reaches from the median of the language's documents that pass the base rules ``fence`` times the distance
of the nearer quartile (a quarter of the farther one's at least) to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerlens.llm.common import WordHashes, as_bytes, dealt, groups, map_file, mix, scratch, split_words, write_file, written

ORDER = 4
SHARD = 2_000_000
#: Stands before a text's first character.
START = 2
#: N-grams whose probability a scoring task keeps; a full store is emptied, which changes no result.
KEPT = 400_000
#: Bytes of text that a counting task sorts at a time.
SORTED_BYTES = 2 << 20
#: Log probability of a character in a language that the model lacks.
UNSEEN = -14.0
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SYMBOLS = "#*$%&|<>"


def texts_of(chars: np.ndarray) -> list[str]:
    """Rows of ``ORDER`` code points as strings."""
    text = chars.astype("<u4").tobytes().decode("utf-32-le", "replace")
    return [text[i:i + ORDER] for i in range(0, len(text), ORDER)]


class Characters:
    """Texts' code points end to end, each text after ``ORDER - 1`` start marks."""

    def __init__(self, texts: list[bytes | None], langs: list[str]):
        parts = [t.decode("utf-8", "replace").encode("utf-32-le") if t else b"" for t in texts]
        lead = np.full(ORDER - 1, START, "<u4").tobytes()
        self.code = np.frombuffer(b"".join(x for p in parts for x in (lead, p)), "<u4")
        size = np.array([len(p) // 4 for p in parts], np.int64)
        self.size = size
        starts = np.cumsum(size + ORDER - 1) - size
        self.bounds = np.concatenate([[0], np.cumsum(size)])
        self.at = np.arange(size.sum()) + np.repeat(starts - self.bounds[:-1], size)  # of real characters
        self.langs, of = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True) if langs else (np.empty(0, str), np.empty(0, int))
        self.lang = np.repeat(of, size)

    def keys(self) -> tuple[np.ndarray, np.ndarray, int]:
        """A number for each character's n-gram and language, the alphabet, and the bits that a
        character has in the numbers (0: they do not fit, and the numbers are ranks)."""
        there = np.zeros(int(self.code.max()) + 1, np.int64)
        there[self.code] = 1
        alphabet = np.flatnonzero(there)
        number = (np.cumsum(there) - 1)[self.code].astype(np.uint64)
        bits = max(1, int(len(alphabet) - 1).bit_length())
        lang_bits = max(1, int(len(self.langs) - 1).bit_length())
        key = self.lang.astype(np.uint64)
        if ORDER * bits + lang_bits <= 64:
            for k in range(ORDER):
                key = (key << np.uint64(bits)) | number[self.at - (ORDER - 1 - k)]
            return key, alphabet, bits
        for k in range(ORDER):  # many characters: rank pair after pair
            key = np.unique(key * np.uint64(len(alphabet)) + number[self.at - (ORDER - 1 - k)], return_inverse=True)[1].astype(np.uint64)
        return key, alphabet, 0

    def counted(self) -> tuple[list[str], list[str], np.ndarray]:
        """Language and text of the distinct n-grams, and their counts."""
        if not len(self.at):
            return [], [], np.empty(0, np.int64)
        key, alphabet, bits = self.keys()
        if not bits:
            return self.distinct()[:3]
        key.sort()
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts, key = np.diff(np.r_[new, len(key)]), key[new]
        mask = np.uint64((1 << bits) - 1)
        chars = np.stack([alphabet[(key >> np.uint64(bits * k)) & mask] for k in range(ORDER - 1, -1, -1)], axis=1)
        return self.langs[(key >> np.uint64(bits * ORDER)).astype(np.int64)].tolist(), texts_of(chars), counts

    def distinct(self) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
        """Language and text of the distinct n-grams, their counts, and each character's n-gram's number."""
        if not len(self.at):
            return [], [], np.empty(0, np.int64), np.empty(0, np.int64)
        key, _, _ = self.keys()
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[new, len(key)])
        of = np.empty(len(key), np.int64)
        of[order] = np.repeat(np.arange(len(new)), counts)
        first = order[new]
        chars = self.code[self.at[first][:, None] + np.arange(1 - ORDER, 1)[None, :]]
        return self.langs[self.lang[first]].tolist(), texts_of(chars), counts, of


def lang_of() -> F.Column:
    return F.coalesce("lang", F.lit("und")).alias("lang")


def count_grams(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """(lang, gram, c): each n-gram of ``ORDER`` characters of the texts that pass the base rules, and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts, langs = as_bytes(batch.column(1)), batch.column(0).to_pylist()
            for a, b in groups(texts, SORTED_BYTES):
                size, repeated = repeats(*split_words(texts[a:b]), hashes)
                good = [None if bad else t for t, bad in zip(texts[a:b], fails(size, repeated, least_words).tolist())]
                lang, grams, counts = Characters(good, langs[a:b]).counted()
                yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "gram": pa.array(grams, pa.string()), "n": pa.array(counts, pa.int64())})

    rows = docs.filter("text is not null").select(lang_of(), "text").mapInArrow(run, "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("c"))


GRAM, CONTEXT = "g", "c"


def kneser_ney(counted: DataFrame, uri: str) -> DataFrame:
    """(lang, key, log): for each n-gram of 1 to ``ORDER`` characters that occurs twice, key
    ``g`` + n-gram, the probability of its last character after the others; for each context,
    key ``c`` + context, the weight of the order below, at the empty context that of one unknown character.
    Each order's counts and probabilities are written once, below ``uri``.
    """
    levels = {ORDER: counted.select("lang", "gram", "c", F.col("c").alias("n"))}
    for k in range(ORDER - 1, 0, -1):
        fewer = levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c"), F.sum("n").alias("n"))
        levels[k] = written(fewer, f"{uri}/counts-{k}")
    out, below = [], None
    for k in range(1, ORDER + 1):
        level = levels[k]
        several = level.groupBy("lang").agg(*(F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)),
                                            F.count("*").alias("v"))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        # a discount that the counts cannot give (too few n-grams) is 0.5, and none leaves its range
        discount = [F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.coalesce(i - (i + 1) * y * F.try_divide(f"n{i + 1}", f"n{i}"), F.lit(0.5)))).alias(f"d{i}")
                    for i in (1, 2, 3)]
        lost = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        stays = F.lit(True) if k == 1 else F.col("n") > 1
        # one row a language: the names of languages, some thousands at most
        rows = (level.join(F.broadcast(several.select("lang", "v", *discount)), "lang")
                .select("lang", "gram", F.substring("gram", 1, k - 1).alias("context"), "c", "v", stays.alias("stays"),
                        F.greatest(F.col("c") - lost, F.lit(0.0)).alias("mass")))
        totals = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum(F.when(F.col("stays"), F.col("mass")).otherwise(0.0)).alias("held"),
                                                     F.max("v").alias("v"))
        totals = totals.select("lang", "context", "total", (F.greatest(F.lit(1e-9), 1 - F.col("held") / F.col("total")) / (F.col("v") if k == 1 else 1)).alias("left"))
        found = rows.filter("stays").join(totals, ["lang", "context"]).select("lang", "gram", (F.col("mass") / F.col("total")).alias("own"), "left")
        if below is None:
            below = found.select("lang", "gram", (F.col("own") + F.col("left")).alias("p"))
        else:
            lower = below.select("lang", F.col("gram").alias("ending"), F.col("p").alias("q"))
            below = (found.withColumn("ending", F.substring("gram", 2, k - 1)).join(lower, ["lang", "ending"])
                     .select("lang", "gram", (F.col("own") + F.col("left") * F.col("q")).alias("p")))
        below = written(below, f"{uri}/chances-{k}")
        out.append(below.select("lang", F.concat(F.lit(GRAM), "gram").alias("key"), F.log("p").cast("float").alias("log")))
        out.append(totals.filter("left < 1").select("lang", F.concat(F.lit(CONTEXT), "context").alias("key"), F.log("left").cast("float").alias("log")))
    return reduce(DataFrame.unionByName, out)


def key_hash(lang: str, key: str) -> int:
    return xxh64_intdigest(f"{lang}\x00{key}".encode(), 42)


def write_model(model: DataFrame, uri: str) -> int:
    """Write the sorted hash arrays: file s holds the hashes whose upper 32 bits, times files, over 2^32 is s."""
    n = max(1, -(-model.count() // SHARD))
    hashed = F.xxhash64(F.concat("lang", F.lit("\x00"), "key"))
    rows = model.select(hashed.alias("hash"), "log", F.shiftright(F.shiftrightunsigned(hashed, 32) * n, 32).cast("int").alias("shard"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = [np.empty(0, np.uint64)], [np.empty(0, np.float32)]
        for batch in batches:
            keys.append(batch.column(0).to_numpy().view(np.uint64))
            logs.append(batch.column(1).to_numpy())
        key, log = np.concatenate(keys), np.concatenate(logs)
        order = np.argsort(key, kind="stable")
        shard = TaskContext.get().partitionId()
        write_file(f"{uri}/keys-{shard}", key[order].astype("<u8"))
        write_file(f"{uri}/logs-{shard}", log[order].astype("<f4"))
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(key)], pa.int64())})

    dealt(rows, n, "shard").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
    return n


class Model:
    """Look-ups in the written arrays; ``held`` files stay mapped."""

    def __init__(self, uri: str, shards: int, held: int = 8):
        self.uri, self.shards, self.held = uri, shards, held
        self.files: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _file(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        if shard not in self.files:
            if len(self.files) >= self.held:
                self.files.pop(next(iter(self.files)))
            self.files[shard] = map_file(f"{self.uri}/keys-{shard}", "<u8"), map_file(f"{self.uri}/logs-{shard}", "<f4")
        return self.files[shard]

    def stored(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        """The logarithms of (lang, key), nan where there is none."""
        key = np.fromiter((key_hash(*p) for p in pairs), np.uint64, len(pairs))
        out = np.full(len(key), np.nan)
        order = np.argsort(key)
        shard = ((key[order] >> np.uint64(32)) * np.uint64(self.shards)) >> np.uint64(32)
        new = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(key) else np.empty(0, np.int64)
        for a, b in zip(new, np.r_[new[1:], len(key)]):
            keys, logs = self._file(int(shard[a]))
            at = order[a:b]
            if len(keys):
                place = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
                hit = keys[place] == key[at]
                out[at[hit]] = logs[place[hit]]
        return out

    def logs(self, grams: list[tuple[str, str]]) -> np.ndarray:
        """Log probability of the last character of each (lang, gram): the longest stored ending's,
        and the weights of the contexts above it."""
        out, weight = np.full(len(grams), UNSEEN), np.zeros(len(grams))
        rest = np.arange(len(grams))
        for k in range(ORDER, 0, -1):
            own = [(grams[i][0], grams[i][1][ORDER - k:]) for i in rest.tolist()]
            found = self.stored([(lang, GRAM + g) for lang, g in own])
            hit = ~np.isnan(found)
            out[rest[hit]] = weight[rest[hit]] + found[hit]
            rest = rest[~hit]
            if not len(rest):
                break
            less = self.stored([(lang, CONTEXT + g[:-1]) for (lang, g), h in zip(own, hit.tolist()) if not h])
            if k == 1:  # a character that the language lacks
                out[rest] = np.where(np.isnan(less), UNSEEN, weight[rest] + less)
            weight[rest] += np.nan_to_num(less)
        return out


def repeats(words: list[bytes], ends: np.ndarray, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """n_words and n_repeat_words of texts cut into words."""
    n, size = len(words), np.diff(ends)
    repeated = np.zeros(n + 1, np.int64)
    if n >= 3:
        one = hashes.array(words, n)
        key = mix(mix(mix(one[:-2], one[1:-1]), one[2:]), np.repeat(np.arange(len(size)), size)[:-2].astype(np.uint64))
        left = np.repeat(ends[1:], size) - np.arange(n)
        at = np.flatnonzero(left[:-2] >= 3)
        order = at[np.argsort(key[at])]
        same = key[order][1:] == key[order][:-1]
        again = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
        np.add.at(repeated, again, 1)
        np.add.at(repeated, again + 3, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(repeated[:n]) > 0)])
    return size, np.diff(covered[ends])


def fails(n_words, n_repeat_words, least_words: int):
    """The base rules, on arrays or columns."""
    return (n_words < least_words) | (100 * n_repeat_words > 50 * n_words)


def base_rules(texts: list[bytes | None], text: Characters, hashes: WordHashes) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    size, repeated = repeats(*split_words(texts), hashes)
    code = text.code[text.at]
    totals = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[text.bounds])
    doubled = []
    for t in texts:
        lines = t.split(b"\n") if t and b"\n" in t else []
        seen: set[bytes] = set()
        count = 0
        for line in lines:
            if line in seen:
                count += 1
            elif line.split(None, 1):
                seen.add(line)
        doubled.append(count)
    return {"n_words": size, "word_chars": text.size - totals(np.isin(code, SPACES)), "n_symbols": totals(np.isin(code, [ord(c) for c in SYMBOLS])),
            "n_dup_lines": np.array(doubled, np.int64), "n_repeat_words": repeated}


MEASURED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def measure(docs: DataFrame, uri: str, shards: int) -> DataFrame:
    """The base rules' numbers and the mean log perplexity of a character (null without one), for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes, known = Model(uri, shards), WordHashes(), {}
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), as_bytes(batch.column(2))
            parts, mean = [], []
            for a, b in groups(texts):
                text = Characters(texts[a:b], langs[a:b])
                parts.append(base_rules(texts[a:b], text, hashes))
                lang, grams, _, of = text.distinct()
                if len(known) > KEPT:
                    known.clear()
                pairs = list(zip(lang, grams))
                fresh = [p for p in pairs if p not in known]
                if fresh:
                    known.update(zip(fresh, model.logs(fresh).tolist()))
                logs = np.fromiter(map(known.__getitem__, pairs), np.float64, len(pairs))[of] if len(of) else np.empty(0)
                sums = np.diff(np.concatenate([[0.0], np.cumsum(logs)])[text.bounds])
                mean += [-s / n if n else None for s, n in zip(sums.tolist(), text.size.tolist())]
            columns = {k: pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.int64()) for k in (
                "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang": batch.column(1), **columns, "log_perplexity": pa.array(mean, pa.float64())})

    return docs.select("doc_id", lang_of(), "text").mapInArrow(run, MEASURED)


def judge(docs: DataFrame, fence: float = 8.0, least_words: int = 50) -> DataFrame:
    """doc_id, lang, the base rules' numbers, base_failed, perplexity, its band, kept, for each row.

    Cases: a null or empty text has no words, fails the base rules and has no perplexity; a null
    ``lang`` is the language ``und``, with a model and a band of its own; equal texts of one
    language get equal verdicts; repeated rows are counted and returned as often as they
    come; an empty table gives no row. Columns beside ``doc_id``, ``text`` and ``lang`` are not read.
    """
    spark = docs.sparkSession
    counted = written(count_grams(docs, least_words), scratch(spark, "grams"))
    uri = scratch(spark, "model")
    shards = write_model(written(kneser_ney(counted, scratch(spark, "orders")), scratch(spark, "kneser-ney")), uri)
    failed = fails(F.col("n_words"), F.col("n_repeat_words"), least_words)
    rows = written(measure(docs, uri, shards).withColumn("base_failed", failed), scratch(spark, "measured"))
    # the smaller of the distances from the median to the quartiles: junk lengthens one side at a time
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000)
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    spread = F.greatest(F.least(q2 - q1, q3 - q2), F.greatest(q2 - q1, q3 - q2) / 4, F.lit(0.005))
    bands = (rows.filter(~F.col("base_failed")).groupBy("lang").agg(quartiles.alias("q"))
             .select("lang", F.exp(q2 - fence * spread).alias("least_perplexity"), F.exp(q2 + fence * spread).alias("most_perplexity")))
    inside = F.exp("log_perplexity").between(F.col("least_perplexity"), F.col("most_perplexity"))
    return rows.join(bands, "lang", "left").select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.exp("log_perplexity").alias("perplexity"), "least_perplexity", "most_perplexity",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))

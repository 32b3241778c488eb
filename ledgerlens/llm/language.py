"""Language identification of whole, possibly mixed texts.

1. A word's script (by code point ranges) leaves as candidates the languages that were seen to
   use it; the others get the lowest score.
2. A candidate's score is how well the word and its character n-grams fit the language, from a
   bounded labelled sample.
3. Viterbi over the words' scores, with a penalty for each switch, labels spans. A path of m
   spans pays m - 1 penalties and gains in at most m runs of words over the text's best language.
   Where no run gains half a penalty it cannot be better; that is found for all texts of a batch
   at once, and the others are traced.

Labels are learned, never listed here; ``lang``, ``source`` and ``doc_id`` are not read in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import CACHE_WORDS, as_bytes, fold, gram_buckets, groups, known, split_words
from ledgerlens.llm.training import labelled_sample

UNKNOWN = "und"
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 17
#: A word's lowest score against its best language, and what a switch costs.
LEAST, SWITCH = -5.0, 12.0
#: Script of letters by code point: (name, first, last).
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF), ("syriac", 0x700, 0x74F), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
    ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("odia", 0xB00, 0xB7F), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F),
    ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF),
    ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3134F),
)
NAMES = tuple(dict.fromkeys(name for name, _, _ in SCRIPTS)) + ("other",)
_LAST = np.array([last for _, _, last in SCRIPTS])
_FIRST = np.array([first for _, first, _ in SCRIPTS])
_NUMBER = np.array([NAMES.index(name) for name, _, _ in SCRIPTS])


def scripts_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Script number (-1: no letter) of each word's first letter, and its letters."""
    first, letters = [], []
    for w in words:
        own = [c for c in w.decode("utf-8", "replace") if c.isalpha()]
        letters.append(len(own))
        first.append(ord(own[0]) if own else 0)
    code = np.array(first, np.int64)
    at = np.minimum(np.searchsorted(_LAST, code), len(_LAST) - 1)
    number = np.where((code >= _FIRST[at]) & (code <= _LAST[at]), _NUMBER[at], len(NAMES) - 1)
    letters = np.array(letters, np.int64)
    return np.where(letters > 0, number, -1), letters


class Languages:
    """``names`` in order; ``logs`` (buckets, languages); ``uses`` (scripts, languages): candidates."""

    def __init__(self, names: list[str], logs: np.ndarray, uses: np.ndarray):
        self.names, self.logs, self.uses = names, logs, uses

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words, languages), at most 0, and letters of each word. Without a letter all are 0."""
        script, letters = scripts_of(words)
        flat, bounds = gram_buckets(words, GRAMS, BUCKETS)
        out = np.empty((len(words), len(self.names)))
        for k in range(len(self.names)):
            column = self.logs[flat, k]
            word = column[bounds[:-1]]
            out[:, k] = (np.add.reduceat(column, bounds[:-1]) - word) / np.maximum(1, np.diff(bounds) - 1) * 3 + word / 2
        allowed = self.uses[script]
        allowed |= ~allowed.any(axis=1, keepdims=True)
        out[~allowed] = -np.inf
        out = np.maximum(out - out.max(axis=1, keepdims=True), LEAST)
        out[script < 0] = 0
        return out.astype(np.float32), letters


def fit(texts: list[bytes], labels: list[str]) -> Languages:
    names = sorted(set(labels))
    counts = np.zeros((BUCKETS, len(names)))
    seen = np.zeros((len(NAMES) + 1, len(names)))
    for k, name in enumerate(names):
        words, _ = split_words([t for t, own in zip(texts, labels, strict=True) if own == name])
        distinct, times = np.unique(np.array(words, dtype=object), return_counts=True) if words else ([], [])
        if len(distinct):
            flat, bounds = gram_buckets(list(distinct), GRAMS, BUCKETS)
            script, _ = scripts_of(list(distinct))
            counts[:, k] = np.bincount(flat, np.repeat(times, np.diff(bounds)), BUCKETS)
            seen[:, k] = np.bincount(np.where(script < 0, len(NAMES), script), times, len(NAMES) + 1)
    logs = np.log((counts + 0.2) / (counts.sum(0) + 0.2 * BUCKETS))
    seen = seen[:-1]
    uses = seen >= 0.01 * np.maximum(1, seen.sum(0))
    return Languages(names, logs.astype(np.float32), uses & (seen > 0))


def train(docs: DataFrame, modulus: int = 4, held: int = 2, per_language: int = 1_000, longest: int = 20_000) -> Languages:
    """Fit on documents with a ``lang`` outside the held-out fold: about ``per_language`` of each,
    texts of up to ``longest`` bytes."""
    labels = docs.filter(~fold("doc_id", modulus, held)).select("doc_id", F.col("lang").alias("label"))
    rows, _ = labelled_sample(docs, labels, per_language, longest)
    return fit([(r.text or "").encode() for r in rows], [r.label for r in rows])


def trace(scores: np.ndarray, switch: float = SWITCH) -> list[tuple[int, int, int]]:
    """Viterbi: spans (first word, last+1, language) of the best path; ties stay, then the first language."""
    rows = scores.tolist()
    value = rows[0]
    several = range(len(value))
    before: list[tuple[int, list[bool]]] = []
    for row in rows[1:]:
        top = max(value)
        floor = top - switch
        stays = [v >= floor for v in value]
        before.append((value.index(top), stays))
        value = [row[k] + (value[k] if stays[k] else floor) for k in several]
    now = value.index(max(value))
    spans, end = [], len(rows)
    for t in range(len(rows) - 2, -1, -1):
        best, stays = before[t]
        if not stays[now]:
            spans.append((t + 1, end, now))
            end, now = t + 1, best
    spans.append((0, end, now))
    return spans[::-1]


class Labeller:
    """Spans of texts; keeps the scores of words seen."""

    def __init__(self, languages: Languages):
        self.languages = languages
        self._reset()

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.scores, self.letters = np.empty((0, len(self.languages.names)), np.float32), np.empty(0, np.int64)

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > CACHE_WORDS:
            self._reset()
        return known(words, self.index, self._learn)

    def _learn(self, words: list[bytes]) -> None:
        for a in range(0, len(words), 50_000):
            some = words[a:a + 50_000]
            scores, letters = self.languages.word_scores(some)
            base = len(self.index)
            self.index.update((w, base + i) for i, w in enumerate(some))
            self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters])

    def label(self, texts: list[bytes | None]) -> list[tuple[str, float, list[dict]]]:
        """(language, score, spans) of each text."""
        names = self.languages.names
        words, ends = split_words(texts)
        if not names or not words:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        at = self.words(words)
        scores, letters = self.scores[at].astype(np.float64), self.letters[at]
        size = np.diff(ends)
        some = np.flatnonzero(size > 0)
        starts = ends[:-1][some]
        total = np.add.reduceat(scores, starts, axis=0)
        best = total.argmax(axis=1)
        owner = np.repeat(np.arange(len(some)), size[some])
        far = -4 * LEAST * (len(words) + 1)
        switches = np.zeros(len(some), bool)
        for k in range(len(names)):
            gain = scores[:, k] - scores[np.arange(len(words)), best[owner]]
            run = np.cumsum(gain)
            base = (run - gain)  # before each word
            low = np.minimum.accumulate(base - owner * far)  # each text starts far below the one before
            switches |= np.maximum.reduceat(run - owner * far - low, starts) >= SWITCH / 2 - 1e-3  # less what rounding can hide
        n_letters = np.add.reduceat(letters, starts)
        out: list[tuple[str, float, list[dict]]] = [(UNKNOWN, 0.0, [])] * len(texts)
        for j, i in enumerate(some.tolist()):
            if not n_letters[j]:
                continue
            x, y = int(ends[i]), int(ends[i + 1])
            spans = trace(scores[x:y]) if switches[j] else [(0, y - x, int(best[j]))]
            held = np.zeros(len(names))
            for a, b, k in spans:
                held[k] += letters[x + a:x + b].sum()
            k = int(held.argmax())
            sure = 1 / np.exp(np.clip((total[j] - total[j, k]) / np.sqrt(y - x), -50, 50)).sum()
            out[i] = names[k], float(min(1.0, sure) * held[k] / n_letters[j]), [{"start": a, "end": b, "lang": names[m]} for a, b, m in spans]
        return out


def identify(docs: DataFrame, languages: Languages, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans for each row.

    ``lang_pred`` has most letters of the spans; ``score`` is its share of the letters, times how
    far the whole text prefers it. ``spans`` bound words.

    Cases: a null text, one without a letter, or a model without languages gives ``und`` with score
    0 and no span; ties go to the first language by name; a null doc_id is not held out;
    repeated rows get equal labels; an empty table gives no row. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(languages)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            rows = [r for a, b in groups(texts, 2 << 20) for r in labeller.label(texts[a:b])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": pa.array([r[0] for r in rows], pa.string()),
                "score": pa.array([r[1] for r in rows], pa.float64()),
                "spans": pa.array([r[2] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))})

    return docs.select("doc_id", "text", fold("doc_id", modulus, held).alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")

"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded (a learned tanh
layer over statistics of its words), gated attention gives it a weight, and a logistic layer
scores the weighted sum of encodings. All weights are learned in numpy from document labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerlens.llm.common import CACHE_WORDS, PLAIN, WordHashes, as_bytes, fold, groups, known, mix, rows_kept, split_words
from ledgerlens.llm.training import Adam, labelled_sample, sigmoid

PASSAGE = 64
HASHED = 12
RUN = re.compile(r"[^\w\s]{2,}")
SHAPES = 14
#: word statistics, hashed word signs, then passage and document statistics
WIDTH = SHAPES + HASHED + 5


def shape(word: bytes) -> list[float]:
    w = word.decode("utf-8", "replace")
    letters = sum(map(str.isalpha, w))
    marks = sum(not c.isalnum() for c in w)
    sign = xxh64_intdigest(PLAIN.sub("", w.lower()), 3)
    return [len(w) / 8, float(len(w) > 16), float(letters > 1 and w.isupper()), float(w[:1].isupper()), float(any(map(str.isdigit, w))),
            marks / len(w), float(letters == 0), float(w[-1] in ".!?"), float(w[-1] in ",;:"), float(bool(RUN.search(w))),
            float("@" in w or "://" in w), float(w.isdigit()), float(len(set(w)) <= 2 and len(w) > 3), float(not w.isascii()),
            *(1.0 if sign >> i & 1 else -1.0 for i in range(HASHED))]


class Shapes(dict):
    """Word bytes to the row of its statistics in ``table``."""

    def __init__(self) -> None:
        super().__init__()
        self.table = np.empty((0, SHAPES + HASHED), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        base = len(self)
        rows = [np.array(list(map(shape, words[a:a + 10_000])), np.float32) for a in range(0, len(words), 10_000)]
        self.update((w, base + i) for i, w in enumerate(words))
        self.table = np.concatenate([self.table, *rows])

    def of(self, words: list[bytes]) -> np.ndarray:
        """The words' rows in ``table``."""
        if len(self) > CACHE_WORDS:
            self.clear()
            self.table = self.table[:0]
        return known(words, self, self._learn)


def passages(texts: list[bytes | None], shapes: Shapes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of all texts' passages, and the bounds of each text's. A text without words has one empty passage."""
    words, ends = split_words(texts)
    n = len(words)
    size = np.diff(ends)
    number = np.maximum(1, -(-size // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(number)])
    out = np.zeros((bounds[-1], WIDTH), np.float32)
    lines = np.array([t.count(b"\n") + 1 if t else 0 for t in texts])
    repeated_lines = np.array([1 - len(set(x)) / len(x) if t and (x := t.split(b"\n")) else 0.0 for t in texts])
    doc = np.repeat(np.arange(len(texts)), number)
    out[:, -1], out[:, -2] = np.log1p(size)[doc] / 5, (repeated_lines * (lines > 1))[doc]
    out[:, -3] = np.minimum(1, lines / np.maximum(size, 1))[doc]
    if n:
        at = np.arange(n) - np.repeat(ends[:-1], size)
        passage = np.repeat(bounds[:-1], size) + at // PASSAGE
        starts = np.flatnonzero(np.r_[True, np.diff(passage) > 0])
        where, count = passage[starts], np.diff(np.r_[starts, n])[:, None]
        row = shapes.of(words)
        for a in range(0, len(starts), 1_024):  # the words of some passages at a time
            x, y = starts[a], starts[a + 1_024] if a + 1_024 < len(starts) else n
            out[where[a:a + 1_024], :SHAPES + HASHED] = np.add.reduceat(shapes.table[row[x:y]], starts[a:a + 1_024] - x, axis=0)
        out[where, :SHAPES + HASHED] /= count
        one = hashes.array(words, n)
        own = mix(one, np.repeat(np.arange(len(texts)), size).astype(np.uint64))
        pair = mix(own, np.r_[own[1:], own[:1]])
        for column, key in ((-4, pair), (-5, own)):
            order = np.argsort(key, kind="stable")
            again = np.zeros(n, np.float32)
            again[order[1:]] = key[order[1:]] == key[order[:-1]]
            out[where, column] = np.add.reduceat(again, starts) / count[:, 0]
    return out, bounds


class Attention:
    """The model: scale, encode, gate, weigh, score."""

    def __init__(self, width: int = WIDTH, encoded: int = 16, gated: int = 8, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"W": draw(width, encoded), "b": np.zeros(encoded, np.float32), "V": draw(encoded, gated), "U": draw(encoded, gated),
                  "a": draw(gated), "c": draw(encoded), "d": np.zeros(1, np.float32)}
        self.mean, self.std, self.shift = np.zeros(width, np.float32), np.ones(width, np.float32), 0.0

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> tuple:
        w = self.w
        x = np.clip((x - self.mean) / self.std, -6, 6)
        e = np.tanh(x @ w["W"] + w["b"])
        v, u = np.tanh(e @ w["V"]), sigmoid(e @ w["U"])
        s = (v * u) @ w["a"]
        start, size = bounds[:-1], np.diff(bounds)
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, start), size))
        weight = s / np.repeat(np.add.reduceat(s, start), size)
        z = np.add.reduceat(e * weight[:, None], start, axis=0)
        return x, e, v, u, weight, z, sigmoid(z @ w["c"] + w["d"][0] + self.shift)

    def gradients(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, size = self.w, np.diff(bounds)
        x, e, v, u, weight, z, p = self.forward(x, bounds)
        g = (p - y) / len(y)
        gz = np.repeat(g, size)[:, None] * w["c"]
        along = (gz * e).sum(1)
        gs = weight * (along - np.repeat(np.add.reduceat(along * weight, bounds[:-1]), size))
        gv, gu = gs[:, None] * w["a"] * u * (1 - v * v), gs[:, None] * w["a"] * v * u * (1 - u)
        ge = gz * weight[:, None] + gv @ w["V"].T + gu @ w["U"].T
        gx = ge * (1 - e * e)
        return {"W": x.T @ gx, "b": gx.sum(0), "V": e.T @ gv, "U": e.T @ gu, "a": (v * u).T @ gs, "c": z.T @ g, "d": np.array([g.sum()])}

    def fit(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, prior: float, epochs: int = 40, batch: int = 128, seed: int = 11) -> None:
        """``prior``: share of label 1 among all labelled rows; the sample is balanced, so scores are moved back to it."""
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        steps, r = Adam(self.w, 0.01), np.random.default_rng(seed)
        epochs = max(epochs, -(-400 // max(1, len(y) // batch)))  # few rows are few steps an epoch
        for epoch in range(epochs):
            steps.rate = 0.01 * (1 - epoch / epochs) + 5e-4
            for some in np.array_split(r.permutation(len(y)), max(1, len(y) // batch)):
                size = bounds[some + 1] - bounds[some]
                cut = np.concatenate([[0], np.cumsum(size)])
                rows = np.repeat(bounds[some] - cut[:-1], size) + np.arange(cut[-1])
                gradient = self.gradients(x[rows], cut, y[some])
                gradient["W"] += 1e-4 * self.w["W"]
                steps.update(gradient)
        share = float(np.clip(y.mean(), 0.01, 0.99))
        prior = float(np.clip(prior, 0.01, 0.99))
        self.shift = float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, per_class: int = 3_000, longest: int = 20_000) -> Attention:
    """Fit on labelled rows outside the held-out fold: about ``per_class`` of each label, texts of
    up to ``longest`` bytes. With no labelled row every score is 0.5."""
    learnable = labels.filter(~fold("doc_id", modulus, held)).select("doc_id", F.col("quality").alias("label"))
    rows, counts = labelled_sample(docs, learnable, per_class, longest)
    model = Attention()
    if not rows:
        model.w["c"][:] = 0
        return model
    texts = [(r.text or "").encode() for r in rows]
    shapes, hashes = Shapes(), WordHashes()
    parts = [passages(texts[a:b], shapes, hashes) for a, b in groups(texts, 1 << 20)]
    x, bounds = np.concatenate([p[0] for p in parts]), np.cumsum(np.concatenate([[0], *(np.diff(p[1]) for p in parts)]))
    model.fit(x, bounds, np.array([float(r.label) for r in rows], np.float32), counts.get(1, 0) / sum(counts.values()))
    return model


def score(docs: DataFrame, model: Attention, threshold: float = 0.3, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, focus (the passage with most weight) for each row.

    Cases: a null or empty text is one empty passage and is scored like any text; a null doc_id
    is not held out; repeated rows get equal scores; an empty table gives no row. Columns beside
    ``doc_id`` and ``text`` are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, hashes = Shapes(), WordHashes()
        for batch in batches:
            texts = as_bytes(batch.column(1))
            scores, sizes, focus = [], [], []
            for a, b in groups(texts):
                x, bounds = passages(texts[a:b], shapes, hashes)
                *_, weight, _, p = model.forward(x, bounds)
                scores.append(p)
                sizes.append(np.diff(bounds))
                focus += [int(weight[i:j].argmax()) for i, j in zip(bounds[:-1], bounds[1:])]
            p = np.concatenate(scores).astype(np.float64) if scores else np.empty(0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "held_out": batch.column(2), "score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32)),
                "n_passages": pa.array(np.concatenate(sizes).astype(np.int64) if sizes else np.empty(0, np.int64)), "focus": pa.array(focus, pa.int64())})

    return docs.select("doc_id", "text", fold("doc_id", modulus, held).alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int, n_passages long, focus long")


def keep_good(docs: DataFrame, model: Attention, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``threshold`` or more. Each row is judged
    by its own text where it stands, so nothing is shuffled; the cases are those of :func:`score`."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, hashes = Shapes(), WordHashes()
        for batch in batches:
            texts = as_bytes(batch.column(at))
            good = [model.forward(*passages(texts[a:b], shapes, hashes))[-1] >= threshold for a, b in groups(texts)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return rows_kept(docs, run)

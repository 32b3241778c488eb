"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words.

Inputs of a word come from the word itself and from its character n-grams: how far each leans
to toxic documents, as a cautious log ratio from a bounded labelled sample (a hashed table), besides the word's shape. The statistics of one half of the sample are inputs of the
other half in training, so the network sees them as it will see them on new texts. Windows of
``WINDOW`` words start every ``STRIDE`` words, so each word is in two of them; a document's score
is its highest window's. The network is trained in numpy, by back-propagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import CACHE_WORDS, as_bytes, fold, gram_buckets, groups, known, split_words
from ledgerlens.llm.training import Adam, labelled_sample, sigmoid

WINDOW, STRIDE = 32, 16
BUCKETS = 1 << 19
GRAMS = (3, 4, 5, 6)
INPUTS = 8
LEAN = 6
#: Windows that go through the network together.
TOGETHER = 4_096


def leanings(pairs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Of each bucket the log ratio of its share of toxic and of clean documents, one standard
    error nearer to zero. ``pairs`` has the distinct buckets of each document."""
    one, zero = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for own, t in zip(pairs, toxic, strict=True):
        (one if t else zero)[own] += 1
    one, zero, ones, zeros = one + 0.5, zero + 0.5, toxic.sum() + 1, (1 - toxic).sum() + 1
    ratio = np.log(one / ones) - np.log(zero / zeros)
    sure = np.maximum(np.abs(ratio) - np.sqrt(1 / one + 1 / zero), 0)
    return np.where((one > 0.5) | (zero > 0.5), np.sign(ratio) * sure, 0).clip(-LEAN, LEAN).astype(np.float32)


class Words(dict):
    """Word bytes to its row of inputs, for one table of leanings. Beyond ``most`` words it starts anew."""

    def __init__(self, table: np.ndarray, most: int | None = CACHE_WORDS):
        super().__init__()
        self.table_of, self.rows, self.most = table, np.empty((0, INPUTS), np.float32), most

    def _learn(self, words: list[bytes]) -> None:
        for a in range(0, len(words), 50_000):
            some = words[a:a + 50_000]
            buckets, bounds = gram_buckets(some, GRAMS, BUCKETS)
            lean = self.table_of[buckets]
            first = lean[bounds[:-1]]
            own = lean.copy()
            own[bounds[:-1]] = -LEAN  # the word itself is apart
            top = np.maximum.reduceat(own, bounds[:-1])
            lean[bounds[:-1]] = 0
            number = np.maximum(np.diff(bounds) - 1, 1)
            mean = np.add.reduceat(lean, bounds[:-1]) / number
            strong = np.add.reduceat((lean > 2.5).astype(np.float32), bounds[:-1]) / number
            text = [w.decode("utf-8", "replace") for w in some]
            more = np.array([[len(w) / 10, float(len(w) > 1 and w.isupper()), float(w[-1] in ".!?"), float(not any(map(str.isalnum, w)))] for w in text])
            base = len(self)
            self.update((w, base + i) for i, w in enumerate(some))
            rows = np.column_stack([first / 2, top / 2, mean, strong, more]).astype(np.float32)
            self.rows = np.concatenate([self.rows, rows])

    def of(self, words: list[bytes]) -> np.ndarray:
        """Row numbers of the words."""
        if self.most is not None and len(self) > self.most:
            self.clear()
            self.rows = self.rows[:0]
        return known(words, self, self._learn)


class Network:
    """Two gated recurrent directions over a window, attention over its words, one logistic output."""

    def __init__(self, hidden: int = 8, seed: int = 3):
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden = hidden
        self.w = {"v": draw(hidden), "A": draw(2 * hidden, hidden), "o": draw(2 * hidden), "k": np.zeros(1, np.float32)}
        for d in "fb":  # forwards, backwards: input, recurrent and bias weights of the gates (update, reset, candidate)
            self.w |= {f"W{d}": draw(INPUTS, 3 * hidden), f"R{d}": draw(hidden, 2 * hidden), f"C{d}": draw(hidden, hidden), f"b{d}": np.zeros(3 * hidden, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def direction(self, projected: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each word. ``projected``: (steps, windows, 3 * hidden), in reading order of ``d``."""
        h, R, C = self.hidden, self.w[f"R{d}"], self.w[f"C{d}"]
        steps, windows = projected.shape[:2]
        state = np.zeros((windows, h), np.float32)
        out = np.empty((steps, windows, h), np.float32)
        for t in range(steps):
            gates = projected[t, :, :2 * h] + state @ R
            np.clip(gates, -30, 30, out=gates)
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :h] * mask[t], gates[:, h:]
            candidate = np.tanh(projected[t, :, 2 * h:] + (r * state) @ C)
            if keep is not None:
                keep.append((state, z, r, candidate))
            state = state + z * (candidate - state)
            out[t] = state
        return out

    def pooled(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a = np.tanh(states @ self.w["A"])
        s = a @ self.w["v"] + (mask[:, :, 0] - 1) * 1e4
        s = np.exp(s - s.max(0))
        weight = s / s.sum(0)
        z = (states * weight[:, :, None]).sum(0)
        return a, weight, z, sigmoid(self.scale * (z @ self.w["o"] + self.w["k"][0]) + self.shift)

    def project(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input projections of word rows, once for each distinct word."""
        return tuple((rows @ self.w[f"W{d}"] + self.w[f"b{d}"]).astype(np.float32) for d in "fb")

    def scores(self, forwards: np.ndarray, backwards: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of windows (steps, windows) of word numbers into the projections."""
        out = np.empty(index.shape[1], np.float32)
        for a in range(0, index.shape[1], TOGETHER):
            at, m = index[:, a:a + TOGETHER], mask[:, a:a + TOGETHER, None]
            f = self.direction(forwards[at], m, "f")
            b = self.direction(backwards[at[::-1]], m[::-1], "b")[::-1]
            out[a:a + TOGETHER] = self.pooled(np.concatenate([f, b], axis=2), m)[-1]
        return out

    def run(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Scores of windows given as inputs (steps, windows, inputs)."""
        m = mask[:, :, None]
        f = self.direction(x @ self.w["Wf"] + self.w["bf"], m, "f")
        b = self.direction((x @ self.w["Wb"] + self.w["bb"])[::-1], m[::-1], "b")[::-1]
        return self.pooled(np.concatenate([f, b], axis=2), m)[-1]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> dict[str, np.ndarray]:
        """Of mean weighted log loss; x (steps, windows, inputs), mask (steps, windows, 1)."""
        h, w = self.hidden, self.w
        kept: dict[str, list] = {"f": [], "b": []}
        f = self.direction(x @ w["Wf"] + w["bf"], mask, "f", kept["f"])
        b = self.direction((x @ w["Wb"] + w["bb"])[::-1], mask[::-1], "b", kept["b"])[::-1]
        states = np.concatenate([f, b], axis=2)
        a, weight, z, p = self.pooled(states, mask)
        g = (p - y) * weigh / weigh.sum()
        out = {"o": z.T @ g, "k": np.array([g.sum()])}
        gz = g[:, None] * w["o"]
        along = (states * gz).sum(2)
        gs = weight * (along - (along * weight).sum(0))
        ga = gs[:, :, None] * w["v"] * (1 - a * a)
        out["v"] = (a * gs[:, :, None]).sum((0, 1))
        out["A"] = np.tensordot(states, ga, ([0, 1], [0, 1]))
        gstates = weight[:, :, None] * gz + ga @ w["A"].T
        for d, part in (("f", gstates[:, :, :h]), ("b", gstates[::-1, :, h:])):
            inputs, m = (x, mask) if d == "f" else (x[::-1], mask[::-1])
            R, C = w[f"R{d}"], w[f"C{d}"]
            back = np.zeros_like(part[0])
            gW, gR, gC, gb = np.zeros_like(w[f"W{d}"]), np.zeros_like(R), np.zeros_like(C), np.zeros_like(w[f"b{d}"])
            for t in range(len(part) - 1, -1, -1):
                state, zt, r, candidate = kept[d][t]
                back = back + part[t]
                gcand = back * zt * (1 - candidate ** 2)
                gate = zt * (1 - zt) * m[t]  # mask is 0 or 1, so z's own value stands in it
                gzt = back * (candidate - state) * gate
                grs = gcand @ C.T
                gr = grs * state * r * (1 - r)
                gates = np.concatenate([gzt, gr], axis=1)
                gC += (r * state).T @ gcand
                gR += state.T @ gates
                all_ = np.concatenate([gates, gcand], axis=1)
                gW += inputs[t].T @ all_
                gb += all_.sum(0)
                back = back * (1 - zt) + grs * r + gates @ R.T
            out |= {f"W{d}": gW, f"R{d}": gR, f"C{d}": gC, f"b{d}": gb}
        return out


def platt(logit: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale (positive) and shift of the weighted logistic regression of ``truth`` on ``logit``."""
    x = np.column_stack([logit, np.ones_like(logit)])
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ at)
        gradient = x.T @ (weight * (p - truth)) + 1e-2 * (at - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        at -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
    return float(max(at[0], 0.05)), float(at[1])


def window_starts(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of all windows: they start every ``STRIDE`` words and overlap, the
    last one reaches its text's end. A text without words has none."""
    size = np.diff(ends)
    number = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(size)), number)
    k = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    start = ends[:-1][text] + k * STRIDE
    return start, np.minimum(WINDOW, ends[1:][text] - start), text


def window_index(index: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, windows) of word rows, and the mask of real words."""
    step = np.arange(WINDOW)[:, None]
    mask = (step < length).astype(np.float32)
    at = np.minimum(start + step, len(index) - 1)
    return index[at], mask


class Detector:
    def __init__(self, table: np.ndarray, network: Network):
        self.table, self.network = table, network

    def text_scores(self, texts: list[bytes | None], words: Words, projected: dict) -> np.ndarray:
        found, ends = split_words(texts)
        out = np.full(len(texts), float(sigmoid(np.array(-6.0))))
        if not found:
            return out
        index = words.of(found)
        if projected.get("rows") is not words.rows:
            projected["rows"], projected["at"] = words.rows, self.network.project(words.rows)
        start, length, text = window_starts(ends)
        scores = np.empty(len(start), np.float32)
        for a in range(0, len(start), TOGETHER):
            at, mask = window_index(index, start[a:a + TOGETHER], length[a:a + TOGETHER])
            scores[a:a + TOGETHER] = self.network.scores(*projected["at"], at, mask)
        np.maximum.at(out, text, scores)
        return out


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, per_class: int = 2_500, longest: int = 20_000,
          epochs: int = 5) -> Detector:
    """Fit on labelled rows outside the held-out fold: about ``per_class`` of each label, texts of
    up to ``longest`` bytes. With no labelled row of either label every score is near 0."""
    learnable = labels.filter(~fold("doc_id", modulus, held)).select("doc_id", F.col("toxic").alias("label"))
    rows, counts = labelled_sample(docs, learnable, per_class, longest)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([(r.text or "").encode() for r in rows], np.array([float(r.label) for r in rows], np.float32), share, epochs)


def fit(texts: list[bytes], y: np.ndarray, prior: float, epochs: int = 5) -> Detector:
    """``prior``: share of label 1 among all labelled rows."""
    network, rng = Network(), np.random.default_rng(5)
    if not len(texts) or not 0 < y.sum() < len(y):
        network.w["o"][:], network.w["k"][:] = 0, -6
        return Detector(np.zeros(BUCKETS, np.float32), network)
    index: dict[bytes, int] = {}
    flat, bounds = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]

    def learn(some: list[bytes]) -> None:
        own, ends = gram_buckets(some, GRAMS, BUCKETS)
        base = len(index)
        index.update((w, base + i) for i, w in enumerate(some))
        flat.append(own.astype(np.int32))
        bounds.append(bounds[-1][-1] + ends[1:])

    pairs = []
    for a, b in groups(texts, 1 << 20):
        own = [np.unique(known(t.split(), index, learn)) for t in texts[a:b]]
        flat, bounds = [np.concatenate(flat)], [np.concatenate(bounds)]
        pairs += [np.unique(np.concatenate([np.empty(0, np.int32), *(flat[0][bounds[0][k]:bounds[0][k + 1]] for k in some)])) for some in own]
    del index, flat, bounds
    half = rng.permutation(len(texts)) % 2
    xs, masks, ys, views = [], [], [], {}
    for side in (0, 1):
        other = np.flatnonzero(half != side)
        words = views[side] = Words(leanings([pairs[i] for i in other], y[other]), None)
        for i in np.flatnonzero(half == side):
            found, ends = split_words([texts[i]])
            if not found:
                continue
            at, mask = window_index(words.of(found).astype(np.int32), *window_starts(ends)[:2])
            x = words.rows[at] * mask[:, :, None]
            strength = (np.maximum(x[:, :, 0], x[:, :, 1]) + 2 * x[:, :, 3]).max(0)
            chosen = np.argsort(-strength)[:1 if y[i] else 3].tolist()
            if not y[i]:  # a clean document's windows are all clean
                chosen += rng.choice(at.shape[1], min(2, at.shape[1]), replace=False).tolist()
            for k in set(chosen):
                xs.append(x[:, k])
                masks.append(mask[:, k])
                ys.append(y[i])
    x, mask, y_ = np.stack(xs, 1), np.stack(masks, 1)[:, :, None], np.array(ys, np.float32)
    weigh = np.where(y_ > 0, 0.5 / max(1.0, y_.sum()), 0.5 / max(1.0, (1 - y_).sum())).astype(np.float32) * len(y_)
    steps = Adam(network.w, 0.02)
    for epoch in range(max(epochs, -(-400 // max(1, len(y_) // 256)))):
        for some in np.array_split(rng.permutation(len(y_)), max(1, len(y_) // 256)):
            steps.update(network.gradients(x[:, some], mask[:, some], y_[some], weigh[some]))
        steps.rate *= 0.8 if len(y_) > 4_000 else 0.99
    # a document's score is its highest window's: the output is scaled for that, at the labels' true shares
    highest = np.concatenate([Detector(views[side].table_of, network).text_scores([texts[i] for i in group[a:a + 200]], views[side], {})
                              for side in (0, 1) for group in [np.flatnonzero(half == side)] for a in range(0, len(group), 200)])
    order = np.concatenate([np.flatnonzero(half == side) for side in (0, 1)])
    some = np.array([bool(texts[i].strip()) for i in order])
    p = np.clip(highest[some], 1e-6, 1 - 1e-6)
    logit, truth = np.log(p / (1 - p)), y[order[some]]
    weight = np.where(truth > 0, prior / truth.mean(), (1 - prior) / (1 - truth.mean()))
    network.scale, network.shift = platt(logit, truth, weight)
    return Detector(leanings(pairs, y), network)


def score(docs: DataFrame, detector: Detector, threshold: float = 0.3, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Cases: a null text, or one without words, has the lowest score; a text shorter than a window
    is one window; a null doc_id is not held out; repeated rows get equal scores; an empty table
    gives no row. Columns beside ``doc_id`` and ``text`` are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, projected = Words(detector.table), {}
        for batch in batches:
            texts = as_bytes(batch.column(1))
            p = np.concatenate([np.empty(0), *(detector.text_scores(texts[a:b], words, projected) for a, b in groups(texts, 2 << 20))])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(2), "score": pa.array(p.astype(np.float64)),
                                              "predicted": pa.array((p >= threshold).astype(np.int32))})

    return docs.select("doc_id", "text", fold("doc_id", modulus, held).alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")

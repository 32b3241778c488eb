"""Bounded samples of labelled documents, and a small optimiser, for the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import Row


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, longest: int, most: int = 20_000) -> tuple[list[Row], dict]:
    """About ``per_class`` rows (doc_id, text, label) of each label (fewer where there are so many
    labels that they would be over ``most`` together), texts of up to ``longest`` bytes, and how
    many rows with each label there are in all.

    ``labels`` (doc_id, label) holds the learnable rows only. A row is in the sample if its id's
    hash is below its label's share, so the choice is the same on each run. The bounds are for
    the training sample alone; nothing else is sampled.
    """
    known = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], {}
    per_class = min(per_class, max(1, most // len(counts)))
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, 1.1 * per_class / n))).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select("doc_id", "text").filter(F.octet_length(F.coalesce("text", F.lit(""))) <= longest)
    rows = (texts.join(F.broadcast(chosen.limit(2 * per_class * len(counts))), "doc_id")
            .orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(2 * per_class * len(counts)).collect())
    return rows, counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Adam over a dict of arrays, in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01):
        self.weights, self.rate, self.step = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g ** 2).sum()) for g in gradients.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in gradients.items():
            g = g * scale
            self.mean[k] = 0.9 * self.mean[k] + 0.1 * g
            self.square[k] = 0.999 * self.square[k] + 0.001 * g * g
            m, s = self.mean[k] / (1 - 0.9 ** self.step), self.square[k] / (1 - 0.999 ** self.step)
            self.weights[k] -= (self.rate * m / (np.sqrt(s) + 1e-8)).astype(self.weights[k].dtype)

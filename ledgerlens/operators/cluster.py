"""Customer clustering on scaled R/F/M.

Scaling is median imputation then a z-score with the *population* standard
deviation (as scikit-learn's StandardScaler does; Spark ML's scaler uses
the sample deviation, so it is not used). K-Means seeds its restarts from all points (k-means||),
advances them in one aggregate for each iteration (partial sums by numpy in each task) and keeps the lowest cost. Cluster ids are renumbered by
centroid order so they are stable across runs. Assignment to given centroids is a plain expression (nearest
by squared distance, lowest id on a tie), so it can be checked in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.exprs import pct
from ledgerlens.functions.rules import CLUSTER_LABELS
from ledgerlens.operators.rank import column_quantiles
from ledgerlens.functions.scalars import with_scalars
from ledgerlens.session import stored

RFM_COLUMNS = ("recency", "frequency", "monetary")
EXACT_SUM = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


def _mean(df: DataFrame, c: str) -> Column:
    if isinstance(df.schema[c].dataType, EXACT_SUM):
        return F.sum(c).cast("double") / F.count(c).cast("double")
    return F.avg(F.col(c).cast("double"))


def scale_rfm(df: DataFrame, columns: Sequence[str] = RFM_COLUMNS, digits: int | None = None) -> DataFrame:
    """M1: add ``<col>_scaled`` for each available R/F/M column.

    Nulls are filled with the column's exact median; a zero deviation divides
    by 1. Medians, means and deviations are attached as scalar subqueries. A whole-number
    column keeps its type, so a median between two numbers is cut in it (not in its scaled column).
    """
    cols = [c for c in columns if c in df.columns]
    if not cols:
        raise ValueError(f"No RFM metric columns found. Need at least one of: {list(columns)}")
    gaps = [c for c in cols if df.schema[c].nullable]
    filled, exact = df, {c: F.col(c).cast("double") for c in cols}
    if gaps:
        medians = column_quantiles(df, gaps, [0.5]).agg(
            *[F.max(F.when(F.col("column_name") == c, F.col("quantiles")[0])).alias(f"_med_{c}") for c in gaps])
        filled = with_scalars(df, medians)
        exact |= {c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")) for c in gaps}
    filled = filled.withColumns({f"_x_{c}": v for c, v in exact.items()})
    stats = filled.agg(*[(_mean(df, c) if c not in gaps else F.avg(f"_x_{c}")).alias(f"_mu_{c}") for c in cols],
                       *[F.stddev_pop(f"_x_{c}").alias(f"_sd_{c}") for c in cols])
    out = with_scalars(filled, stats)
    scaled = {c: F.coalesce(F.col(c), F.col(f"_med_{c}").cast(df.schema[c].dataType)) for c in gaps}
    for c in cols:
        sd = F.col(f"_sd_{c}")
        z = (F.col(f"_x_{c}") - F.col(f"_mu_{c}")) / F.when((sd == 0) | sd.isNull(), F.lit(1.0)).otherwise(sd)
        scaled[f"{c}_scaled"] = F.round(z, digits) if digits is not None else z
    helpers = [f"{h}_{c}" for c in cols for h in ("_mu", "_sd", "_x", "_med")]
    return out.withColumns(scaled).drop(*helpers)


def scaled_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_scaled")]


def squared_distance(cols: Sequence[str], centroid: Sequence[float]) -> Column:
    d = None
    for c, v in zip(cols, centroid):
        diff = F.col(c) - F.lit(float(v))
        d = diff * diff if d is None else d + diff * diff
    return d


def assign_centroids(df: DataFrame, centroids: Sequence[Sequence[float]], cols: Sequence[str] | None = None,
                     out: str = "cluster_id") -> DataFrame:
    """M3: nearest centroid by squared distance; ties go to the lowest id."""
    cols = list(cols or scaled_columns(df))
    cands = [F.struct(squared_distance(cols, c).alias("d"), F.lit(i).alias("id")) for i, c in enumerate(centroids)]
    best = F.least(*cands) if len(cands) > 1 else cands[0]
    return df.withColumn(out, best["id"].cast("int"))


def centroid_frame(spark, centroids: Sequence[Sequence[float]], cols: Sequence[str]) -> DataFrame:
    """Centroids as a k-row DataFrame (cluster_id + one column per scaled metric)."""
    rows = [(i, *[float(v) for v in c]) for i, c in enumerate(centroids)]
    schema = "cluster_id int, " + ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema)


def label_expr(r: Column, f: Column, m: Column, cid: Column) -> Column:
    """M4: label from the centroid's signs (positive = above average).

    As in the reference, scaled recency > 0 (longer since the last order)
    is called "Active"; the rule is kept as computed.
    """
    suffix = (F.when((f > 0) & (m > 0), F.when(r > 0, F.lit(CLUSTER_LABELS["active_high"]))
                     .otherwise(F.lit(CLUSTER_LABELS["inactive_high"])))
              .when((f > 0) & (m <= 0), F.lit(CLUSTER_LABELS["frequent_low"]))
              .when((f <= 0) & (m > 0), F.lit(CLUSTER_LABELS["infrequent_high"]))
              .otherwise(F.lit(CLUSTER_LABELS["low"])))
    return F.concat(F.lit("Cluster_"), cid.cast("string"), F.lit("_"), suffix)


def cluster_labels(centroids: DataFrame) -> DataFrame:
    """M4 over a centroid frame: (cluster_id, cluster_label). Missing metrics count as 0."""
    def get(name):
        return F.col(name) if name in centroids.columns else F.lit(0.0)
    return centroids.select("cluster_id", label_expr(get("recency_scaled"), get("frequency_scaled"),
                                                      get("monetary_scaled"), F.col("cluster_id")).alias("cluster_label"))


def attach_labels(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Cluster id to label (k rows, broadcast)."""
    return assigned.join(F.broadcast(labels), "cluster_id", "left")


def cluster_metrics(assigned: DataFrame, k: int, metrics: Sequence[str] = RFM_COLUMNS) -> DataFrame:
    """Per cluster: customers, % of customers, mean/min/max of each metric.

    Every id 0..k-1 keeps a row (an empty cluster has count 0)."""
    metrics = [c for c in metrics if c in assigned.columns]
    aggs = [F.count(F.lit(1)).alias("customer_count")]
    for c in metrics:
        aggs += [_mean(assigned, c).alias(f"avg_{c}"), F.min(F.col(c).cast("double")).alias(f"min_{c}"),
                 F.max(F.col(c).cast("double")).alias(f"max_{c}")]
    g = assigned.groupBy("cluster_id").agg(*aggs)
    total = assigned.agg(F.count(F.lit(1)).alias("_total"))
    ids = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    out = with_scalars(ids.join(g, "cluster_id", "left"), total)
    return out.select("cluster_id", F.coalesce("customer_count", F.lit(0)).cast("bigint").alias("customer_count"),
                      pct(F.coalesce("customer_count", F.lit(0)), "_total").alias("percentage_of_total"),
                      *[x for c in metrics for x in (f"avg_{c}", f"min_{c}", f"max_{c}")])


def cluster_summary(assigned: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Cluster metrics with the label, ordered by id."""
    return cluster_metrics(assigned, k).join(F.broadcast(labels), "cluster_id", "left").orderBy("cluster_id")


def cluster_cost(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Within-cluster sum of squared distances per cluster id."""
    cols = [c for c in centroids.columns if c != "cluster_id"]
    cent = centroids.select("cluster_id", *[F.col(c).alias(f"_c_{c}") for c in cols])
    j = assigned.join(F.broadcast(cent), "cluster_id")
    d = None
    for c in cols:
        diff = F.col(c) - F.col(f"_c_{c}")
        d = diff * diff if d is None else d + diff * diff
    return j.groupBy("cluster_id").agg(F.sum(d).alias("cluster_cost"))


def centroid_summary(assigned: DataFrame, centroids: DataFrame, k: int, inertia: float | None = None) -> DataFrame:
    """M5: cluster metrics, the reference's ``inertia / k`` (same number for
    every cluster) and the true per-cluster cost."""
    cost = cluster_cost(assigned, centroids)
    m = cluster_metrics(assigned, k).join(F.broadcast(cost), "cluster_id", "left")
    total = m.agg(F.sum("cluster_cost").alias("_inertia")) if inertia is None else None
    if total is not None:
        m = with_scalars(m, total)
        contrib = F.col("_inertia") / F.lit(float(k))
    else:
        contrib = F.lit(float(inertia) / k)
    return m.withColumn("inertia_contribution", contrib).withColumn(
        "cluster_cost", F.coalesce("cluster_cost", F.lit(0.0))).drop("_inertia")


#: A restart has settled when a pass lowers its cost by a smaller share.
SETTLED = 1e-3
#: Seeding: rounds of oversampling, and points drawn in each for one cluster wanted.
SEED_ROUNDS, OVERSAMPLING = 2, 20


def _geometry(cols: Sequence[str]):
    """The functions that tasks measure points with. They stand inside, and use numpy only, so that
    they travel to the tasks themselves and executors need not have this package."""
    def points_of(batch: pa.RecordBatch) -> np.ndarray:
        """The points of a batch, one a row; a null is NaN."""
        return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols])

    def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Squared distance of each point (row) to each centre (column)."""
        d = np.zeros((len(x), len(centres)))
        for i in range(x.shape[1]):
            d += np.square(x[:, i, None] - centres[None, :, i])
        return d

    return points_of, distances


def _nearest(points: DataFrame, centres: np.ndarray, cols: Sequence[str]) -> DataFrame:
    """``points`` with the squared distance ``_d`` to the nearest centre and its number ``_j`` (the lowest on a tie)."""
    points_of, distances = _geometry(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(points_of(batch), centres)
            found = [pa.array(d.min(axis=1), from_pandas=True), pa.array(d.argmin(axis=1), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "_d", "_j"])

    schema = T.StructType([*points.schema.fields, T.StructField("_d", T.DoubleType()), T.StructField("_j", T.IntegerType())])
    return points.mapInArrow(run, schema)


def _seeds(points: DataFrame, k: int, seed: int, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Candidate centres and how many points are nearest to each (k-means||).

    Each round draws ``OVERSAMPLING * k`` points of all, with chances in proportion to their squared
    distance from the candidates so far: the smallest exponential keys -log(u) / d, one pass and
    a top-n. So the driver holds ``SEED_ROUNDS * OVERSAMPLING * k`` points at most."""
    def uniform(n: int) -> Column:
        return (F.pmod(F.xxhash64("_id", F.lit(seed), F.lit(n)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))

    found = np.array([tuple(r) for r in points.orderBy(uniform(0)).select(*cols).limit(1).collect()])
    for n in range(1, SEED_ROUNDS + 1):
        far = _nearest(points, found, cols).filter("_d > 0")
        drawn = far.orderBy(-F.log(uniform(n)) / F.col("_d")).select(*cols).limit(OVERSAMPLING * k).collect()
        if not drawn:
            break
        found = np.unique(np.vstack([found, [tuple(r) for r in drawn]]), axis=0)
    weights = np.zeros(len(found))
    for r in _nearest(points, found, cols).groupBy("_j").count().collect():
        weights[r["_j"]] = r["count"]
    return found, weights


def _start(x: np.ndarray, w: np.ndarray, k: int, seed: int, rounds: int = 50) -> np.ndarray:
    """First centres of a restart: greedy k-means++ on the weighted candidates (of some draws the
    one that lowers the cost most), then some rounds there."""
    r = np.random.default_rng(seed)
    centres = [x[r.choice(len(x), p=w / w.sum())]]
    d = ((x - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        share = w * d
        drawn = r.choice(len(x), size=2 + int(np.log(k)), p=share / share.sum() if share.sum() > 0 else w / w.sum())
        after = np.minimum(d, ((x[drawn][:, None] - x[None]) ** 2).sum(2))
        best = (after * w).sum(1).argmin()
        centres.append(x[drawn[best]])
        d = after[best]
    found = np.array(centres)
    for _ in range(rounds):
        near = ((x[:, None, :] - found[None]) ** 2).sum(2).argmin(1)
        moved = np.array([np.average(x[near == i], axis=0, weights=w[near == i]) if w[near == i].sum() > 0 else found[i] for i in range(k)])
        if np.allclose(moved, found):
            break
        found = moved
    return found


def _pass(points: DataFrame, centres: np.ndarray, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """One pass over the points for all restarts together (restart x cluster x column):
    the next centres and the cost at the present ones. Restarts x clusters rows reach the driver."""
    points_of, distances = _geometry(cols)
    (runs, k), width = centres.shape[:2], len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(runs * k, np.int64), np.zeros((1 + width, runs * k))
        for batch in batches:
            x = points_of(batch)
            for r in range(runs):
                d = distances(x, centres[r])
                at = d.argmin(axis=1) + r * k
                n += np.bincount(at, minlength=runs * k)
                for i, v in enumerate([d.min(axis=1), *x.T]):
                    total[i] += np.bincount(at, weights=np.where(np.isnan(v), 0.0, v), minlength=runs * k)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.repeat(np.arange(runs), k), np.tile(np.arange(k), runs), n, *total)],
                                         names=["r", "c", "_n", "_d", *cols])

    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("r", "c", "_n")), *(T.StructField(c, T.DoubleType()) for c in ("_d", *cols))])
    # a task gives one row for each restart and cluster
    sums = (points.select(*cols).mapInArrow(run, schema).groupBy("r", "c").agg(*[F.sum(c).alias(c) for c in ("_n", "_d", *cols)]).filter("_n > 0").collect())
    out, cost = centres.copy(), np.zeros(len(centres))
    for row in sums:
        out[row.r, row.c] = [row[c] / row["_n"] for c in cols]  # an empty cluster keeps its centre
        cost[row.r] += row["_d"]
    return out, cost


def fit_kmeans(scaled: DataFrame, k: int = 4, seed: int = 42, n_init: int = 10, max_iter: int = 100,
               tol: float = 1e-4, cols: Sequence[str] | None = None) -> tuple[list[tuple], float]:
    """M2: K-Means with ``n_init`` restarts, keeping the lowest cost (first restart
    on a tie). Returns (centroids sorted, cost).

    Starts come from candidates drawn from all points (k-means||), each restart choosing
    among them with its own seed. The restarts advance together: an iteration is one pass over the
    points and one aggregate over (restart, cluster). Restarts that have settled (by cost, or
    moved by at most ``tol``, sum of squares) stop; the best one then goes on until no coordinate moves by more than ``tol``. The points are written once
    to the shared scratch folder. Centroids are sorted lexicographically so
    ids do not depend on a restart's internal numbering.
    """
    cols = list(cols or scaled_columns(scaled))
    points = stored(scaled.select(F.monotonically_increasing_id().alias("_id"), *[F.col(c).cast("double").alias(c) for c in cols]), "kmeans-points")
    if points.isEmpty():
        raise ValueError("K-Means needs at least one row")
    pool, weights = _seeds(points, k, seed, cols)
    # restarts with equal starts would stay equal
    centres = np.unique(np.array([_start(pool, weights, k, seed + r) for r in range(n_init)]).round(12), axis=0)
    ended: list[tuple[float, np.ndarray]] = []
    before = np.full(len(centres), np.inf)
    for step in range(1, max_iter + 1):
        moved, cost = _pass(points, centres, cols)
        still = (((moved - centres) ** 2).sum(axis=(1, 2)) > tol) & (cost < before * (1 - SETTLED))
        if step == max_iter or not still.any():
            ended += zip(cost, moved)
            break
        if still.sum() <= len(centres) // 2:  # fewer restarts are a new plan, so they leave many at a time
            ended += zip(cost[~still], moved[~still])
            moved, cost = moved[still], cost[still]
        centres, before = moved, cost
    best = min(ended, key=lambda e: e[0])[1][None]
    for _ in range(max_iter):
        moved, cost = _pass(points, best, cols)
        far = np.abs(moved - best).max() > tol
        if not far:
            break
        best = moved
    return sorted(tuple(float(v) for v in c) for c in best[0]), float(cost[0])


def kmeans_clusters(scaled: DataFrame, k: int = 4, seed: int = 42, n_init: int = 10,
                    max_iter: int = 100) -> tuple[DataFrame, DataFrame, float]:
    """M6 core: fit, assign, label. Returns (clustered rows, centroid frame, cost)."""
    cols = scaled_columns(scaled)
    centers, cost = fit_kmeans(scaled, k, seed, n_init, max_iter, cols=cols)
    cents = centroid_frame(scaled.sparkSession, centers, cols)
    assigned = attach_labels(assign_centroids(scaled, centers, cols), cluster_labels(cents))
    return assigned, cents, cost

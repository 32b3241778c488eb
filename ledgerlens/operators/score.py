"""Quintile scores (W1-W6) and score distributions.

A score is the equal-width bin of a customer's rank among all customers,
ranks ordered by the metric and then by customer id (the reference breaks
ties by row order, which is customer id order; ids written as numbers are
ordered as numbers). Ranks come from
:func:`ledgerlens.operators.rank.exact_row_number`, which never gathers
all customers into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.exprs import quintile_bin
from ledgerlens.functions.scalars import with_scalars
from ledgerlens.operators.rank import exact_row_number

METRICS = ("recency", "frequency", "monetary")
ID_NUMBER = "_id_number"


def _keys(rfm: DataFrame, value: str, id_col: str) -> tuple[DataFrame, list[str]]:
    """``rfm`` with the columns that order its rows: the value, then the id; text ids that
    are whole numbers by their value, after all others."""
    if not isinstance(rfm.schema[id_col].dataType, T.StringType):
        return rfm, [value, id_col]
    return rfm.withColumn(ID_NUMBER, F.col(id_col).try_cast("decimal(38,0)")), [value, ID_NUMBER, id_col]


def global_rank(rfm: DataFrame, metric: str, out: str | None = None, id_col: str = "customerid",
                ranges: int | None = None) -> DataFrame:
    """1-based rank of ``metric`` with ties broken by customer id."""
    df, keys = _keys(rfm, metric, id_col)
    return exact_row_number(df, keys, out=out or f"{metric}_rank", ranges=ranges).drop(ID_NUMBER)


def metric_ranks(rfm: DataFrame, id_col: str = "customerid", ranges: int | None = None) -> DataFrame:
    """``rfm`` with ``<metric>_rank`` for all metrics, ranked together: one long table of
    (metric, value) rows is range-partitioned once. The other columns travel with a
    row's first metric and come back when its ranks are put together."""
    whole = F.struct(*[F.col(c) for c in rfm.columns])
    metrics = F.array(*[F.struct(F.lit(i).alias("m"), F.col(m).alias("v")) for i, m in enumerate(METRICS)])
    # numbered before the explode, which would number the metrics of a row apart
    rows = rfm.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), whole.alias("_whole"), metrics.alias("_ps"))
    long = rows.select("_row", "_id", "_whole", F.explode("_ps").alias("_p")) \
               .select("_row", "_id", F.col("_p.m").alias("_m"), F.col("_p.v").alias("_v"), F.when(F.col("_p.m") == 0, F.col("_whole")).alias("_whole"))
    df, keys = _keys(long, "_v", "_id")
    ranked = exact_row_number(df, keys, ["_m"], "_rn", ranges)
    back = ranked.groupBy("_row").agg(F.first("_whole", ignorenulls=True).alias("_whole"),
                                      *[F.max(F.when(F.col("_m") == i, F.col("_rn"))).alias(f"{m}_rank") for i, m in enumerate(METRICS)])
    return back.select("_whole.*", *[f"{m}_rank" for m in METRICS])


def score_rfm(rfm: DataFrame, id_col: str = "customerid", q: int = 5, keep_ranks: bool = False,
              ranges: int | None = None) -> DataFrame:
    """recency/frequency/monetary scores 1..q, ``rfm_score`` digits and
    ``rfm_total = R*100 + F*10 + M``. Recency is reversed (recent = q)."""
    df = with_scalars(metric_ranks(rfm, id_col, ranges), rfm.agg(F.count(F.lit(1)).alias("_n")))
    n = F.col("_n")
    df = df.withColumns({
        "recency_score": (F.lit(q + 1) - quintile_bin("recency_rank", n, q)).cast("int"),
        "frequency_score": quintile_bin("frequency_rank", n, q).cast("int"),
        "monetary_score": quintile_bin("monetary_rank", n, q).cast("int"),
    })
    df = df.withColumns({
        "rfm_score": F.concat(F.col("recency_score").cast("string"), F.col("frequency_score").cast("string"),
                              F.col("monetary_score").cast("string")),
        "rfm_total": (F.col("recency_score") * 100 + F.col("frequency_score") * 10
                      + F.col("monetary_score")).cast("int"),
    }).drop("_n")
    return df if keep_ranks else df.drop(*[f"{m}_rank" for m in METRICS])


def score_distribution(scores: DataFrame) -> DataFrame:
    """Customers per score value for each dimension (long form)."""
    parts = [scores.groupBy(F.lit(d).alias("dimension"), F.col(f"{d}_score").alias("score"))
                   .agg(F.count(F.lit(1)).alias("customer_count")) for d in METRICS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rfm_total_stats(scores: DataFrame) -> DataFrame:
    """Min, max and mean of ``rfm_total``."""
    return scores.agg(F.min("rfm_total").alias("rfm_total_min"), F.max("rfm_total").alias("rfm_total_max"),
                      F.avg(F.col("rfm_total").cast("double")).alias("rfm_total_mean"),
                      F.count(F.lit(1)).alias("total_customers"))


def top_rfm_scores(scores: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most common combined scores (ties by score text).

    A top-k report: the limit is the feature. Partial aggregation keeps the
    group-by small (at most 125 score cells).
    """
    return scores.groupBy("rfm_score").agg(F.count(F.lit(1)).alias("customer_count")) \
                 .orderBy(F.desc("customer_count"), "rfm_score").limit(k)

"""Rule segments and per-segment aggregates.

Segment tables hold one row per customer; every aggregate here groups by
segment, so its output has at most a handful of rows. Shares of the grand
total are computed with a window over that small aggregated result, not
with a second pass over the customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import pct
from ledgerlens.functions.rules import segment_expr
from ledgerlens.functions.scalars import one_row



def _all() -> Window:
    """Whole-result window, used only over per-segment results (a few rows)."""
    return Window.partitionBy()


def assign_segments(scores: DataFrame, mode: str = "last_match") -> DataFrame:
    """Add ``segment`` from the rule table.

    ``last_match`` is what the reference computes: its masks are applied in
    order and a later match overwrites, so "High Value" (a subset of
    "Loyal") never survives. ``first_match`` follows the documented rules.
    """
    return scores.withColumn("segment", segment_expr(mode=mode))


def _money_avg(sum_col, n_col):
    return sum_col.cast("double") / n_col.cast("double")


def segment_metrics(seg: DataFrame) -> DataFrame:
    """Per segment: customers, % of customers, mean R/F/M, revenue, % of revenue."""
    g = seg.where(F.col("segment").isNotNull()).groupBy("segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.avg(F.col("recency").cast("double")).alias("avg_recency"),
        F.avg(F.col("frequency").cast("double")).alias("avg_frequency"),
        F.sum("monetary").alias("_rev"))
    return g.select(
        "segment", "customer_count",
        pct("customer_count", F.sum("customer_count").over(_all())).alias("percentage_of_total"),
        "avg_recency", "avg_frequency",
        _money_avg(F.col("_rev"), F.col("customer_count")).alias("avg_monetary"),
        F.col("_rev").cast("double").alias("total_revenue"),
        pct(F.col("_rev"), F.sum("_rev").over(_all())).alias("revenue_percentage"))


def segment_ranking(metrics: DataFrame) -> DataFrame:
    """Segments ranked by total revenue (descending, ties by name)."""
    return metrics.select("segment", "total_revenue", F.row_number().over(
        Window.orderBy(F.desc("total_revenue"), "segment")).cast("bigint").alias("segment_rank"))


def segment_totals(seg: DataFrame) -> DataFrame:
    """Total customers, total revenue and number of distinct segments."""
    return seg.agg(F.count(F.lit(1)).alias("total_customers"),
                   F.sum("monetary").cast("double").alias("total_revenue"),
                   F.count_distinct("segment").alias("unique_segments"))


def segment_counts(seg: DataFrame) -> DataFrame:
    """Customers per segment (value counts; ties by name)."""
    return seg.where(F.col("segment").isNotNull()).groupBy("segment") \
              .agg(F.count(F.lit(1)).alias("customer_count"))


def segment_summary(seg: DataFrame) -> DataFrame:
    """Per segment: customers, revenue, % of customers and revenue, mean M/R/F."""
    m = segment_metrics(seg)
    return m.select("segment", "customer_count", "total_revenue",
                    F.col("percentage_of_total").alias("customer_percentage"),
                    "revenue_percentage", "avg_monetary", "avg_recency", "avg_frequency")


def segment_score_summary(seg: DataFrame) -> DataFrame:
    """Mean ``rfm_total`` and mean monetary per segment."""
    return seg.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.avg(F.col("rfm_total").cast("double")).alias("avg_rfm_score"),
        _money_avg(F.sum("monetary"), F.count(F.lit(1))).alias("avg_monetary"))


def segment_result_shape(seg: DataFrame) -> DataFrame:
    """One row with the segment counts, revenue-share map and ranking."""
    m = segment_metrics(seg)
    r = segment_ranking(m)
    one = m.agg(F.map_from_entries(F.collect_list(F.struct("segment", "customer_count"))).alias("segment_counts"),
                F.map_from_entries(F.collect_list(F.struct("segment", "revenue_percentage")))
                 .alias("revenue_contribution"))
    rk = r.agg(F.map_from_entries(F.collect_list(F.struct("segment_rank", "segment"))).alias("segment_ranking"))
    return one_row(one, rk)


def segment_results(seg: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """The stored segment record: scores, raw values, segment, cluster id
    and the segment's revenue rank. The ranking table has one row per
    segment (broadcast); segments ⋈ clusters is a customer-keyed join."""
    rank = F.broadcast(segment_ranking(segment_metrics(seg)).select("segment", "segment_rank"))
    base = seg
    if clusters is not None:
        base = base.join(clusters.select("customerid", "cluster_id"), "customerid", "left")
    else:
        base = base.withColumn("cluster_id", F.lit(None).cast("int"))
    out = base.join(rank, "segment", "left")
    return out.select(F.col("customerid").alias("customer_id"), F.col("segment").alias("segment_name"),
                      "rfm_score", "rfm_total", "recency_score", "frequency_score", "monetary_score",
                      "recency", "frequency", F.col("monetary").cast("double").alias("monetary"),
                      "cluster_id", "segment_rank")

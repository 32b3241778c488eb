"""All sections of a dashboard or an insight page from one aggregate (D-8, I6, I8).

``cube`` reads a segment table once: ``GROUPING SETS`` over nothing, the segment, and the
segment with the month give totals, segments and trends together, a few rows that
are stored. Each section is then a selection of those rows. Medians and scatter points are not sums,
so they read the table themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import as_timestamp, parse_timestamp
from ledgerlens.functions.rules import HEALTHY_SEGMENTS
from ledgerlens.operators import dashboard, insight
from ledgerlens.session import stored

#: ``grouping_id`` over (segment, year_month) of a total, a segment's and a month's row.
TOTAL, SEGMENT, MONTH = 3, 1, 0


def cube(seg: DataFrame) -> DataFrame:
    """(level, segment, year_month, customers, revenue, recency_sum, recency_count, recency_max), stored.
    Without a date column there are no months; rows of an unreadable date are in no month's row but in a null one."""
    date = next((c for c in dashboard.DATE_COLUMNS if c in seg.columns), None)
    month = F.lit(None).cast("string")
    if date:
        is_date = dict(seg.dtypes)[date].startswith(("timestamp", "date"))
        month = F.date_format(as_timestamp(date) if is_date else parse_timestamp(date), "yyyy-MM")
    rows = seg.select("segment", month.alias("year_month"), "monetary", F.col("recency").cast("double").alias("recency"))
    sets = [[], ["segment"], ["segment", "year_month"]] if date else [[], ["segment"]]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], "segment", "year_month")
    return stored(grouped.agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("revenue"),
                              F.sum("recency").alias("recency_sum"), F.count("recency").alias("recency_count"), F.max("recency").alias("recency_max")), "sections")


def kpi(cube: DataFrame) -> DataFrame:
    """D-1; no rows give zeros."""
    def total(c: str):
        return F.max(F.when(F.col("level") == TOTAL, F.col(c)))

    def customers(*names: str):
        return F.coalesce(F.sum(F.when((F.col("level") == SEGMENT) & F.col("segment").isin(*names), F.col("customers"))), F.lit(0))

    return dashboard.kpi_row(cube.agg(
        F.coalesce(total("customers"), F.lit(0)).alias("total_customers"), total("revenue").alias("_rev"), customers(*HEALTHY_SEGMENTS).alias("_healthy"),
        customers("At Risk").alias("_at_risk"), customers("New").alias("new_customers"), customers("Low Engagement").alias("low_engagement_customers"),
        F.sum(F.when((F.col("level") == SEGMENT) & (F.col("segment") == "High Value"), F.col("revenue"))).alias("_hv_rev"),
        F.try_divide(total("recency_sum"), total("recency_count")).alias("_avg_rec"), total("recency_max").alias("_max_rec")))


def _segments(cube: DataFrame) -> DataFrame:
    return cube.where(F.col("level") == SEGMENT).select("segment", F.col("revenue").alias("_rev"), F.col("customers").alias("customer_count"))


def revenue_by_segment(cube: DataFrame) -> DataFrame:
    return dashboard.revenue_rows(_segments(cube))


def segment_share(cube: DataFrame) -> DataFrame:
    return dashboard.share_rows(_segments(cube).drop("_rev"))


def monthly_trends(cube: DataFrame) -> DataFrame:
    """D-6 of a table with a date per customer: (year_month, segment, customer_count, revenue)."""
    return cube.where((F.col("level") == MONTH) & F.col("year_month").isNotNull()).select(
        "year_month", "segment", F.col("customers").alias("customer_count"), F.col("revenue").cast("double").alias("revenue"))


def insights(cube: DataFrame, seg: DataFrame) -> dict[str, DataFrame]:
    """I8: the main row, the distribution, the value analysis (its medians read ``seg``) and the opportunities."""
    per = insight.shares(_segments(cube).where(F.col("segment").isNotNull()))
    return {"main": insight.main_row(cube.agg(F.max(F.when(F.col("level") == TOTAL, F.col("customers"))).alias("_n"),
                                              F.max(F.when(F.col("level") == TOTAL, F.col("revenue"))).alias("_rev")), per),
            "segment_distribution": per.select("segment", "customer_count", F.col("customer_pct").alias("percentage")),
            "segment_value_analysis": insight.value_rows(_segments(cube), seg), "growth_opportunities": insight.opportunity_rows(per)}

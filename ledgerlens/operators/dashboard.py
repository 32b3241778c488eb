"""Dashboard aggregates (D-1 to D-8) and their filters.

All sections read one (optionally filtered) segment table; callers that
build several sections should cache it once (see :func:`dashboard`).
Values are returned unrounded; ``digits`` on the presentation helpers
rounds for display.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import as_timestamp, parse_timestamp, pct
from ledgerlens.functions.rules import HEALTHY_SEGMENTS
from ledgerlens.functions.scalars import with_scalars

# The message of an empty selection.
NO_DATA = "No data matches the specified filters."
# The date columns that the filter looks for, in order.
DATE_COLUMNS = ("invoicedate", "invoice_date", "date", "order_date")

# ------------------------------------------------------------------ filters

def parse_segments(text: str | None) -> list[str]:
    """F19 (driver side): comma list to trimmed names, blanks dropped."""
    if not text:
        return []
    return [s.strip() for s in text.split(",") if s.strip()]


def parse_segments_col(c: str | Column) -> Column:
    """F19 as an expression over a text column."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def filter_segments(df: DataFrame, segments: Sequence[str] | None) -> DataFrame:
    """keep the listed segments (names trimmed); an empty list keeps all."""
    valid = [s.strip() for s in (segments or []) if s and s.strip()]
    return df.where(F.col("segment").isin(valid)) if valid else df


def filter_dates(df: DataFrame, date_from: str | None = None, date_to: str | None = None,
                 strict: bool = False) -> DataFrame:
    """inclusive date range on the first present date column.

    With no date column the filter is skipped, as in the reference. Bounds
    and text dates are read as the cleaner reads dates: a zone is converted
    to UTC, fractions of a second count. A bound that does not parse is
    ignored, unless ``strict`` (the insight routes treat it as an error).
    ``date_to`` is midnight inclusive.
    """
    col = next((c for c in DATE_COLUMNS if c in df.columns), None)
    if col is None or not (date_from or date_to):
        return df
    is_date = dict(df.dtypes)[col].startswith(("timestamp", "date"))
    ts = as_timestamp(col) if is_date else parse_timestamp(col)
    for bound, op in ((date_from, "ge"), (date_to, "le")):
        if not bound:
            continue
        # whether it parses decides if there is a filter; a constant over a local row starts no job
        parsed = df.sparkSession.sql("VALUES (1)").select(parse_timestamp(F.lit(bound)).isNotNull()).first()[0]
        if not parsed:
            if strict:
                raise ValueError(f"not a date: {bound!r}")
            continue
        df = df.where(ts >= parse_timestamp(F.lit(bound))) if op == "ge" else df.where(ts <= parse_timestamp(F.lit(bound)))
    return df


def apply_filters(df: DataFrame, segments: Sequence[str] | None = None, date_from: str | None = None,
                  date_to: str | None = None) -> DataFrame:
    return filter_dates(filter_segments(df, segments), date_from, date_to)


# ------------------------------------------------------------------ sections

def kpi_summary(seg: DataFrame) -> DataFrame:
    """D-1: one KPI row; an empty input gives zeros."""
    s, m = F.col("segment"), F.col("monetary")
    agg = seg.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum(m).alias("_rev"),
        F.count_if(s.isin(HEALTHY_SEGMENTS)).alias("_healthy"),
        F.count_if(s == "At Risk").alias("_at_risk"),
        F.count_if(s == "New").alias("new_customers"),
        F.count_if(s == "Low Engagement").alias("low_engagement_customers"),
        F.sum(F.when(s == "High Value", m)).alias("_hv_rev"),
        F.avg(F.col("recency").cast("double")).alias("_avg_rec"),
        F.max("recency").alias("_max_rec"))
    return kpi_row(agg)


def kpi_row(agg: DataFrame) -> DataFrame:
    """The KPI figures from their sums and counts (one row)."""
    rev = F.coalesce(F.col("_rev").cast("double"), F.lit(0.0))
    n = F.col("total_customers")
    return agg.select(
        "total_customers", rev.alias("total_revenue"),
        F.coalesce(F.try_divide(rev, n.cast("double")), F.lit(0.0)).alias("avg_customer_value"),
        F.coalesce(pct("_healthy", n), F.lit(0.0)).alias("healthy_percentage"),
        F.coalesce(pct("_at_risk", n), F.lit(0.0)).alias("at_risk_percentage"),
        "new_customers", "low_engagement_customers",
        F.when(rev > 0, F.coalesce(pct(F.coalesce("_hv_rev", F.lit(0)), rev), F.lit(0.0)))
         .otherwise(F.lit(0.0)).alias("high_value_revenue_percentage"),
        F.coalesce("_avg_rec", F.lit(0.0)).alias("avg_recency_days"),
        F.coalesce(F.col("_max_rec").cast("bigint"), F.lit(0).cast("bigint")).alias("max_recency_days"))


def metric_cards(kpi: DataFrame) -> DataFrame:
    """D-2: the five formatted cards (label, value) from a KPI row."""
    def card(pos, label, value):
        return F.struct(F.lit(pos).alias("position"), F.lit(label).alias("label"), value.alias("value"))

    cards = F.array(
        card(1, "Total Customers", F.format_number(F.col("total_customers"), 0)),
        card(2, "Total Revenue", F.concat(F.lit("$"), F.format_number("total_revenue", 0))),
        card(3, "Avg Customer Value", F.concat(F.lit("$"), F.format_number("avg_customer_value", 0))),
        card(4, "Healthy %", F.format_string("%.1f%%", F.col("healthy_percentage"))),
        card(5, "At Risk %", F.format_string("%.1f%%", F.col("at_risk_percentage"))))
    return kpi.select(F.explode(cards).alias("c")).select("c.*")


def revenue_by_segment(seg: DataFrame) -> DataFrame:
    """D-3: revenue, customers, mean and % of revenue per segment, largest first."""
    return revenue_rows(seg.groupBy("segment").agg(F.sum("monetary").alias("_rev"), F.count(F.lit(1)).alias("customer_count")))


def revenue_rows(g: DataFrame) -> DataFrame:
    """D-3 from (segment, _rev, customer_count)."""
    w = Window.partitionBy()  # over the per-segment result only
    return g.select("segment", F.col("_rev").cast("double").alias("total_revenue"), "customer_count",
                    (F.col("_rev").cast("double") / F.col("customer_count").cast("double")).alias("avg_revenue"),
                    pct("_rev", F.sum("_rev").over(w)).alias("percentage")) \
            .orderBy(F.desc("total_revenue"), "segment")


def segment_share(seg: DataFrame) -> DataFrame:
    """D-4: customers and % per segment, largest first."""
    return share_rows(seg.groupBy("segment").agg(F.count(F.lit(1)).alias("customer_count")))


def share_rows(g: DataFrame) -> DataFrame:
    """D-4 from (segment, customer_count)."""
    return g.select("segment", "customer_count",
                    pct("customer_count", F.sum("customer_count").over(Window.partitionBy())).alias("percentage")) \
            .orderBy(F.desc("customer_count"), "segment")


def scatter_points(seg: DataFrame) -> DataFrame:
    """D-5: one point per customer: (segment, customer, frequency, monetary).

    Kept flat: nesting all points of a segment into one row would gather a
    whole segment into one task.
    """
    return seg.select("segment", "customerid", F.col("frequency").cast("bigint").alias("x"),
                      F.col("monetary").cast("double").alias("y"))


def _join_customers(tx: DataFrame, seg: DataFrame) -> DataFrame:
    return tx.join(seg.select("customerid", "segment"), "customerid")


def monthly_trends(tx: DataFrame, seg: DataFrame, date_col: str = "invoicedate") -> DataFrame:
    """D-6: by (month, segment): transactions, distinct customers, line revenue.

    Transactions carry the dates; the segment comes from the customer table.
    ``customer_count`` counts distinct customers of the month (a customer's
    lines are ``transaction_count``).
    """
    j = _join_customers(tx, seg).withColumn("year_month", F.date_format(as_timestamp(date_col), "yyyy-MM"))
    return j.groupBy("year_month", "segment").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.count_distinct("customerid").alias("customer_count"),
        F.sum("total_revenue").cast("double").alias("revenue"))


def monthly_trends_filled(trends: DataFrame) -> DataFrame:
    """Every (month, segment) pair, zero where a segment has no sales
    that month (no cross join, no job while the plan is built)."""
    # One row per month with its segments' revenue as a map, and the names present in any
    # month (a few, from the rules) as a scalar; rows without a segment are in no pair. The
    # names are the maps' keys, so that both come from one aggregation of the transactions.
    named = trends.where(F.col("segment").isNotNull()).groupBy("year_month", "segment").agg(F.sum("revenue").alias("revenue"))
    months = named.groupBy("year_month").agg(F.map_from_entries(F.collect_list(F.struct("segment", "revenue"))).alias("_by"))
    months = with_scalars(months, months.select(F.explode(F.map_keys("_by")).alias("segment")).agg(F.array_sort(F.collect_set("segment")).alias("_names")))
    return months.select("year_month", F.explode("_names").alias("segment"), "_by") \
                 .select("year_month", "segment", F.coalesce(F.try_element_at("_by", "segment"), F.lit(0.0)).alias("revenue"))


def monthly_trends_simulated(seg: DataFrame, as_of: str | _dt.date) -> DataFrame:
    """D-7: without a date column the reference spreads each segment evenly
    over 12 month labels 30 days apart ending at ``as_of``: revenue / 12 and
    customers // 12 (+1 in the ``as_of`` month number). Labels that repeat
    are summed, as the chart does."""
    as_of_d = _dt.date.fromisoformat(str(as_of)[:10])
    per = seg.groupBy("segment").agg(F.count(F.lit(1)).alias("_n"), F.sum("monetary").alias("_rev"))
    offs = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("_i")
    grid = per.select("segment", "_n", "_rev", offs)
    day = F.date_sub(F.lit(as_of_d), F.col("_i") * 30)
    grid = grid.withColumn("year_month", F.date_format(day, "yyyy-MM"))
    bump = F.when(F.month(day) == F.lit(as_of_d.month), 1).otherwise(0)
    grid = grid.withColumn("_cnt", F.floor(F.col("_n") / 12).cast("bigint") + bump) \
               .withColumn("_r", F.col("_rev").cast("double") / F.lit(12.0))
    return grid.groupBy("year_month", "segment").agg(F.sum("_cnt").alias("customer_count"),
                                                     F.sum("_r").alias("revenue"))


def dashboard(seg: DataFrame, tx: DataFrame | None = None, segments: Sequence[str] | None = None,
              date_from: str | None = None, date_to: str | None = None,
              as_of: str | None = None) -> dict[str, DataFrame]:
    """D-8: every section over one filtered segment table. All aggregates come from one
    grouping-sets pass (``sections.cube``); only the scatter points read the rows again.
    ``status`` says whether any row is left. A table with a date column has its own monthly trends."""
    from ledgerlens.operators import sections

    base = apply_filters(seg, segments, date_from, date_to)
    cube = sections.cube(base)
    kpi = sections.kpi(cube)
    some = F.col("total_customers") > 0
    out = {"status": kpi.select(some.alias("has_data"), F.when(~some, F.lit(NO_DATA)).alias("message")), "kpi": kpi,
           "revenue_by_segment": sections.revenue_by_segment(cube), "segment_share": sections.segment_share(cube), "scatter": scatter_points(base)}
    if tx is not None:
        out["monthly_trends"] = monthly_trends(filter_dates(tx, date_from, date_to), base)
    elif any(c in base.columns for c in DATE_COLUMNS):
        out["monthly_trends"] = sections.monthly_trends(cube)
    elif as_of is not None:
        out["monthly_trends"] = monthly_trends_simulated(base, as_of)
    out["metric_cards"] = metric_cards(kpi)
    return out

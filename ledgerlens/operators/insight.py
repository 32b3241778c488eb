"""Insight aggregates (I1-I10) over a segment table.

Each insight is a small aggregate by segment; selections such as "the top
segment" are a sort of at most a handful of rows with a name tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import pct, plain_number
from ledgerlens.functions.rules import (AT_RISK_RECOVERY_RATE, EXECUTIVE_SENTENCES, HIGH_VALUE_EXPANSION_RATE, LOYAL_AT_RISK_RATE,
                                        NEW_CONVERSION_RATE, OPPORTUNITY_TEXT)
from ledgerlens.operators.rank import exact_quantiles
from ledgerlens.functions.scalars import one_row


def _per_segment(seg: DataFrame) -> DataFrame:
    # rows without a segment are in no group
    g = (seg.where(F.col("segment").isNotNull()).groupBy("segment")
         .agg(F.count(F.lit(1)).alias("customer_count"), F.sum("monetary").alias("_rev")))
    return shares(g)


def shares(g: DataFrame) -> DataFrame:
    """Revenue, mean value and shares from (segment, customer_count, _rev)."""
    w = Window.partitionBy()  # over the per-segment rows only
    return g.select("segment", "customer_count", F.col("_rev").cast("double").alias("total_revenue"),
                    (F.col("_rev").cast("double") / F.col("customer_count").cast("double")).alias("avg_value"),
                    pct("customer_count", F.sum("customer_count").over(w)).alias("customer_pct"),
                    pct("_rev", F.sum("_rev").over(w)).alias("revenue_pct"))


def top_revenue_segment(seg: DataFrame) -> DataFrame:
    """Segment with the largest revenue, its % of revenue and customers."""
    return _top(_per_segment(seg))


def _top(p: DataFrame) -> DataFrame:
    return p.orderBy(F.desc("total_revenue"), "segment").limit(1).select(
        "segment", "total_revenue", F.col("revenue_pct").alias("percentage_of_total"), "customer_count")


def largest_segment(seg: DataFrame) -> DataFrame:
    """Segment with the most customers, its % of customers and mean value."""
    return _largest(_per_segment(seg))


def _largest(p: DataFrame) -> DataFrame:
    return p.orderBy(F.desc("customer_count"), "segment").limit(1).select(
        "segment", "customer_count", F.col("customer_pct").alias("percentage_of_total"),
        F.col("avg_value").alias("avg_customer_value"))


def at_risk_volume(seg: DataFrame) -> DataFrame:
    """At-risk customers, % of base, revenue, mean and 30 % recovery;
    zeros when there are none."""
    risk = F.col("segment") == "At Risk"
    a = seg.agg(F.count(F.lit(1)).alias("_n"), F.count_if(risk).alias("at_risk_count"),
                F.sum(F.when(risk, F.col("monetary"))).alias("_rev"))
    rev = F.coalesce(F.col("_rev").cast("double"), F.lit(0.0))
    has = F.col("at_risk_count") > 0
    return a.select("at_risk_count",
                    F.when(has, pct("at_risk_count", "_n")).otherwise(F.lit(0.0)).alias("percentage_of_total"),
                    rev.alias("total_at_risk_revenue"),
                    F.when(has, rev / F.col("at_risk_count").cast("double")).otherwise(F.lit(0.0))
                     .alias("avg_customer_value"),
                    (rev * F.lit(AT_RISK_RECOVERY_RATE)).alias("recovery_potential"))


def segment_value_analysis(seg: DataFrame) -> DataFrame:
    """Mean, median, total and count of monetary per segment.
    Medians are exact and computed without gathering a segment in one task."""
    return value_rows(seg.groupBy("segment").agg(F.sum("monetary").alias("_rev"), F.count(F.lit(1)).alias("customer_count")), seg)


def value_rows(g: DataFrame, seg: DataFrame) -> DataFrame:
    """I4 from (segment, _rev, customer_count) and the rows that give the medians."""
    med = exact_quantiles(seg, "monetary", [0.5], ["segment"], ["median_monetary"])
    return g.join(med, "segment", "left").select(
        "segment", (F.col("_rev").cast("double") / F.col("customer_count").cast("double")).alias("avg_monetary"),
        "median_monetary", F.col("_rev").cast("double").alias("total_revenue"), "customer_count")


def growth_opportunities(seg: DataFrame) -> DataFrame:
    """One row per opportunity whose segment is present.

    high_value_expansion: 15 % of High Value revenue; loyal_retention: 10 %
    of Loyal revenue at risk; new_customer_conversion: 30 % of New customers
    (rounded half-even) times their mean value; at_risk_recovery: mean x
    count x 30 % of At Risk.
    """
    return opportunity_rows(_per_segment(seg))


def opportunity_rows(p: DataFrame) -> DataFrame:
    """I5 from the segments' shares."""
    text = {k: (d, a) for k, d, a in OPPORTUNITY_TEXT}
    key_of = {"High Value": "high_value_expansion", "Loyal": "loyal_retention",
              "New": "new_customer_conversion", "At Risk": "at_risk_recovery"}
    seg_c, rev, n, mean = F.col("segment"), F.col("total_revenue"), F.col("customer_count"), F.col("avg_value")
    upside = F.bround(n.cast("double") * F.lit(NEW_CONVERSION_RATE), 0)
    value = (F.when(seg_c == "High Value", rev * F.lit(HIGH_VALUE_EXPANSION_RATE))
              .when(seg_c == "Loyal", rev * F.lit(LOYAL_AT_RISK_RATE))
              .when(seg_c == "New", mean * upside)
              .when(seg_c == "At Risk", mean * n.cast("double") * F.lit(AT_RISK_RECOVERY_RATE)))
    opp = F.create_map(*[x for s, k in key_of.items() for x in (F.lit(s), F.lit(k))])[seg_c]
    desc = F.create_map(*[x for k, (d, _) in text.items() for x in (F.lit(k), F.lit(d))])
    act = F.create_map(*[x for k, (_, a) in text.items() for x in (F.lit(k), F.lit(a))])
    out = p.where(seg_c.isin(list(key_of))).select(
        opp.alias("opportunity"), "segment", F.col("customer_count").alias("current_size"),
        value.alias("estimated_value"),
        F.when(seg_c == "New", upside).alias("conversion_potential"))
    return out.withColumn("description", desc[F.col("opportunity")]).withColumn("action", act[F.col("opportunity")])


def insight_totals(seg: DataFrame) -> DataFrame:
    """I6 scalars: customers, revenue, mean value, segments and opportunities present."""
    a = seg.agg(F.count(F.lit(1)).alias("total_customers"), F.sum("monetary").alias("_rev"),
                F.count_distinct("segment").alias("segment_count"),
                F.count_distinct(F.when(F.col("segment").isin("High Value", "Loyal", "New", "At Risk"),
                                        F.col("segment"))).alias("opportunity_count"))
    return a.select("total_customers", F.coalesce(F.col("_rev").cast("double"), F.lit(0.0)).alias("total_revenue"),
                    F.coalesce(F.try_divide(F.col("_rev").cast("double"), F.col("total_customers").cast("double")),
                               F.lit(0.0)).alias("avg_customer_value"),
                    "segment_count", "opportunity_count")


def executive_sentences(seg: DataFrame) -> DataFrame:
    """The executive statements built from I1-I3 and I5 (one row).

    Percentages and money are shown rounded to 2 digits, as the reference
    stores them before formatting."""
    top = top_revenue_segment(seg).select(F.col("segment").alias("t_seg"), F.col("percentage_of_total").alias("t_pct"),
                                          F.col("customer_count").alias("t_n"))
    big = largest_segment(seg).select(F.col("segment").alias("l_seg"), F.col("customer_count").alias("l_n"),
                                      F.col("percentage_of_total").alias("l_pct"))
    risk = at_risk_volume(seg)
    opp = growth_opportunities(seg).agg(F.count(F.lit(1)).alias("opp_n"))
    one = one_row(top, big, risk, opp)
    focus, volume, alert, found = EXECUTIVE_SENTENCES
    return one.select(
        F.format_string(focus, "t_seg", plain_number("t_pct"), "t_n").alias("revenue_focus"),
        F.format_string(volume, "l_seg", "l_n", plain_number("l_pct")).alias("volume_focus"),
        F.when(F.col("at_risk_count") > 0, F.format_string(
            alert, "at_risk_count", plain_number("percentage_of_total"), plain_number("total_at_risk_revenue"))).alias("risk_alert"),
        F.when(F.col("opp_n") > 0, F.format_string(found, "opp_n")).alias("opportunity_count"))


def filtered_insights(seg: DataFrame, segments: Sequence[str] | None = None, date_from: str | None = None,
                      date_to: str | None = None) -> DataFrame:
    """I8: the main insights after the segment / date filters (one row).

    Unlike the dashboard, a date bound that does not parse is an error."""
    from ledgerlens.operators.dashboard import filter_dates, filter_segments
    f = filter_dates(filter_segments(seg, segments), date_from, date_to, strict=True)
    return main_row(f.agg(F.count(F.lit(1)).alias("_n"), F.sum("monetary").alias("_rev")), _per_segment(f))


def main_row(total: DataFrame, per: DataFrame) -> DataFrame:
    """I8's main row from the totals (_n, _rev) and the segments' shares."""
    top = _top(per).select(F.col("segment").alias("top_revenue_segment"), F.col("total_revenue").alias("top_revenue"))
    big = _largest(per).select(F.col("segment").alias("largest_segment"), F.col("customer_count").alias("largest_count"))
    risk = F.when(F.col("segment") == "At Risk", F.col("total_revenue"))
    at_risk = per.agg(F.coalesce(F.sum(F.when(F.col("segment") == "At Risk", F.col("customer_count"))), F.lit(0)).alias("at_risk_count"),
                      F.coalesce(F.sum(risk), F.lit(0.0)).alias("total_at_risk_revenue"),
                      (F.coalesce(F.sum(risk), F.lit(0.0)) * F.lit(AT_RISK_RECOVERY_RATE)).alias("recovery_potential"))
    figures = total.select(F.coalesce("_n", F.lit(0)).alias("total_customers"), F.coalesce(F.col("_rev").cast("double"), F.lit(0.0)).alias("total_revenue"))
    return one_row(figures, top, big, at_risk)


def filtered_sections(seg: DataFrame, segments: Sequence[str] | None = None, date_from: str | None = None,
                      date_to: str | None = None) -> dict[str, DataFrame]:
    """I8: every section after the filters: the main row, the distribution with
    percentages, the value analysis and the growth opportunities."""
    from ledgerlens.operators import sections
    from ledgerlens.operators.dashboard import filter_dates, filter_segments
    f = filter_dates(filter_segments(seg, segments), date_from, date_to, strict=True)
    return sections.insights(sections.cube(f), f)


def generate_insights(seg: DataFrame) -> dict[str, DataFrame]:
    """All insight tables over one segment table (a stored stage: each section scans it)."""
    return {"totals": insight_totals(seg), "top_revenue_segment": top_revenue_segment(seg),
            "largest_segment": largest_segment(seg), "at_risk": at_risk_volume(seg),
            "segment_value_analysis": segment_value_analysis(seg),
            "growth_opportunities": growth_opportunities(seg),
            "distribution": seg.where(F.col("segment").isNotNull()).groupBy("segment").agg(F.count(F.lit(1)).alias("customer_count")),
            "executive_summary": executive_sentences(seg)}

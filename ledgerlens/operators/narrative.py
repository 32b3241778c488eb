"""Generated summaries (N1-N6): text assembled from aggregates.

No language model is involved: the reference fills sentence templates
from per-segment metrics. Here the metrics are a small aggregate, the
templates are ``format_string`` / ``format_number`` expressions, and the
playbook is a small fixed table joined by segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import pct
from ledgerlens.functions.rules import (EXECUTIVE_AT_RISK, EXECUTIVE_BULLETS, EXECUTIVE_HIGH_VALUE, EXECUTIVE_NEW,
                                        EXECUTIVE_OPENING, EXECUTIVE_PRIORITIES, GROWTH_SIGNALS, PLAYBOOK_DEFAULT, RISK_ACTION, RISK_ACTION_NONE,
                                        RISK_URGENCY_HIGH_PCT, RISK_URGENCY_MEDIUM_PCT, SEGMENT_PLAYBOOK)
from ledgerlens.functions.scalars import with_scalars
from ledgerlens.sources.io import write_summary


def narrative_metrics(seg: DataFrame) -> DataFrame:
    """Per segment: customers, revenue, mean revenue, % customers, % revenue
    (0 when total revenue is not positive), largest revenue first."""
    # rows without a segment are in no group
    g = (seg.where(F.col("segment").isNotNull()).groupBy("segment")
         .agg(F.count(F.lit(1)).alias("customer_count"), F.sum("monetary").alias("_rev")))
    w = Window.partitionBy()  # over the per-segment rows only
    tot = F.sum("_rev").over(w)
    return g.select("segment", "customer_count", F.col("_rev").cast("double").alias("total_revenue"),
                    (F.col("_rev").cast("double") / F.col("customer_count").cast("double")).alias("avg_revenue"),
                    pct("customer_count", F.sum("customer_count").over(w)).alias("percentage_of_customers"),
                    F.when(tot > 0, pct("_rev", tot)).otherwise(F.lit(0.0)).alias("percentage_of_revenue")) \
            .orderBy(F.desc("total_revenue"), "segment")


def playbook_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEGMENT_PLAYBOOK, "segment string, headline string, description string, "
                                                   "action string, urgency string")


def segment_playbook(metrics: DataFrame) -> DataFrame:
    """Headline / detail / action / urgency per segment, with the default
    playbook for unknown segments (the playbook is a 5-row broadcast)."""
    pb = F.broadcast(playbook_table(metrics.sparkSession))
    j = metrics.join(pb, "segment", "left")
    h, d, a, u = PLAYBOOK_DEFAULT
    seg = F.col("segment")
    headline = F.coalesce("headline", F.format_string(h.replace("{seg}", "%s"), seg))
    desc = F.coalesce("description", F.format_string(d.replace("{seg}", "%s"), seg))
    detail = F.concat(
        F.format_number("customer_count", 0), F.lit(" customers ("),
        F.format_string("%.1f", F.col("percentage_of_customers")), F.lit("% of base), $"),
        F.format_number("total_revenue", 0), F.lit(" revenue ("),
        F.format_string("%.1f", F.col("percentage_of_revenue")), F.lit("% of total). "), desc)
    return j.select("segment", "customer_count", "total_revenue", "percentage_of_customers", "percentage_of_revenue",
                    headline.alias("headline"), detail.alias("detail"),
                    F.coalesce("action", F.lit(a)).alias("action"), F.coalesce("urgency", F.lit(u)).alias("urgency"))


def risk_summary(seg: DataFrame) -> DataFrame:
    """At-risk count, revenue, 30 % recovery and urgency tier
    (High above 15 % of customers, Medium above 8 %, else Low)."""
    risk = F.col("segment") == "At Risk"
    a = seg.agg(F.count(F.lit(1)).alias("_n"), F.count_if(risk).alias("at_risk_count"),
                F.sum(F.when(risk, F.col("monetary"))).alias("_rev"))
    rev = F.coalesce(F.col("_rev").cast("double"), F.lit(0.0))
    share = pct("at_risk_count", "_n")
    has = F.col("at_risk_count") > 0
    urgency = (F.when(~has, "Low").when(share > RISK_URGENCY_HIGH_PCT, "High")
                .when(share > RISK_URGENCY_MEDIUM_PCT, "Medium").otherwise("Low"))
    return a.select("at_risk_count", rev.alias("at_risk_revenue"), (rev * F.lit(0.3)).alias("recovery_potential"),
                    urgency.alias("urgency"),
                    F.when(has, F.lit(RISK_ACTION)).otherwise(F.lit(RISK_ACTION_NONE)).alias("recommended_action"))


def growth_signals(seg: DataFrame) -> DataFrame:
    """Uplift per configured segment that is present (4-row config, broadcast)."""
    cfg = seg.sparkSession.createDataFrame([(i, s, f, a) for i, (s, f, a) in enumerate(GROWTH_SIGNALS)],
                                           "position int, segment string, uplift_factor double, action string")
    rev = seg.groupBy("segment").agg(F.sum("monetary").alias("_rev"))
    j = rev.join(F.broadcast(cfg), "segment")
    return j.select("position", "segment", F.concat(F.lit("Grow "), F.col("segment"), F.lit(" segment contribution"))
                    .alias("opportunity"),
                    (F.col("_rev").cast("double") * F.col("uplift_factor")).alias("estimated_uplift"), "action")


def executive_text(metrics: DataFrame, include_risk: bool = True, include_growth: bool = True,
                   totals: DataFrame | None = None) -> DataFrame:
    """Executive paragraph and bullet list (one row) from N1's metrics.

    N1 is pivoted into one row (a few segments), then the sentences are
    ``format_string`` templates; optional parts drop out as nulls. Of equally
    large segments the one with more revenue is named, and percentages are
    shown from their first decimal. ``totals`` (total_customers,
    total_revenue) replaces the metrics' sums, for metrics that were supplied.
    """
    w_rev = Window.orderBy(F.desc("total_revenue"), "segment")
    w_cnt = Window.orderBy(F.desc("customer_count"), F.desc("total_revenue"), "segment")
    ranked = metrics.select("*", F.row_number().over(w_rev).alias("_rr"), F.row_number().over(w_cnt).alias("_rc"))

    def pick(cond, col):
        return F.max(F.when(cond, F.col(col)))

    seg = F.col("segment")
    one = ranked.agg(
        F.sum("customer_count").alias("n"), F.sum("total_revenue").alias("rev"),
        pick(F.col("_rr") == 1, "segment").alias("top_seg"), pick(F.col("_rr") == 1, "percentage_of_revenue").alias("top_pct"),
        pick(F.col("_rc") == 1, "segment").alias("big_seg"), pick(F.col("_rc") == 1, "customer_count").alias("big_n"),
        pick(seg == "High Value", "customer_count").alias("hv_n"),
        pick(seg == "High Value", "percentage_of_revenue").alias("hv_rp"),
        pick(seg == "High Value", "percentage_of_customers").alias("hv_cp"),
        pick(seg == "At Risk", "customer_count").alias("ar_n"), pick(seg == "At Risk", "total_revenue").alias("ar_rev"),
        pick(seg == "New", "customer_count").alias("new_n"))
    if totals is not None:
        one = with_scalars(one.drop("n", "rev"), totals.select(F.col("total_customers").alias("n"), F.col("total_revenue").alias("rev")))

    def number(c):
        return F.format_number(F.col(c) if isinstance(c, str) else c, 0)

    def share(c):
        return F.round(c, 1)

    lines = [F.format_string(EXECUTIVE_OPENING, number("n"), number("rev")),
             F.when(F.col("hv_n").isNotNull(), F.format_string(EXECUTIVE_HIGH_VALUE, number("hv_n"), share("hv_rp"), share("hv_cp")))]
    if include_risk:
        lines.append(F.when(F.col("ar_n").isNotNull(), F.format_string(
            EXECUTIVE_AT_RISK, number("ar_n"), number("ar_rev"), number(F.col("ar_rev") * F.lit(0.3)))))
    if include_growth:
        lines.append(F.when(F.col("new_n").isNotNull(), F.format_string(EXECUTIVE_NEW, number("new_n"))))
    lines.append(F.lit(EXECUTIVE_PRIORITIES))
    top, big, risk, new, last = EXECUTIVE_BULLETS
    bullets = F.array_compact(F.array(
        F.format_string(top, "top_seg", share("top_pct")),
        F.format_string(big, "big_seg", number("big_n")),
        F.when(F.col("ar_n").isNotNull(), F.format_string(risk, number("ar_n"), number("ar_rev"))),
        F.when(F.col("new_n").isNotNull(), F.format_string(new, number("new_n"))),
        F.lit(last)))
    return one.select(F.concat_ws(" ", *lines).alias("summary_text"), bullets.alias("bullets"))


def full_summary(seg: DataFrame, include_risk: bool = True, include_growth: bool = True,
                 supplied_metrics: DataFrame | None = None) -> dict[str, DataFrame]:
    """All parts of the summary over a segment table (a stored stage: each
    part scans it). ``supplied_metrics`` (N1's schema) replaces the computed
    metrics; the totals always come from the rows."""
    metrics = supplied_metrics if supplied_metrics is not None else narrative_metrics(seg)
    totals = seg.agg(F.count(F.lit(1)).alias("total_customers"),
                     F.coalesce(F.sum("monetary").cast("double"), F.lit(0.0)).alias("total_revenue"))
    out = {"totals": totals, "segment_metrics": metrics,
           "executive": executive_text(metrics, include_risk, include_growth, totals),
           "segment_summaries": segment_playbook(metrics)}
    if include_risk:
        out["risk"] = risk_summary(seg)
    if include_growth:
        out["growth"] = growth_signals(seg)
    return out


def write_full_summary(parts: dict[str, DataFrame], out_dir: str) -> str:
    """S7d: each part of :func:`full_summary` as JSON under ``out_dir``."""
    for name, part in parts.items():
        write_summary(part, f"{out_dir.rstrip('/')}/{name}")
    return out_dir

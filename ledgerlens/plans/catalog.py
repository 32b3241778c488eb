"""Registered queries: one per operator of the inventory, each paired with
its DuckDB oracle SQL when the operator is expressible in SQL.

Every query reads the driver's tables (through the fixture adapter) and
runs the library operator on the whole input. Output columns are aliased
identically on both sides; money is returned as double, timestamps as
ISO-8601 text, so both engines produce comparable values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import iso_string, quintile_bin
from ledgerlens.operators import clean, rfm, score, segment
from ledgerlens.plans import fixture as fx
from ledgerlens.plans.oracle import _bin as oracle_bin
from ledgerlens.plans.oracle import iso, pct, with_chain

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, chain: bool = True):
    """Register a query; ``sql`` is its oracle, prefixed with the shared
    fixture CTE chain unless ``chain=False``."""
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_chain(sql) if chain else sql.strip()
        return fn
    return deco


TX_COLS = ["invoiceno", "stockcode", "description", "quantity", "invoicedate", "unitprice", "customerid", "country"]
TX_SQL = ("invoiceno, stockcode, description, quantity, {date} AS invoicedate, CAST(unitprice AS DOUBLE) AS unitprice, "
          "customerid, country")


def _tx_out(df: DataFrame, date_as_ts: bool = False, extra: list | None = None) -> DataFrame:
    cols = [F.col(c) for c in TX_COLS]
    cols[4] = (iso_string("invoicedate") if date_as_ts else F.col("invoicedate")).alias("invoicedate")
    cols[5] = F.col("unitprice").cast("double").alias("unitprice")
    return df.select(*cols, *(extra or []))


def _money(c: str) -> F.Column:
    return F.col(c).cast("double").alias(c)


# ------------------------------------------------------------------ scans

@register("scan_transactions", f"SELECT {TX_SQL.format(date='invoicedate')} FROM raw")
def q_scan(spark, d):
    return _tx_out(fx.raw(spark, d))


@register("dataset_header", "SELECT CAST(8 AS BIGINT) AS column_count, count(*) AS row_count FROM raw")
def q_header(spark, d):
    from ledgerlens.sources.io import dataset_header
    return dataset_header(fx.raw(spark, d))


# ------------------------------------------------------------------ cleaning rules

@register("dedupe", f"SELECT {TX_SQL.format(date='invoicedate')} FROM d")
def q_dedupe(spark, d):
    return _tx_out(clean.dedupe(fx.raw(spark, d)))


@register("drop_missing_customers", f"""SELECT {TX_SQL.format(date='invoicedate')} FROM raw
  WHERE customerid IS NOT NULL AND customerid <> '' AND lower(customerid) <> 'nan'""")
def q_missing(spark, d):
    return _tx_out(clean.drop_missing_customers(fx.raw(spark, d)))


@register("clean_step1", f"SELECT {TX_SQL.format(date='invoicedate')} FROM i")
def q_step1(spark, d):
    return _tx_out(fx.step1(spark, d))


@register("positive_quantity", f"SELECT {TX_SQL.format(date='invoicedate')} FROM i WHERE quantity > 0")
def q_posq(spark, d):
    return _tx_out(clean.positive_quantity(fx.step1(spark, d)))


@register("positive_price", f"SELECT {TX_SQL.format(date='invoicedate')} FROM i WHERE unitprice > 0")
def q_posp(spark, d):
    return _tx_out(clean.positive_price(fx.step1(spark, d)))


@register("parse_dates", f"""SELECT count(*) AS total_rows, count(ts) AS parsed_count,
  count(*) - count(ts) AS parse_errors, {pct('count(ts)', 'count(*)')} AS success_rate FROM p""")
def q_parse(spark, d):
    return clean.parse_date_stats(fx.step1(spark, d))


@register("drop_invalid_dates", f"""SELECT {TX_SQL.format(date=iso('ts'))} FROM p
  WHERE ts IS NOT NULL AND ts <= TIMESTAMP '{fx.FIXTURE_CUTOFF}'""")
def q_dates(spark, d):
    df = clean.drop_invalid_dates(clean.parse_dates(fx.step1(spark, d)), cutoff=fx.FIXTURE_CUTOFF)
    return _tx_out(df, date_as_ts=True)


@register("drop_cancelled", f"SELECT {TX_SQL.format(date='invoicedate')} FROM i WHERE NOT coalesce(invoiceno LIKE 'C%', false)")
def q_cancel(spark, d):
    return _tx_out(clean.drop_cancelled(fx.step1(spark, d)))


@register("line_revenue", f"SELECT {TX_SQL.format(date='invoicedate')}, CAST(quantity * unitprice AS DOUBLE) AS total_revenue FROM i")
def q_revenue(spark, d):
    return _tx_out(clean.line_revenue(fx.step1(spark, d)), extra=[_money("total_revenue")])


@register("clean_step2", f"""SELECT {TX_SQL.format(date=iso('invoicedate'))},
  CAST(total_revenue AS DOUBLE) AS total_revenue FROM t""")
def q_step2(spark, d):
    return _tx_out(fx.transactions(spark, d), date_as_ts=True, extra=[_money("total_revenue")])


@register("cleaning_waterfall", f"""
, steps AS (
  SELECT (SELECT count(*) FROM raw) AS n_raw, (SELECT count(*) FROM d) AS n_distinct,
         (SELECT count(*) FROM d) - (SELECT count(*) FROM i) AS r2,
         count(*) FILTER (WHERE rule = 3) AS r3, count(*) FILTER (WHERE rule = 4) AS r4,
         count(*) FILTER (WHERE rule = 5) AS r5, count(*) FILTER (WHERE rule = 6) AS r6 FROM cl),
w AS (
  SELECT 1 AS step, 'duplicates' AS rule, n_raw AS rows_before, n_raw - n_distinct AS removed FROM steps
  UNION ALL SELECT 2, 'missing_customer_id', n_distinct, r2 FROM steps
  UNION ALL SELECT 3, 'non_positive_quantity', n_distinct - r2, r3 FROM steps
  UNION ALL SELECT 4, 'non_positive_unit_price', n_distinct - r2 - r3, r4 FROM steps
  UNION ALL SELECT 5, 'invalid_date', n_distinct - r2 - r3 - r4, r5 FROM steps
  UNION ALL SELECT 6, 'cancelled_invoice', n_distinct - r2 - r3 - r4 - r5, r6 FROM steps)
SELECT step, rule, CAST(rows_before AS BIGINT) AS rows_before, CAST(removed AS BIGINT) AS removed,
       CAST(rows_before - removed AS BIGINT) AS rows_after, {pct('removed', 'rows_before')} AS removed_pct FROM w""")
def q_waterfall(spark, d):
    return clean.cleaning_waterfall(fx.raw(spark, d), cutoff=fx.FIXTURE_CUTOFF)


# ------------------------------------------------------------------ recency / RFM base

@register("reference_date", f"""SELECT {iso("max(invoicedate) + INTERVAL 1 DAY")} AS reference_date,
  {iso('max(invoicedate)')} AS max_date_in_data, {iso('min(invoicedate)')} AS min_date_in_data,
  CAST(floor(epoch(max(invoicedate) - min(invoicedate)) / 86400) AS BIGINT) AS date_range_days FROM t""")
def q_refdate(spark, d):
    return rfm.reference_date(fx.transactions(spark, d))


RECENCY_SQL = """SELECT c.customerid, CAST(floor(epoch(ref_ts - last_purchase) / 86400) AS BIGINT) AS recency
  FROM c, ref"""


@register("customer_recency", RECENCY_SQL)
def q_recency(spark, d):
    return rfm.customer_recency(fx.transactions(spark, d))


@register("rfm_base", "SELECT customerid, recency, frequency, CAST(monetary AS DOUBLE) AS monetary FROM r")
def q_base(spark, d):
    return fx.base(spark, d).withColumn("monetary", F.col("monetary").cast("double"))


@register("rfm_base_joined", "SELECT customerid, recency, frequency, CAST(monetary AS DOUBLE) AS monetary FROM r")
def q_base_joined(spark, d):
    tx = fx.transactions(spark, d)
    out = rfm.rfm_base_joined(rfm.customer_recency(tx), rfm.customer_frequency(tx), rfm.customer_monetary(tx))
    return out.withColumn("monetary", F.col("monetary").cast("double"))


# ------------------------------------------------------------------ ranks and scores

@register("global_rank", """SELECT customerid, CAST(rn_r AS BIGINT) AS recency_rank,
  CAST(rn_f AS BIGINT) AS frequency_rank, CAST(rn_m AS BIGINT) AS monetary_rank FROM k""")
def q_rank(spark, d):
    return score.metric_ranks(fx.base(spark, d)).select("customerid", "recency_rank", "frequency_rank", "monetary_rank")


@register("quintile_bins", f"""SELECT customerid, n, CAST({oracle_bin('rn_r')} AS INTEGER) AS recency_bin,
  CAST({oracle_bin('rn_f')} AS INTEGER) AS frequency_bin, CAST({oracle_bin('rn_m')} AS INTEGER) AS monetary_bin FROM k""")
def q_bins(spark, d):
    r = q_rank(spark, d)
    n = F.lit(fx.base(spark, d).count()).cast("bigint")
    return r.select("customerid", n.alias("n"),
                    *[quintile_bin(f"{m}_rank", n).alias(f"{m}_bin") for m in score.METRICS])


def _scores_out(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c == "monetary" else F.col(c) for c in cols])


SCORE_COLS = ["customerid", "recency", "frequency", "monetary", "recency_score", "frequency_score",
              "monetary_score", "rfm_score", "rfm_total"]
SCORE_SQL = ("customerid, recency, frequency, CAST(monetary AS DOUBLE) AS monetary, recency_score, frequency_score, "
             "monetary_score, rfm_score, rfm_total")


@register("score_recency", "SELECT customerid, recency, recency_score FROM s")
def q_score_r(spark, d):
    return fx.scores(spark, d).select("customerid", "recency", "recency_score")


@register("score_frequency", "SELECT customerid, frequency, frequency_score FROM s")
def q_score_f(spark, d):
    return fx.scores(spark, d).select("customerid", "frequency", "frequency_score")


@register("score_monetary", "SELECT customerid, CAST(monetary AS DOUBLE) AS monetary, monetary_score FROM s")
def q_score_m(spark, d):
    return _scores_out(fx.scores(spark, d), ["customerid", "monetary", "monetary_score"])


@register("rfm_scores", f"SELECT {SCORE_SQL} FROM s")
def q_scores(spark, d):
    return _scores_out(fx.scores(spark, d), SCORE_COLS)


@register("score_distribution", """
  SELECT 'recency' AS dimension, recency_score AS score, count(*) AS customer_count FROM s GROUP BY 1, 2
  UNION ALL SELECT 'frequency', frequency_score, count(*) FROM s GROUP BY 1, 2
  UNION ALL SELECT 'monetary', monetary_score, count(*) FROM s GROUP BY 1, 2""")
def q_score_dist(spark, d):
    return score.score_distribution(fx.scores(spark, d))


@register("rfm_total_stats", """SELECT min(rfm_total) AS rfm_total_min, max(rfm_total) AS rfm_total_max,
  avg(CAST(rfm_total AS DOUBLE)) AS rfm_total_mean, count(*) AS total_customers FROM s""")
def q_total_stats(spark, d):
    return score.rfm_total_stats(fx.scores(spark, d))


@register("top_rfm_scores", """SELECT rfm_score, count(*) AS customer_count FROM s GROUP BY rfm_score
  ORDER BY customer_count DESC, rfm_score LIMIT 20""")
def q_top_scores(spark, d):
    return score.top_rfm_scores(fx.scores(spark, d))


# ------------------------------------------------------------------ segments

SEG_SQL = SCORE_SQL + ", segment"


@register("segments", f"SELECT {SEG_SQL} FROM g")
def q_segments(spark, d):
    return _scores_out(fx.segments(spark, d), SCORE_COLS + ["segment"])


@register("segments_documented", f"SELECT {SEG_SQL} FROM gf")
def q_segments_doc(spark, d):
    return _scores_out(fx.segments(spark, d, "first_match"), SCORE_COLS + ["segment"])


def segment_metrics_sql(src: str) -> str:
    return f"""SELECT segment, count(*) AS customer_count,
  {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage_of_total,
  avg(CAST(recency AS DOUBLE)) AS avg_recency, avg(CAST(frequency AS DOUBLE)) AS avg_frequency,
  CAST(sum(monetary) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_monetary,
  CAST(sum(monetary) AS DOUBLE) AS total_revenue,
  {pct('sum(monetary)', 'sum(sum(monetary)) OVER ()')} AS revenue_percentage
  FROM {src} GROUP BY segment"""


@register("segment_metrics", segment_metrics_sql("g"))
def q_seg_metrics(spark, d):
    return segment.segment_metrics(fx.segments(spark, d))


@register("segment_ranking", f"""SELECT segment, total_revenue,
  row_number() OVER (ORDER BY total_revenue DESC, segment) AS segment_rank FROM ({segment_metrics_sql('g')}) m""")
def q_seg_rank(spark, d):
    return segment.segment_ranking(segment.segment_metrics(fx.segments(spark, d)))


@register("segment_totals", """SELECT count(*) AS total_customers, CAST(sum(monetary) AS DOUBLE) AS total_revenue,
  count(DISTINCT segment) AS unique_segments FROM g""")
def q_seg_totals(spark, d):
    return segment.segment_totals(fx.segments(spark, d))


@register("segment_summary", f"""SELECT segment, customer_count, total_revenue, percentage_of_total AS customer_percentage,
  revenue_percentage, avg_monetary, avg_recency, avg_frequency FROM ({segment_metrics_sql('g')}) m""")
def q_seg_summary(spark, d):
    return segment.segment_summary(fx.segments(spark, d))


@register("segment_score_summary", """SELECT segment, count(*) AS customer_count,
  avg(CAST(rfm_total AS DOUBLE)) AS avg_rfm_score,
  CAST(sum(monetary) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_monetary FROM g GROUP BY segment""")
def q_seg_score_summary(spark, d):
    return segment.segment_score_summary(fx.segments(spark, d))

"""Registered queries, second part: exploration profile, recency statistics,
previews and paging, filters, clustering (fixed centroids), dashboard,
insight and narrative tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import cluster, dashboard, insight, narrative, profile, rfm, segment
from ledgerlens.plans import fixture as fx
from ledgerlens.plans.catalog import SCORE_COLS, SCORE_SQL, TX_SQL, _scores_out, _tx_out, register, segment_metrics_sql
from ledgerlens.plans.oracle import iso, pct
from ledgerlens.functions.scalars import one_row

RAW_COLS = ["invoiceno", "stockcode", "description", "quantity", "invoicedate", "unitprice", "customerid", "country"]
RAW_TYPES = ["string", "string", "string", "int", "string", "decimal(12,2)", "string", "string"]

# ------------------------------------------------------------------ exploration

_nulls = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS m{i}" for i, c in enumerate(RAW_COLS))
_union = " UNION ALL ".join(f"SELECT '{c}' AS column_name, m{i} AS null_count, n FROM nn" for i, c in enumerate(RAW_COLS))


@register("missing_values", f""", nn AS (SELECT count(*) AS n, {_nulls} FROM raw)
SELECT column_name, null_count, {pct('null_count', 'n')} AS null_percentage, n - null_count AS non_null_count
FROM ({_union}) x""")
def q_missing_values(spark, d):
    return profile.missing_values(fx.raw(spark, d))


@register("duplicate_counts", f"""SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM d) AS duplicate_rows,
  {pct('count(*) - (SELECT count(*) FROM d)', 'count(*)')} AS duplicate_percentage,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT invoiceno, customerid FROM raw) x) AS key_column_duplicates,
  'invoiceno,customerid' AS key_columns_used FROM raw""")
def q_duplicates(spark, d):
    return profile.duplicate_counts(fx.raw(spark, d))


@register("invalid_values", f"""SELECT count(*) AS total_rows,
  count(*) FILTER (WHERE quantity <= 0) AS quantity_negative_or_zero,
  count(*) FILTER (WHERE quantity < 0) AS quantity_negative,
  count(*) FILTER (WHERE unitprice < 0) AS unitprice_negative,
  count(*) FILTER (WHERE unitprice = 0) AS unitprice_zero,
  count(*) FILTER (WHERE customerid IS NULL) AS customerid_null,
  count(*) FILTER (WHERE try_cast(invoicedate AS TIMESTAMP) IS NULL) AS invoicedate_invalid,
  {pct('count(*) FILTER (WHERE customerid IS NULL)', 'count(*)')} AS customerid_null_percentage,
  {pct('count(*) FILTER (WHERE try_cast(invoicedate AS TIMESTAMP) IS NULL)', 'count(*)')} AS invoicedate_invalid_percentage
  FROM raw""")
def q_invalid(spark, d):
    return profile.invalid_values(fx.raw(spark, d))


def _profile_sql() -> str:
    parts = []
    for i, (c, t) in enumerate(zip(RAW_COLS, RAW_TYPES)):
        if t in ("int", "decimal(12,2)"):
            num = (f"CAST(sum({c}) AS DOUBLE) / CAST(count({c}) AS DOUBLE), CAST(min({c}) AS DOUBLE), "
                   f"CAST(max({c}) AS DOUBLE), round(stddev_samp(CAST({c} AS DOUBLE)), 6), "
                   f"quantile_cont(CAST({c} AS DOUBLE), 0.5)")
        else:
            num = "NULL, NULL, NULL, NULL, NULL"
        parts.append(f"SELECT {i}, '{c}', '{t}', count(DISTINCT {c}), count(*) FILTER (WHERE {c} IS NULL), {num} FROM raw")
    body = " UNION ALL ".join(parts)
    return (f"SELECT CAST(position AS INTEGER) AS position, column_name, dtype, CAST(unique_count AS BIGINT) AS unique_count, "
            f"CAST(null_count AS BIGINT) AS null_count, CAST(mean AS DOUBLE) AS mean, CAST(mn AS DOUBLE) AS min, "
            f"CAST(mx AS DOUBLE) AS max, CAST(sd AS DOUBLE) AS std, CAST(med AS DOUBLE) AS median "
            f"FROM ({body}) AS x(position, column_name, dtype, unique_count, null_count, mean, mn, mx, sd, med)")


@register("column_profile", _profile_sql())
def q_profile(spark, d):
    return profile.column_profile(fx.raw(spark, d))


# ------------------------------------------------------------------ recency statistics

RC = "(SELECT c.customerid, CAST(floor(epoch(ref_ts - last_purchase) / 86400) AS BIGINT) AS recency FROM c, ref)"


@register("recency_stats", f"""SELECT count(recency) AS unique_customers, min(recency) AS recency_min,
  max(recency) AS recency_max, CAST(sum(recency) AS DOUBLE) / CAST(count(recency) AS DOUBLE) AS recency_mean,
  CAST(quantile_cont(recency, 0.5) AS DOUBLE) AS recency_median,
  round(stddev_samp(CAST(recency AS DOUBLE)), 6) AS recency_std FROM {RC} x""")
def q_recency_stats(spark, d):
    return rfm.recency_stats(fx.recency(spark, d))


@register("recency_quartiles", f"""SELECT CAST(quantile_cont(recency, 0.25) AS DOUBLE) AS p25,
  CAST(quantile_cont(recency, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(recency, 0.75) AS DOUBLE) AS p75,
  CAST(quantile_cont(recency, 1.0) AS DOUBLE) AS p100 FROM {RC} x""")
def q_quartiles(spark, d):
    return rfm.recency_quartiles(fx.recency(spark, d))


BUCKETS_SQL = """count(*) FILTER (WHERE recency <= 30) AS recent_0_30_days,
  count(*) FILTER (WHERE recency > 30 AND recency <= 60) AS recent_31_60_days,
  count(*) FILTER (WHERE recency > 60 AND recency <= 90) AS recent_61_90_days,
  count(*) FILTER (WHERE recency > 90) AS recent_90_plus_days"""


@register("recency_buckets", f"SELECT count(*) AS unique_customers, {BUCKETS_SQL} FROM {RC} x")
def q_buckets(spark, d):
    return rfm.recency_buckets(fx.recency(spark, d))


@register("recency_summary", f"""SELECT (SELECT count(*) FROM t) AS total_transactions,
  count(recency) AS unique_customers, min(recency) AS recency_min, max(recency) AS recency_max,
  CAST(sum(recency) AS DOUBLE) / CAST(count(recency) AS DOUBLE) AS recency_mean,
  CAST(quantile_cont(recency, 0.5) AS DOUBLE) AS recency_median,
  round(stddev_samp(CAST(recency AS DOUBLE)), 6) AS recency_std,
  CAST(quantile_cont(recency, 0.25) AS DOUBLE) AS p25, CAST(quantile_cont(recency, 0.5) AS DOUBLE) AS p50,
  CAST(quantile_cont(recency, 0.75) AS DOUBLE) AS p75, CAST(quantile_cont(recency, 1.0) AS DOUBLE) AS p100,
  {BUCKETS_SQL}, CAST(trunc(quantile_cont(recency, 0.5)) AS BIGINT) AS median_days FROM {RC} x""")
def q_recency_summary(spark, d):
    return rfm.recency_summary(fx.transactions(spark, d), fx.recency(spark, d))


@register("transactions_with_recency", f"""SELECT {TX_SQL.format(date=iso('t.invoicedate'))},
  CAST(total_revenue AS DOUBLE) AS total_revenue, x.recency FROM t LEFT JOIN {RC} x USING (customerid)""")
def q_tx_recency(spark, d):
    tx = fx.transactions(spark, d)
    j = rfm.transactions_with_recency(tx, rfm.customer_recency(tx))
    return _tx_out(j, date_as_ts=True, extra=[F.col("total_revenue").cast("double").alias("total_revenue"), "recency"])


@register("finalize_recency", f"SELECT customerid, CAST(recency AS DOUBLE) AS recency FROM {RC} x")
def q_finalize(spark, d):
    return rfm.finalize_recency(fx.recency(spark, d))


@register("validate_rfm_base", """SELECT count(*) FILTER (WHERE customerid IS NULL OR recency IS NULL
  OR frequency IS NULL OR monetary IS NULL) = 0 AS is_valid,
  CASE WHEN sum((customerid IS NULL)::BIGINT + (recency IS NULL)::BIGINT + (frequency IS NULL)::BIGINT
                + (monetary IS NULL)::BIGINT) > 0 THEN 'Found null values in required columns' END AS message,
  CAST(coalesce(sum((customerid IS NULL)::BIGINT + (recency IS NULL)::BIGINT + (frequency IS NULL)::BIGINT
                + (monetary IS NULL)::BIGINT), 0) AS BIGINT) AS null_values FROM r""")
def q_validate(spark, d):
    return rfm.validate_rfm_base(fx.base(spark, d))


@register("customer_frequency", "SELECT customerid, count(DISTINCT invoiceno) AS frequency FROM t GROUP BY customerid")
def q_frequency(spark, d):
    return rfm.customer_frequency(fx.transactions(spark, d))


@register("customer_monetary", """SELECT customerid, CAST(sum(total_revenue) AS DOUBLE) AS monetary FROM t
  GROUP BY customerid HAVING sum(total_revenue) > 0""")
def q_monetary(spark, d):
    return rfm.customer_monetary(fx.transactions(spark, d)).withColumn("monetary", F.col("monetary").cast("double"))


def _stat_sql(c: str, money: bool = False) -> str:
    mn = f"CAST(min({c}) AS DOUBLE)" if money else f"min({c})"
    mx = f"CAST(max({c}) AS DOUBLE)" if money else f"max({c})"
    return (f"{mn} AS {c}_min, {mx} AS {c}_max, CAST(sum({c}) AS DOUBLE) / CAST(count({c}) AS DOUBLE) AS {c}_mean, "
            f"round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS {c}_std, "
            f"CAST(quantile_cont(CAST({c} AS DOUBLE), 0.5) AS DOUBLE) AS {c}_median")


@register("rfm_statistics", f"""SELECT count(*) AS total_customers, {_stat_sql('recency')},
  {_stat_sql('frequency')}, {_stat_sql('monetary', True)} FROM r""")
def q_rfm_stats(spark, d):
    return rfm.rfm_statistics(fx.base(spark, d))


# ------------------------------------------------------------------ previews and paging

@register("recency_preview", f"SELECT customerid, recency FROM {RC} x ORDER BY customerid LIMIT 10")
def q_recency_preview(spark, d):
    return fx.recency(spark, d).orderBy("customerid").limit(10)


@register("scores_preview", f"SELECT {SCORE_SQL} FROM s ORDER BY customerid LIMIT 10")
def q_scores_preview(spark, d):
    return _scores_out(fx.scores(spark, d), SCORE_COLS).orderBy("customerid").limit(10)


PAGE, PAGE_SIZE = 2, 20
PAGE_ORDER = ["invoicedate DESC", "invoiceno", "stockcode", "quantity", "unitprice", "customerid", "description",
              "country"]


@register("paged_listing", f"""SELECT {TX_SQL.format(date=iso('invoicedate'))},
  CAST(total_revenue AS DOUBLE) AS total_revenue, (SELECT count(*) FROM t) AS total,
  CAST(ceil((SELECT count(*) FROM t) / {PAGE_SIZE}.0) AS BIGINT) AS total_pages
  FROM t ORDER BY {', '.join(PAGE_ORDER)} LIMIT {PAGE_SIZE} OFFSET {(PAGE - 1) * PAGE_SIZE}""")
def q_paged(spark, d):
    from ledgerlens.operators.listing import paged
    page = paged(fx.transactions(spark, d), PAGE, PAGE_SIZE, order=[F.desc("invoicedate")] + PAGE_ORDER[1:])
    return _tx_out(page, date_as_ts=True, extra=[F.col("total_revenue").cast("double").alias("total_revenue"),
                                                 "total", "total_pages"])


# ------------------------------------------------------------------ filters

FILTER_SEGMENTS = ["Loyal", " At Risk ", ""]
DATE_FROM, DATE_TO = "1998-01-01", "1998-12-31"


@register("filter_segments", f"SELECT {SCORE_SQL}, segment FROM g WHERE segment IN ('Loyal', 'At Risk')")
def q_filter_segments(spark, d):
    return _scores_out(dashboard.filter_segments(fx.segments(spark, d), FILTER_SEGMENTS), SCORE_COLS + ["segment"])


@register("filter_dates", f"""SELECT {TX_SQL.format(date=iso('t.invoicedate'))},
  CAST(total_revenue AS DOUBLE) AS total_revenue, g.segment FROM t JOIN g USING (customerid)
  WHERE t.invoicedate >= TIMESTAMP '{DATE_FROM} 00:00:00' AND t.invoicedate <= TIMESTAMP '{DATE_TO} 00:00:00'""")
def q_filter_dates(spark, d):
    tx = fx.transactions(spark, d).join(fx.segments(spark, d).select("customerid", "segment"), "customerid")
    f = dashboard.filter_dates(tx, DATE_FROM, DATE_TO)
    return _tx_out(f, date_as_ts=True, extra=[F.col("total_revenue").cast("double").alias("total_revenue"), "segment"])


# ------------------------------------------------------------------ clustering with fixed centroids

def _scaled(spark, d) -> DataFrame:
    return fx.cached(spark, ("scaled", d), lambda: cluster.scale_rfm(fx.segments(spark, d), digits=6))


def _assigned(spark, d) -> DataFrame:
    return cluster.assign_centroids(_scaled(spark, d), fx.FIXED_CENTROIDS,
                                    ["recency_scaled", "frequency_scaled", "monetary_scaled"])


def _fixed_centroids(spark) -> DataFrame:
    return cluster.centroid_frame(spark, fx.FIXED_CENTROIDS, ["recency_scaled", "frequency_scaled", "monetary_scaled"])


def _sd(c):
    return f"CASE WHEN sd_{c} = 0 OR sd_{c} IS NULL THEN 1.0 ELSE sd_{c} END"


def _dist(i, cent):
    terms = [f"({c}_scaled - ({v!r})) * ({c}_scaled - ({v!r}))" for c, v in zip(("recency", "frequency", "monetary"), cent)]
    return " + ".join(terms) + f" AS d{i}"


_K = len(fx.FIXED_CENTROIDS)
_argmin = "CASE " + " ".join(
    f"WHEN {' AND '.join(f'd{i} <= d{j}' for j in range(i + 1, _K))} THEN {i}" for i in range(_K - 1)) + f" ELSE {_K - 1} END"
FIXED_LABELS = ["Cluster_0_Low_Activity", "Cluster_1_Inactive_High_Value", "Cluster_2_Frequent_Low_Value",
                "Cluster_3_Infrequent_High_Value"]
CLUSTER_CTES = f""", st AS (SELECT {', '.join(f"CAST(sum({c}) AS DOUBLE) / CAST(count({c}) AS DOUBLE) AS mu_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS sd_{c}" for c in ('recency', 'frequency', 'monetary'))} FROM g),
sc AS (SELECT g.*, {', '.join(f"round((CAST({c} AS DOUBLE) - mu_{c}) / {_sd(c)}, 6) AS {c}_scaled" for c in ('recency', 'frequency', 'monetary'))} FROM g, st),
dd AS (SELECT sc.*, {', '.join(_dist(i, c) for i, c in enumerate(fx.FIXED_CENTROIDS))} FROM sc),
asg AS (SELECT dd.*, CAST({_argmin} AS INTEGER) AS cluster_id FROM dd),
lab AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{lbl}')" for i, lbl in enumerate(FIXED_LABELS))}) AS v(cluster_id, cluster_label))
"""

SCALED_SQL = "customerid, recency, frequency, CAST(monetary AS DOUBLE) AS monetary, recency_scaled, frequency_scaled, monetary_scaled"
SCALED_COLS = ["customerid", "recency", "frequency", "monetary", "recency_scaled", "frequency_scaled", "monetary_scaled"]


@register("scaled_rfm", f"{CLUSTER_CTES} SELECT {SCALED_SQL} FROM sc")
def q_scaled(spark, d):
    return _scores_out(_scaled(spark, d), SCALED_COLS)


@register("assign_centroids", f"{CLUSTER_CTES} SELECT {SCALED_SQL}, cluster_id FROM asg")
def q_assign(spark, d):
    return _scores_out(_assigned(spark, d), SCALED_COLS + ["cluster_id"])


@register("cluster_labels", f"{CLUSTER_CTES} SELECT customerid, cluster_id, cluster_label FROM asg JOIN lab USING (cluster_id)")
def q_labels(spark, d):
    labels = cluster.cluster_labels(_fixed_centroids(spark))
    return cluster.attach_labels(_assigned(spark, d), labels).select("customerid", "cluster_id", "cluster_label")


def _cluster_metrics_sql() -> str:
    cols = []
    for c in ("recency", "frequency", "monetary"):
        cols += [f"CAST(sum({c}) AS DOUBLE) / CAST(count({c}) AS DOUBLE) AS avg_{c}",
                 f"CAST(min({c}) AS DOUBLE) AS min_{c}", f"CAST(max({c}) AS DOUBLE) AS max_{c}"]
    return f"""ids AS (SELECT CAST(range AS INTEGER) AS cluster_id FROM range({_K})),
cm0 AS (SELECT cluster_id, count(*) AS customer_count, {', '.join(cols)} FROM asg GROUP BY cluster_id),
cm AS (SELECT ids.cluster_id, CAST(coalesce(customer_count, 0) AS BIGINT) AS customer_count,
  {pct('coalesce(customer_count, 0)', '(SELECT count(*) FROM asg)')} AS percentage_of_total,
  {', '.join(f'{p}_{c}' for c in ('recency', 'frequency', 'monetary') for p in ('avg', 'min', 'max'))}
  FROM ids LEFT JOIN cm0 USING (cluster_id))"""


@register("cluster_metrics", f"{CLUSTER_CTES}, {_cluster_metrics_sql()} SELECT * FROM cm")
def q_cluster_metrics(spark, d):
    return cluster.cluster_metrics(_assigned(spark, d), _K)


@register("cluster_summary", f"{CLUSTER_CTES}, {_cluster_metrics_sql()} SELECT cm.*, cluster_label FROM cm LEFT JOIN lab USING (cluster_id) ORDER BY cluster_id")
def q_cluster_summary(spark, d):
    return cluster.cluster_summary(_assigned(spark, d), cluster.cluster_labels(_fixed_centroids(spark)), _K)


_cent_vals = ", ".join(f"({i}, {c[0]!r}, {c[1]!r}, {c[2]!r})" for i, c in enumerate(fx.FIXED_CENTROIDS))


@register("centroid_summary", f"""{CLUSTER_CTES}, {_cluster_metrics_sql()},
cent AS (SELECT * FROM (VALUES {_cent_vals}) AS v(cluster_id, cr, cf, cmn)),
cost AS (SELECT cluster_id, sum((recency_scaled - cr) * (recency_scaled - cr) + (frequency_scaled - cf) * (frequency_scaled - cf)
                + (monetary_scaled - cmn) * (monetary_scaled - cmn)) AS cluster_cost FROM asg JOIN cent USING (cluster_id)
         GROUP BY cluster_id)
SELECT cm.*, round(coalesce(cluster_cost, 0.0), 6) AS cluster_cost,
  round((SELECT sum(cluster_cost) FROM cost) / {float(_K)!r}, 6) AS inertia_contribution
FROM cm LEFT JOIN cost USING (cluster_id)""")
def q_centroid_summary(spark, d):
    out = cluster.centroid_summary(_assigned(spark, d), _fixed_centroids(spark), _K)
    return out.withColumn("cluster_cost", F.round("cluster_cost", 6)) \
              .withColumn("inertia_contribution", F.round("inertia_contribution", 6))


@register("cluster_details", f"{CLUSTER_CTES} SELECT {SCALED_SQL}, cluster_id FROM asg WHERE cluster_id = 1 ORDER BY customerid LIMIT 100")
def q_cluster_details(spark, d):
    return _scores_out(_assigned(spark, d), SCALED_COLS + ["cluster_id"]) \
        .where(F.col("cluster_id") == 1).orderBy("customerid").limit(100)


@register("segment_results", f"""{CLUSTER_CTES},
rk AS (SELECT segment, row_number() OVER (ORDER BY sum(monetary) DESC, segment) AS segment_rank FROM g GROUP BY segment)
SELECT g.customerid AS customer_id, g.segment AS segment_name, g.rfm_score, g.rfm_total, g.recency_score,
  g.frequency_score, g.monetary_score, g.recency, g.frequency, CAST(g.monetary AS DOUBLE) AS monetary,
  asg.cluster_id, rk.segment_rank
FROM g LEFT JOIN asg USING (customerid) LEFT JOIN rk ON g.segment = rk.segment""")
def q_segment_results(spark, d):
    return segment.segment_results(fx.segments(spark, d), _assigned(spark, d))


@register("kmeans_clusters")
def q_kmeans(spark, d):
    """M2/M6: best of 10 K-Means restarts (k=4), ids by centroid order."""
    scaled = cluster.scale_rfm(fx.segments(spark, d))
    assigned, _, _ = cluster.kmeans_clusters(scaled, k=4, seed=42, n_init=10)
    return _scores_out(assigned, SCALED_COLS + ["cluster_id", "cluster_label"])


@register("kmeans_invariants", """SELECT count(*) AS customers, CAST(4 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS not_nearest,
  CAST(0 AS BIGINT) AS off_centre, true AS cost_is_the_rows, true AS no_worse_than_one_restart FROM g""")
def q_kmeans_invariants(spark, d):
    """M2: every row is at its nearest centroid, each centroid is the mean of its rows, and
    the cost is that of the rows and at most a single restart's."""
    cols = ["recency_scaled", "frequency_scaled", "monetary_scaled"]
    scaled = cluster.scale_rfm(fx.segments(spark, d))
    centres, cost = cluster.fit_kmeans(scaled, k=4, seed=42, n_init=10)
    _, single = cluster.fit_kmeans(scaled, k=4, seed=42, n_init=1)
    assigned = cluster.assign_centroids(scaled, centres, cols)
    distances = [cluster.squared_distance(cols, c) for c in centres]
    own = F.element_at(F.array(*distances), F.col("cluster_id") + 1)
    rows = assigned.agg(F.count(F.lit(1)).alias("customers"), F.count_if(own > F.least(*distances)).alias("not_nearest"), F.sum(own).alias("_cost"))
    cents = cluster.centroid_frame(spark, centres, [f"_c_{c}" for c in cols])
    means = assigned.groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in cols]).join(cents, "cluster_id", "right")
    off = F.greatest(*[F.abs(F.coalesce(c, F.lit(9.0)) - F.col(f"_c_{c}")) for c in cols]) > 1e-3
    per = means.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(off).alias("off_centre"))
    return one_row(rows, per).select("customers", "clusters", "not_nearest", "off_centre",
                                     (F.abs(F.col("_cost") / F.lit(cost) - 1) < 1e-9).alias("cost_is_the_rows"),
                                     F.lit(cost <= single * (1 + 1e-9)).alias("no_worse_than_one_restart"))


# ------------------------------------------------------------------ dashboard (D-1 to D-8)

def _kpi_sql(src: str) -> str:
    rev = "coalesce(CAST(sum(monetary) AS DOUBLE), 0.0)"
    return f"""SELECT count(*) AS total_customers, {rev} AS total_revenue,
  coalesce({rev} / CAST(count(*) AS DOUBLE), 0.0) AS avg_customer_value,
  coalesce({pct("count(*) FILTER (WHERE segment IN ('High Value', 'Loyal'))", 'count(*)')}, 0.0) AS healthy_percentage,
  coalesce({pct("count(*) FILTER (WHERE segment = 'At Risk')", 'count(*)')}, 0.0) AS at_risk_percentage,
  count(*) FILTER (WHERE segment = 'New') AS new_customers,
  count(*) FILTER (WHERE segment = 'Low Engagement') AS low_engagement_customers,
  CASE WHEN {rev} > 0 THEN coalesce({pct("coalesce(sum(monetary) FILTER (WHERE segment = 'High Value'), 0)", rev)}, 0.0)
       ELSE 0.0 END AS high_value_revenue_percentage,
  coalesce(avg(CAST(recency AS DOUBLE)), 0.0) AS avg_recency_days,
  CAST(coalesce(max(recency), 0) AS BIGINT) AS max_recency_days FROM {src}"""


@register("kpi_summary", _kpi_sql("g"))
def q_kpi(spark, d):
    return dashboard.kpi_summary(fx.segments(spark, d))


@register("kpi_summary_documented", _kpi_sql("gf"))
def q_kpi_doc(spark, d):
    return dashboard.kpi_summary(fx.segments(spark, d, "first_match"))


CARDS_SQL = """SELECT 1 AS position, 'Total Customers' AS label, format('{:,}', total_customers) AS value FROM kpi
UNION ALL SELECT 2, 'Total Revenue', '$' || format('{:,.0f}', total_revenue) FROM kpi
UNION ALL SELECT 3, 'Avg Customer Value', '$' || format('{:,.0f}', avg_customer_value) FROM kpi
UNION ALL SELECT 4, 'Healthy %', printf('%.1f%%', healthy_percentage) FROM kpi
UNION ALL SELECT 5, 'At Risk %', printf('%.1f%%', at_risk_percentage) FROM kpi"""


@register("metric_cards", f""", kpi AS ({_kpi_sql('g')}) {CARDS_SQL}""")
def q_cards(spark, d):
    return dashboard.metric_cards(dashboard.kpi_summary(fx.segments(spark, d)))


# A frame with a date for each customer (the last purchase), filtered by segment and date: every section.
WANTED, SINCE, UNTIL = ["Loyal", "At Risk", "New", "Other"], "1998-03-01", "1998-07-28"
DATED = f"""(SELECT g.*, c.last_purchase FROM g JOIN c USING (customerid) WHERE segment IN ({', '.join(f"'{x}'" for x in WANTED)})
  AND last_purchase >= TIMESTAMP '{SINCE}' AND last_purchase <= TIMESTAMP '{UNTIL}') dated"""


def _dashboard(spark, d, section: str) -> DataFrame:
    return dashboard.dashboard(fx.dated_segments(spark, d), segments=WANTED, date_from=SINCE, date_to=UNTIL)[section]


@register("dashboard_filtered", _kpi_sql(DATED))
def q_dash_filtered(spark, d):
    return _dashboard(spark, d, "kpi")


@register("revenue_by_segment", f"""SELECT segment, CAST(sum(monetary) AS DOUBLE) AS total_revenue, count(*) AS customer_count,
  CAST(sum(monetary) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_revenue,
  {pct('sum(monetary)', 'sum(sum(monetary)) OVER ()')} AS percentage FROM g GROUP BY segment""")
def q_rev_by_seg(spark, d):
    return dashboard.revenue_by_segment(fx.segments(spark, d))


@register("segment_share", f"""SELECT segment, count(*) AS customer_count,
  {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage FROM g GROUP BY segment""")
def q_share(spark, d):
    return dashboard.segment_share(fx.segments(spark, d))


@register("scatter_points", "SELECT segment, customerid, CAST(frequency AS BIGINT) AS x, CAST(monetary AS DOUBLE) AS y FROM g")
def q_scatter(spark, d):
    return dashboard.scatter_points(fx.segments(spark, d))


@register("dashboard_status", f"""SELECT count(*) > 0 AS has_data, CASE WHEN count(*) = 0 THEN 'No data matches the specified filters.' END AS message FROM {DATED}""")
def q_dash_status(spark, d):
    return _dashboard(spark, d, "status")


@register("dashboard_cards", f""", kpi AS ({_kpi_sql(DATED)}) {CARDS_SQL}""")
def q_dash_cards(spark, d):
    return _dashboard(spark, d, "metric_cards")


@register("dashboard_revenue", f"""SELECT segment, CAST(sum(monetary) AS DOUBLE) AS total_revenue, count(*) AS customer_count,
  CAST(sum(monetary) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_revenue,
  {pct('sum(monetary)', 'sum(sum(monetary)) OVER ()')} AS percentage FROM {DATED} GROUP BY segment""")
def q_dash_revenue(spark, d):
    return _dashboard(spark, d, "revenue_by_segment")


@register("dashboard_share", f"""SELECT segment, count(*) AS customer_count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage
  FROM {DATED} GROUP BY segment""")
def q_dash_share(spark, d):
    return _dashboard(spark, d, "segment_share")


@register("dashboard_scatter", f"SELECT segment, customerid, CAST(frequency AS BIGINT) AS x, CAST(monetary AS DOUBLE) AS y FROM {DATED}")
def q_dash_scatter(spark, d):
    return _dashboard(spark, d, "scatter")


@register("dashboard_trends", f"""SELECT strftime(last_purchase, '%Y-%m') AS year_month, segment, count(*) AS customer_count,
  CAST(sum(monetary) AS DOUBLE) AS revenue FROM {DATED} GROUP BY ALL""")
def q_dash_trends(spark, d):
    return _dashboard(spark, d, "monthly_trends")


MONTHLY_SQL = """SELECT strftime(t.invoicedate, '%Y-%m') AS year_month, g.segment, count(*) AS transaction_count,
  count(DISTINCT t.customerid) AS customer_count, CAST(sum(t.total_revenue) AS DOUBLE) AS revenue
  FROM t JOIN g USING (customerid) GROUP BY 1, 2"""


def _monthly(spark, d):
    return dashboard.monthly_trends(fx.transactions(spark, d), fx.segments(spark, d))


@register("monthly_trends", MONTHLY_SQL)
def q_monthly(spark, d):
    return _monthly(spark, d)


@register("monthly_trends_filled", f""", mt AS ({MONTHLY_SQL})
SELECT m.year_month, s.segment, coalesce(mt.revenue, 0.0) AS revenue
FROM (SELECT DISTINCT year_month FROM mt) m CROSS JOIN (SELECT DISTINCT segment FROM mt) s
LEFT JOIN mt ON mt.year_month = m.year_month AND mt.segment = s.segment""")
def q_monthly_filled(spark, d):
    return dashboard.monthly_trends_filled(_monthly(spark, d))


AS_OF = "2024-12-31"


@register("monthly_trends_simulated", f""", per AS (SELECT segment, count(*) AS n, sum(monetary) AS rev FROM g GROUP BY segment),
grid AS (SELECT segment, n, rev, CAST(DATE '{AS_OF}' - CAST(i * 30 AS INTEGER) AS DATE) AS day FROM per, range(12) AS r(i))
SELECT strftime(day, '%Y-%m') AS year_month, segment,
  CAST(sum(n // 12 + CASE WHEN month(day) = {int(AS_OF[5:7])} THEN 1 ELSE 0 END) AS BIGINT) AS customer_count,
  sum(CAST(rev AS DOUBLE) / 12.0) AS revenue FROM grid GROUP BY 1, 2""")
def q_monthly_sim(spark, d):
    return dashboard.monthly_trends_simulated(fx.segments(spark, d), AS_OF)


# ------------------------------------------------------------------ insight

PER_SEG = f"""(SELECT segment, count(*) AS customer_count, CAST(sum(monetary) AS DOUBLE) AS total_revenue,
  CAST(sum(monetary) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_value,
  {pct('count(*)', 'sum(count(*)) OVER ()')} AS customer_pct,
  {pct('sum(monetary)', 'sum(sum(monetary)) OVER ()')} AS revenue_pct FROM {{src}} GROUP BY segment) p"""


@register("top_revenue_segment", f"""SELECT segment, total_revenue, revenue_pct AS percentage_of_total, customer_count
  FROM {PER_SEG.format(src='g')} ORDER BY total_revenue DESC, segment LIMIT 1""")
def q_top_rev(spark, d):
    return insight.top_revenue_segment(fx.segments(spark, d))


@register("largest_segment", f"""SELECT segment, customer_count, customer_pct AS percentage_of_total,
  avg_value AS avg_customer_value FROM {PER_SEG.format(src='g')} ORDER BY customer_count DESC, segment LIMIT 1""")
def q_largest(spark, d):
    return insight.largest_segment(fx.segments(spark, d))


AT_RISK_SQL = f"""SELECT count(*) FILTER (WHERE segment = 'At Risk') AS at_risk_count,
  CASE WHEN count(*) FILTER (WHERE segment = 'At Risk') > 0 THEN {pct("count(*) FILTER (WHERE segment = 'At Risk')", 'count(*)')} ELSE 0.0 END AS percentage_of_total,
  coalesce(CAST(sum(monetary) FILTER (WHERE segment = 'At Risk') AS DOUBLE), 0.0) AS total_at_risk_revenue,
  CASE WHEN count(*) FILTER (WHERE segment = 'At Risk') > 0
       THEN coalesce(CAST(sum(monetary) FILTER (WHERE segment = 'At Risk') AS DOUBLE), 0.0)
            / CAST(count(*) FILTER (WHERE segment = 'At Risk') AS DOUBLE) ELSE 0.0 END AS avg_customer_value,
  coalesce(CAST(sum(monetary) FILTER (WHERE segment = 'At Risk') AS DOUBLE), 0.0) * CAST(0.3 AS DOUBLE) AS recovery_potential
  FROM {{src}}"""


@register("at_risk_volume", AT_RISK_SQL.format(src="g"))
def q_at_risk(spark, d):
    return insight.at_risk_volume(fx.segments(spark, d))


@register("segment_value_analysis", """SELECT segment, CAST(sum(monetary) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_monetary,
  CAST(quantile_cont(CAST(monetary AS DOUBLE), 0.5) AS DOUBLE) AS median_monetary,
  CAST(sum(monetary) AS DOUBLE) AS total_revenue, count(*) AS customer_count FROM g GROUP BY segment""")
def q_value_analysis(spark, d):
    return insight.segment_value_analysis(fx.segments(spark, d))


def _growth_sql(src: str) -> str:
    return f"""SELECT CASE segment WHEN 'High Value' THEN 'high_value_expansion' WHEN 'Loyal' THEN 'loyal_retention'
    WHEN 'New' THEN 'new_customer_conversion' ELSE 'at_risk_recovery' END AS opportunity,
  segment, customer_count AS current_size,
  CASE segment WHEN 'High Value' THEN total_revenue * CAST(0.15 AS DOUBLE)
    WHEN 'Loyal' THEN total_revenue * CAST(0.1 AS DOUBLE)
    WHEN 'New' THEN avg_value * round_even(CAST(customer_count AS DOUBLE) * CAST(0.3 AS DOUBLE), 0)
    ELSE avg_value * CAST(customer_count AS DOUBLE) * CAST(0.3 AS DOUBLE) END AS estimated_value,
  CASE WHEN segment = 'New' THEN round_even(CAST(customer_count AS DOUBLE) * CAST(0.3 AS DOUBLE), 0) END
    AS conversion_potential,
  CASE segment WHEN 'High Value' THEN 'Expand High Value segment through targeted upselling'
    WHEN 'Loyal' THEN 'Retain Loyal segment with enhanced engagement'
    WHEN 'New' THEN 'Convert New customers to repeat buyers'
    ELSE 'Win back At Risk customers before full churn' END AS description,
  CASE segment WHEN 'High Value' THEN 'Implement premium tier loyalty program'
    WHEN 'Loyal' THEN 'Increase engagement frequency through personalized communications'
    WHEN 'New' THEN 'Deploy welcome series with exclusive first-purchase incentives'
    ELSE 'Launch "We Miss You" campaign with special comeback offers' END AS action
  FROM {PER_SEG.format(src=src)} WHERE segment IN ('High Value', 'Loyal', 'New', 'At Risk')"""


@register("growth_opportunities", _growth_sql("g"))
def q_growth(spark, d):
    return insight.growth_opportunities(fx.segments(spark, d))


@register("growth_opportunities_documented", _growth_sql("gf"))
def q_growth_doc(spark, d):
    return insight.growth_opportunities(fx.segments(spark, d, "first_match"))


@register("insight_totals", """SELECT count(*) AS total_customers, coalesce(CAST(sum(monetary) AS DOUBLE), 0.0) AS total_revenue,
  coalesce(CAST(sum(monetary) AS DOUBLE) / CAST(count(*) AS DOUBLE), 0.0) AS avg_customer_value,
  count(DISTINCT segment) AS segment_count,
  count(DISTINCT segment) FILTER (WHERE segment IN ('High Value', 'Loyal', 'New', 'At Risk')) AS opportunity_count FROM g""")
def q_insight_totals(spark, d):
    return insight.insight_totals(fx.segments(spark, d))


def _plain(x: str) -> str:
    """A number as text without scientific form, trailing zeros cut to one decimal."""
    return f"regexp_replace(CAST(CAST(round({x}, 2) AS DECIMAL(38, 2)) AS VARCHAR), '(\\.\\d)0$', '\\1')"


@register("executive_sentences", f"""SELECT
  top.segment || ' is the top revenue driver, contributing ' || {_plain('top.revenue_pct')} || '% of total revenue ('
    || top.customer_count || ' customers)' AS revenue_focus,
  big.segment || ' is the largest segment by count (' || big.customer_count || ' customers, ' || {_plain('big.customer_pct')}
    || '% of base)' AS volume_focus,
  CASE WHEN ar.at_risk_count > 0 THEN ar.at_risk_count || ' customers are At Risk (' || {_plain('ar.percentage_of_total')}
    || '% of base), representing $' || {_plain('ar.total_at_risk_revenue')} || ' in potential revenue loss' END AS risk_alert,
  CASE WHEN opp.n > 0 THEN opp.n || ' growth opportunities identified' END AS opportunity_count
FROM (SELECT * FROM {PER_SEG.format(src='g')} ORDER BY total_revenue DESC, segment LIMIT 1) top,
  (SELECT * FROM {PER_SEG.format(src='g')} ORDER BY customer_count DESC, segment LIMIT 1) big,
  ({AT_RISK_SQL.format(src='g')}) ar,
  (SELECT count(DISTINCT segment) AS n FROM g WHERE segment IN ('High Value', 'Loyal', 'New', 'At Risk')) opp""")
def q_exec_sentences(spark, d):
    return insight.executive_sentences(fx.segments(spark, d))


FILT = "(SELECT * FROM g WHERE segment IN ('Loyal', 'At Risk')) f"


@register("filtered_insights", f"""SELECT tot.*, top.*, big.*, ar.* FROM
  (SELECT count(*) AS total_customers, coalesce(CAST(sum(monetary) AS DOUBLE), 0.0) AS total_revenue FROM {FILT}) tot,
  (SELECT segment AS top_revenue_segment, total_revenue AS top_revenue FROM {PER_SEG.format(src=FILT)}
     ORDER BY total_revenue DESC, segment LIMIT 1) top,
  (SELECT segment AS largest_segment, customer_count AS largest_count FROM {PER_SEG.format(src=FILT)}
     ORDER BY customer_count DESC, segment LIMIT 1) big,
  (SELECT at_risk_count, total_at_risk_revenue, recovery_potential FROM ({AT_RISK_SQL.format(src=FILT)}) a) ar""")
def q_filtered_insights(spark, d):
    return insight.filtered_insights(fx.segments(spark, d), ["Loyal", "At Risk"])


def _insights(spark, d, section: str) -> DataFrame:
    return insight.filtered_sections(fx.dated_segments(spark, d), WANTED, SINCE, UNTIL)[section]


@register("insights_main", f"""SELECT tot.*, top.*, big.*, ar.* FROM
  (SELECT count(*) AS total_customers, coalesce(CAST(sum(monetary) AS DOUBLE), 0.0) AS total_revenue FROM {DATED}) tot,
  (SELECT segment AS top_revenue_segment, total_revenue AS top_revenue FROM {PER_SEG.format(src=DATED)}
     ORDER BY total_revenue DESC, segment LIMIT 1) top,
  (SELECT segment AS largest_segment, customer_count AS largest_count FROM {PER_SEG.format(src=DATED)}
     ORDER BY customer_count DESC, segment LIMIT 1) big,
  (SELECT at_risk_count, total_at_risk_revenue, recovery_potential FROM ({AT_RISK_SQL.format(src=DATED)}) a) ar""")
def q_insights_main(spark, d):
    return _insights(spark, d, "main")


@register("insights_distribution", f"SELECT segment, customer_count, customer_pct AS percentage FROM {PER_SEG.format(src=DATED)}")
def q_insights_distribution(spark, d):
    return _insights(spark, d, "segment_distribution")


@register("insights_values", f"""SELECT segment, CAST(sum(monetary) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_monetary,
  CAST(quantile_cont(CAST(monetary AS DOUBLE), 0.5) AS DOUBLE) AS median_monetary,
  CAST(sum(monetary) AS DOUBLE) AS total_revenue, count(*) AS customer_count FROM {DATED} GROUP BY segment""")
def q_insights_values(spark, d):
    return _insights(spark, d, "segment_value_analysis")


@register("insights_opportunities", _growth_sql(DATED))
def q_insights_opportunities(spark, d):
    return _insights(spark, d, "growth_opportunities")


# ------------------------------------------------------------------ narrative

NARR_SQL = f"""SELECT segment, count(*) AS customer_count, CAST(sum(monetary) AS DOUBLE) AS total_revenue,
  CAST(sum(monetary) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_revenue,
  {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage_of_customers,
  CASE WHEN sum(sum(monetary)) OVER () > 0 THEN {pct('sum(monetary)', 'sum(sum(monetary)) OVER ()')} ELSE 0.0 END
    AS percentage_of_revenue FROM g GROUP BY segment"""


@register("narrative_metrics", NARR_SQL)
def q_narr(spark, d):
    return narrative.narrative_metrics(fx.segments(spark, d))


# Fixed values, as the playbook states them: (segment, headline, description, action, urgency).
PLAYBOOK_VALUES = """
  ('High Value', 'Top revenue drivers — protect and grow',
   'High Value customers deliver the highest revenue and purchase most frequently. They represent the core of business profitability and must be retained at all costs.',
   'Launch a VIP loyalty programme with exclusive benefits and priority support.', 'Maintain'),
  ('Loyal', 'Consistent buyers — deepen the relationship',
   'Loyal customers return regularly and provide predictable revenue. They are strong candidates for upselling and cross-selling initiatives.',
   'Introduce tiered rewards and personalised product recommendations.', 'Grow'),
  ('New', 'Recent acquistions — convert to repeat buyers',
   'New customers have made an initial purchase but have not yet established a purchasing habit. Early engagement is critical to long-term retention.',
   'Deploy a welcome series with a second-purchase incentive within 14 days.', 'Activate'),
  ('At Risk', 'Churning customers — win back before they leave',
   'At Risk customers were once active but have gone quiet. They represent a significant revenue recovery opportunity with targeted campaigns.',
   'Launch a "We Miss You" win-back campaign with a limited-time offer.', 'Urgent'),
  ('Low Engagement', 'Dormant segment — cost-effective reactivation',
   'Low Engagement customers show minimal activity and spend. A small percentage can be reactivated with the right message at low cost.',
   'Run a low-cost A/B test to identify reactivation triggers.', 'Monitor')"""


@register("segment_playbook", f"""SELECT m.segment, customer_count, total_revenue, percentage_of_customers, percentage_of_revenue,
  coalesce(pb.headline, m.segment || ' segment') AS headline,
  format('{{:,}}', customer_count) || ' customers (' || printf('%.1f', percentage_of_customers) || '% of base), $' || format('{{:,.0f}}', total_revenue)
    || ' revenue (' || printf('%.1f', percentage_of_revenue) || '% of total). '
    || coalesce(pb.description, m.segment || ' customers require tailored engagement.') AS detail,
  coalesce(pb.action,
  'Review segment behaviour and define targeted strategy.') AS action, coalesce(pb.urgency, 'Review') AS urgency
FROM ({NARR_SQL}) m LEFT JOIN (VALUES {PLAYBOOK_VALUES}) AS pb(segment, headline, description, action, urgency) USING (segment)""")
def q_playbook(spark, d):
    return narrative.segment_playbook(narrative.narrative_metrics(fx.segments(spark, d)))


ORACLE_RISK = f"""SELECT count(*) FILTER (WHERE segment = 'At Risk') AS at_risk_count,
  coalesce(CAST(sum(monetary) FILTER (WHERE segment = 'At Risk') AS DOUBLE), 0.0) AS at_risk_revenue,
  coalesce(CAST(sum(monetary) FILTER (WHERE segment = 'At Risk') AS DOUBLE), 0.0) * CAST(0.3 AS DOUBLE) AS recovery_potential,
  CASE WHEN count(*) FILTER (WHERE segment = 'At Risk') = 0 THEN 'Low'
       WHEN {pct("count(*) FILTER (WHERE segment = 'At Risk')", 'count(*)')} > 15 THEN 'High'
       WHEN {pct("count(*) FILTER (WHERE segment = 'At Risk')", 'count(*)')} > 8 THEN 'Medium' ELSE 'Low' END AS urgency,
  CASE WHEN count(*) FILTER (WHERE segment = 'At Risk') > 0
       THEN 'Launch a "We Miss You" campaign with a 10–15% discount code, targeting customers inactive for 60+ days.'
       ELSE 'No at-risk customers detected — maintain monitoring cadence.' END AS recommended_action FROM {{src}}"""


@register("risk_summary", ORACLE_RISK.format(src="g"))
def q_risk(spark, d):
    return narrative.risk_summary(fx.segments(spark, d))


def _signals_sql(src: str) -> str:
    return f"""SELECT cfg.position, r.segment, 'Grow ' || r.segment || ' segment contribution' AS opportunity,
  CAST(r.rev AS DOUBLE) * cfg.f AS estimated_uplift, cfg.action
FROM (SELECT segment, sum(monetary) AS rev FROM {src} GROUP BY segment) r JOIN (VALUES
  (0, 'High Value', CAST(0.15 AS DOUBLE), 'Introduce premium upsell tier with exclusive access'),
  (1, 'Loyal', CAST(0.10 AS DOUBLE), 'Cross-sell adjacent product categories'),
  (2, 'New', CAST(0.30 AS DOUBLE), 'Deploy automated first-repeat-purchase email sequence'),
  (3, 'At Risk', CAST(0.30 AS DOUBLE), 'Win-back campaign with time-limited special offer')) AS cfg(position, segment, f, action)
  ON r.segment = cfg.segment"""


@register("growth_signals", _signals_sql("g"))
def q_signals(spark, d):
    return narrative.growth_signals(fx.segments(spark, d))


@register("growth_signals_documented", _signals_sql("gf"))
def q_signals_doc(spark, d):
    return narrative.growth_signals(fx.segments(spark, d, "first_match"))


def _exec_sql(src: str) -> str:
    """The executive paragraph and bullets, from the texts as they are read."""
    n = lambda c: f"format('{{:,}}', CAST({c} AS BIGINT))"
    money = lambda c: f"format('{{:,.0f}}', {c})"
    share = lambda c: f"printf('%.1f', round({c}, 1))"
    return f"""
, m AS ({NARR_SQL.replace('FROM g GROUP', f'FROM {src} GROUP')}),
tot AS (SELECT count(*) AS n, CAST(sum(monetary) AS DOUBLE) AS rev FROM {src}),
top AS (SELECT * FROM m ORDER BY total_revenue DESC, segment LIMIT 1),
big AS (SELECT * FROM m ORDER BY customer_count DESC, total_revenue DESC, segment LIMIT 1),
ex AS (SELECT concat_ws(' ',
  'Analysis of ' || {n('tot.n')} || ' customers generating $' || {money('tot.rev')}
    || ' in total revenue reveals five distinct behavioural segments with clear strategic implications.',
  'The High Value segment (' || {n('hv.customer_count')} || ' customers) is the primary revenue engine, contributing '
    || {share('hv.percentage_of_revenue')} || '% of total revenue despite representing only ' || {share('hv.percentage_of_customers')}
    || '% of the customer base — a clear sign of revenue concentration risk that warrants a dedicated retention programme.',
  'A significant at-risk cohort of ' || {n('ar.customer_count')} || ' customers ($' || {money('ar.total_revenue')}
    || ' in historical revenue) is showing signs of churn. With an estimated 30% recovery rate, a targeted win-back campaign could recover approximately $'
    || {money('ar.total_revenue * CAST(0.3 AS DOUBLE)')} || ' in revenue.',
  'The New segment (' || {n('nw.customer_count')} || ' customers) presents the strongest organic growth opportunity. Converting 30–40% to repeat buyers '
    || 'through a structured onboarding sequence could add meaningful incremental revenue over the next 90 days.',
  'Immediate priorities are: (1) protect High Value and Loyal customers through premium engagement, (2) recover At Risk customers before full churn, '
    || 'and (3) activate New customers with a targeted first-repeat-purchase incentive.') AS summary_text,
  concat_ws(chr(10), top.segment || ' segment drives ' || {share('top.percentage_of_revenue')} || '% of total revenue',
    big.segment || ' is the largest segment with ' || {n('big.customer_count')} || ' customers',
    {n('ar.customer_count')} || ' At Risk customers represent $' || {money('ar.total_revenue')} || ' in recoverable revenue',
    {n('nw.customer_count')} || ' New customers are ready for conversion campaigns',
    '5 strategic actions identified across all segments') AS bullets
FROM tot, top, big LEFT JOIN (SELECT * FROM m WHERE segment = 'High Value') hv ON true
  LEFT JOIN (SELECT * FROM m WHERE segment = 'At Risk') ar ON true LEFT JOIN (SELECT * FROM m WHERE segment = 'New') nw ON true)"""


def _lines(df: DataFrame) -> DataFrame:
    return df.withColumn("bullets", F.array_join("bullets", "\n"))


@register("executive_text", f"{_exec_sql('gf')} SELECT * FROM ex")
def q_exec_text(spark, d):
    return _lines(narrative.executive_text(narrative.narrative_metrics(fx.segments(spark, d, "first_match"))))


RISK_SQL = ORACLE_RISK.format(src="g")


@register("full_summary", f"""{_exec_sql('g')}, risk AS ({RISK_SQL}),
sums AS (SELECT count(*) AS total_customers, coalesce(CAST(sum(monetary) AS DOUBLE), 0.0) AS total_revenue FROM g),
book AS (SELECT count(*) AS segments, string_agg(segment, ', ' ORDER BY segment) AS segment_names FROM m),
grow AS (SELECT count(*) AS growth_signals, sum(estimated_uplift) AS total_uplift FROM ({_signals_sql('g')}) x)
SELECT * REPLACE (round(total_uplift, 4) AS total_uplift) FROM sums, ex, risk, book, grow""")
def q_full_summary(spark, d):
    """All five parts in one row (the per-segment parts as their names, counts and sums)."""
    parts = narrative.full_summary(fx.segments(spark, d))
    book = parts["segment_summaries"].agg(F.count(F.lit(1)).alias("segments"),
                                          F.array_join(F.array_sort(F.collect_list("segment")), ", ").alias("segment_names"))
    grow = parts["growth"].agg(F.count(F.lit(1)).alias("growth_signals"), F.round(F.sum("estimated_uplift"), 4).alias("total_uplift"))
    return one_row(parts["totals"], _lines(parts["executive"]), parts["risk"], book, grow)


# ------------------------------------------------------------------ fixture B: purchases from events (time-of-day recency)

EVENT_CTES = """WITH ev AS (SELECT CAST(event_id AS VARCHAR) AS invoiceno, 1 AS quantity, ts AS invoicedate,
    CAST(value AS DECIMAL(12,2)) AS unitprice, user_id AS customerid FROM events WHERE event_type = 'purchase'),
t AS (SELECT DISTINCT * FROM ev WHERE customerid IS NOT NULL AND unitprice > 0 AND invoicedate IS NOT NULL),
c AS (SELECT customerid, max(invoicedate) AS last_purchase, count(DISTINCT invoiceno) AS frequency,
    sum(quantity * unitprice) AS monetary FROM t GROUP BY customerid),
ref AS (SELECT max(last_purchase) + INTERVAL 1 DAY AS ref_ts FROM c),
r AS (SELECT customerid, CAST(floor(epoch(ref_ts - last_purchase) / 86400) AS BIGINT) AS recency, frequency, monetary
    FROM c, ref WHERE frequency > 0 AND monetary > 0)
"""


@register("event_rfm_base", EVENT_CTES + "SELECT customerid, recency, frequency, CAST(monetary AS DOUBLE) AS monetary FROM r",
          chain=False)
def q_event_base(spark, d):
    """RFM base of purchase events: recency counts whole elapsed days from times of day."""
    return fx.event_base(spark, d).withColumn("monetary", F.col("monetary").cast("double"))


@register("event_recency_calendar_gap", EVENT_CTES + """SELECT count(*) AS customers,
  count(*) FILTER (WHERE recency <> datediff('day', CAST(c.last_purchase AS DATE), CAST(ref_ts AS DATE))) AS floor_vs_calendar
  FROM r JOIN c USING (customerid), ref""", chain=False)
def q_event_gap(spark, d):
    """Customers whose floor-days recency differs from the calendar-day difference."""
    tx = fx.event_transactions(spark, d)
    last = rfm.customer_last_purchase(tx)
    ref = last.agg((F.max("last_purchase") + F.expr("INTERVAL 1 DAY")).alias("ref"))
    b = fx.event_base(spark, d).join(last, "customerid")
    from ledgerlens.functions.scalars import with_scalars
    b = with_scalars(b, ref)
    cal = F.datediff(F.to_date("ref"), F.to_date("last_purchase"))
    return b.agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("recency") != cal).alias("floor_vs_calendar"))


# ------------------------------------------------------------------ names and stage-result shape

REFERENCE_STYLE = ["InvoiceNo", " Stock-Code ", "Description", "Quantity", "Invoice Date", "Unit Price", "CustomerID",
                   "Country"]


@register("standardize_columns", """SELECT invoiceno, stock_code, description, quantity, invoice_date,
  CAST(unit_price AS DOUBLE) AS unit_price, customerid, country
  FROM (SELECT invoiceno, stockcode AS stock_code, description, quantity, invoicedate AS invoice_date,
               unitprice AS unit_price, customerid, country FROM raw) x""")
def q_standardize(spark, d):
    """raw columns under upload-style names, standardised back."""
    from ledgerlens.functions.names import standardize_columns
    df = standardize_columns(fx.raw(spark, d).toDF(*REFERENCE_STYLE))
    return df.withColumn("unit_price", F.col("unit_price").cast("double"))


@register("segment_result_shape", f"""SELECT segment, customer_count, revenue_percentage,
  row_number() OVER (ORDER BY total_revenue DESC, segment) AS segment_rank FROM ({segment_metrics_sql('g')}) m""")
def q_result_shape(spark, d):
    """The maps of the result record (counts, revenue shares, ranking), as sorted rows."""
    shape = segment.segment_result_shape(fx.segments(spark, d))
    ranked = shape.select("segment_counts", "revenue_contribution", F.explode("segment_ranking").alias("segment_rank", "segment"))
    return ranked.select("segment", F.col("segment_counts")[F.col("segment")].alias("customer_count"),
                         F.col("revenue_contribution")[F.col("segment")].alias("revenue_percentage"), F.col("segment_rank").cast("bigint")).orderBy("segment")


# ------------------------------------------------------------------ sinks read back

def _sink_path(spark, name: str, d: str) -> str:
    from ledgerlens.session import ensure_checkpoint_dir
    tag = d.strip("/").replace("/", "_")
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens-sinks/{spark.sparkContext.applicationId}/{tag}/{name}"


@register("write_stage", f"SELECT {SCORE_SQL} FROM s")
def q_write_stage(spark, d):
    """The score stage written as Parquet and read back."""
    from ledgerlens.sources import io
    path = _sink_path(spark, "rfm_scores", d)
    io.write_stage(_scores_out(fx.scores(spark, d), SCORE_COLS), path)
    return io.read_stage(spark, path)


@register("stage_summary", """SELECT count(*) AS total_customers, CAST(sum(monetary) AS DOUBLE) AS total_revenue,
  count(DISTINCT segment) AS unique_segments FROM g""")
def q_stage_summary(spark, d):
    """The segment-stage summary written as JSON and read back."""
    from ledgerlens.sources import io
    path = _sink_path(spark, "customer_segments_summary", d)
    io.write_summary(segment.segment_totals(fx.segments(spark, d)), path)
    back = io.read_summary(spark, path)
    return back.select("total_customers", "total_revenue", "unique_segments")


SAMPLES_SQL = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM raw "
    f"WHERE {c} IS NOT NULL ORDER BY value LIMIT 5) s{i}" for i, c in enumerate(RAW_COLS))


@register("column_samples", SAMPLES_SQL)
def q_column_samples(spark, d):
    """Up to five non-null sample values per column of the raw input."""
    return profile.sample_values(fx.raw(spark, d))


# ------------------------------------------------------------------ snapshots and short views

@register("latest_snapshot", f""", nn AS (SELECT count(*) AS n, {_nulls} FROM raw)
SELECT column_name, null_count, CAST(7 AS INTEGER) AS dataset_id, '2011-02-01T00-00-00' AS snapshot_ts FROM ({_union}) x""")
def q_latest_snapshot(spark, d):
    """Two snapshots of the missing values are written; the newer one is read back."""
    from ledgerlens.sources import io
    root = _sink_path(spark, f"snapshots-{uuid.uuid4().hex}", d)
    now = profile.missing_values(fx.raw(spark, d)).select("column_name", "null_count")
    io.write_snapshot(now.withColumn("null_count", F.col("null_count") + 1), root, 7, "2011-01-01T00-00-00")
    for _ in range(2):  # written again, it replaces itself
        io.write_snapshot(now, root, 7, "2011-02-01T00-00-00")
    io.write_snapshot(now, root, 8, "2011-03-01T00-00-00")
    return io.read_latest_snapshot(spark, root, 7, "column_name string, null_count bigint").select(
        "column_name", "null_count", "dataset_id", "snapshot_ts")


@register("recency_summary_preview", f""", rec AS (SELECT c.customerid, CAST(floor(epoch(ref_ts - last_purchase) / 86400) AS BIGINT) AS recency FROM c, ref)
SELECT (SELECT {iso("max(invoicedate) + INTERVAL 1 DAY")} FROM t) AS reference_date, count(*) AS unique_customers,
  min(recency) AS recency_min, max(recency) AS recency_max, CAST(sum(recency) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS recency_mean,
  CAST(quantile_cont(CAST(recency AS DOUBLE), 0.5) AS DOUBLE) AS recency_median FROM rec""")
def q_recency_preview_of(spark, d):
    """The stored recency summary, written as JSON and read back, as its six-field view."""
    from ledgerlens.plans import stages
    out_dir = _sink_path(spark, "recency", d)
    stages.run_recency(fx.transactions(spark, d), out_dir)
    return stages.stored_recency_preview(spark, out_dir)


# ------------------------------------------------------------------ stage summaries

@register("stage_step1_summary", f"""SELECT n AS initial_rows, n - n_d AS duplicates_removed, n_d - n_i AS missing_customers_removed,
  n_i AS final_rows, n - n_i AS rows_removed, {pct('n - n_i', 'n')} AS removed_pct
  FROM (SELECT (SELECT count(*) FROM raw) AS n, (SELECT count(*) FROM d) AS n_d, (SELECT count(*) FROM i) AS n_i) x""")
def q_stage_step1(spark, d):
    from ledgerlens.plans import stages
    upload = fx.raw(spark, d).toDF("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country")
    return stages.run_cleaning_step1(upload, _sink_path(spark, "step1", d))[1].select(
        "initial_rows", "duplicates_removed", "missing_customers_removed", "final_rows", "rows_removed", "removed_pct")


@register("stage_step2_summary", f"""SELECT count(*) AS initial_rows, count(*) FILTER (WHERE rule = 3) AS non_positive_quantity_removed,
  count(*) FILTER (WHERE rule = 4) AS non_positive_unit_price_removed, count(*) FILTER (WHERE rule = 5) AS invalid_date_removed,
  count(*) FILTER (WHERE rule = 6) AS cancelled_invoice_removed, count(ts) AS dates_parsed, count(*) - count(ts) AS parse_errors,
  {pct('count(ts)', 'count(*)')} AS parse_success_rate, count(*) FILTER (WHERE rule = 0) AS final_rows,
  {iso('min(ts) FILTER (WHERE rule = 0)')} AS min_date, {iso('max(ts) FILTER (WHERE rule = 0)')} AS max_date,
  {pct('count(*) FILTER (WHERE rule <> 0)', 'count(*)')} AS removed_pct FROM cl""")
def q_stage_step2(spark, d):
    from ledgerlens.plans import stages
    _, summary = stages.run_cleaning_step2(fx.step1(spark, d), _sink_path(spark, "step2", d), fx.FIXTURE_CUTOFF)
    return summary.select("initial_rows", "non_positive_quantity_removed", "non_positive_unit_price_removed", "invalid_date_removed",
                          "cancelled_invoice_removed", "dates_parsed", "parse_errors", "parse_success_rate", "final_rows", "min_date", "max_date",
                          "removed_pct")


# ------------------------------------------------------------------ uploads as CSV

# The fixture as people upload it: text ids, quantities and prices in several forms, dates in six.
CSV_SQL = f""", up AS (SELECT *, CAST(invoiceno[(CASE WHEN invoiceno LIKE 'C%' THEN 2 ELSE 1 END):] AS BIGINT) % 6 AS form,
    CAST(stockcode AS BIGINT) AS sk FROM d),
cu AS (SELECT invoiceno, stockcode, CASE WHEN customerid IS NULL OR customerid = '' OR lower(customerid) = 'nan' THEN NULL
      WHEN form = 0 THEN customerid ELSE 'C' || customerid END AS customerid,
    CASE WHEN sk % 5 = 0 THEN CAST(quantity AS DECIMAL(18, 6)) + CAST(0.5 AS DECIMAL(18, 6)) ELSE CAST(quantity AS DECIMAL(18, 6)) END AS quantity,
    CASE WHEN sk % 13 = 0 AND unitprice > 0 THEN CAST(0.001 AS DECIMAL(18, 6)) ELSE CAST(unitprice AS DECIMAL(18, 6)) END AS unitprice,
    try_cast(invoicedate AS TIMESTAMP) + (CASE WHEN form IN (1, 2) THEN INTERVAL 8 HOUR ELSE INTERVAL 0 HOUR END)
      + (CASE WHEN form = 1 THEN INTERVAL 123 MILLISECOND ELSE INTERVAL 0 SECOND END) AS ts FROM up),
ct AS (SELECT *, quantity * unitprice AS total_revenue FROM cu WHERE customerid IS NOT NULL AND quantity > 0 AND unitprice > 0
    AND ts IS NOT NULL AND ts <= TIMESTAMP '{fx.FIXTURE_CUTOFF}' AND invoiceno NOT LIKE 'C%')"""


def _csv_upload(spark, d) -> DataFrame:
    """The raw fixture written as CSV in mixed forms, once a session, and read with the upload reader."""
    from ledgerlens.sources import io
    raw = fx.raw(spark, d)
    form = F.regexp_replace("invoiceno", "^C", "").cast("bigint") % 6
    sk = F.col("stockcode").cast("bigint")
    day = F.col("invoicedate").try_cast("timestamp")
    written = lambda f, c=day: F.date_format(c, f)
    date = (F.when(day.isNull(), F.col("invoicedate")).when(form == 1, F.concat(written("yyyy-MM-dd"), F.lit("T08:00:00.123")))
            .when(form == 2, F.concat(written("yyyy-MM-dd"), F.lit("T10:00:00+02:00"))).when(form == 3, written("M/d/yyyy"))
            .when(form == 4, F.concat(written("M/d/yyyy"), F.lit(" 0:00"))).when(form == 5, F.concat(written("yyyy-MM-dd"), F.lit("T00:00:00Z")))
            .otherwise(F.col("invoicedate")))
    missing = F.col("customerid").isNull() | (F.col("customerid") == "") | (F.lower("customerid") == "nan")
    quantity = F.when(sk % 5 == 0, (F.col("quantity") + F.lit(0.5).cast("decimal(3,1)")).cast("string")).otherwise(F.concat(F.col("quantity").cast("string"), F.lit(".0")))
    price = F.when((sk % 13 == 0) & (F.col("unitprice") > 0), F.lit("0.001")).otherwise(F.col("unitprice").cast("string"))
    upload = raw.select(
        F.when(missing, F.col("customerid")).when(form == 0, F.concat("customerid", F.lit(".0"))).otherwise(F.concat(F.lit("C"), "customerid")).alias("CustomerID"),
        F.col("invoiceno").alias("InvoiceNo"), F.col("stockcode").alias("StockCode"), F.col("description").alias("Description"),
        quantity.alias("Quantity"), date.alias("InvoiceDate"), price.alias("UnitPrice"), F.col("country").alias("Country"))
    key = ("csv", d)
    memo = fx._memo(spark)
    if key not in memo:
        path = f"{_sink_path(spark, 'upload', d)}.csv"
        upload.write.mode("overwrite").option("header", True).csv(path)
        memo[key] = io.load_table(spark, path)
    return memo[key]


def _csv_clean(spark, d) -> DataFrame:
    from ledgerlens.operators import clean
    return clean.clean_transactions(_csv_upload(spark, d), cutoff=fx.FIXTURE_CUTOFF)


@register("csv_clean", f"""{CSV_SQL} SELECT invoiceno, stockcode, customerid, CAST(quantity AS DOUBLE) AS quantity,
  CAST(unitprice AS DOUBLE) AS unitprice, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS invoicedate, CAST(total_revenue AS DOUBLE) AS total_revenue FROM ct""")
def q_csv_clean(spark, d):
    """S1, F13, F14 on a CSV with text ids, ``6.0``, half units, tenth-of-a-cent prices and six date forms."""
    tx = _csv_clean(spark, d)
    return tx.select("invoiceno", "stockcode", "customerid", F.col("quantity").cast("double").alias("quantity"),
                     F.col("unitprice").cast("double").alias("unitprice"), F.date_format("invoicedate", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("invoicedate"),
                     F.col("total_revenue").cast("double").alias("total_revenue"))


@register("csv_rfm_base", f"""{CSV_SQL}, cc AS (SELECT customerid, max(ts) AS last_purchase, count(DISTINCT invoiceno) AS frequency,
    round_even(sum(total_revenue), 2) AS monetary FROM ct GROUP BY customerid),
cr AS (SELECT max(last_purchase) + INTERVAL 1 DAY AS ref_ts FROM cc)
SELECT customerid, CAST(floor(epoch(ref_ts - last_purchase) / 86400) AS BIGINT) AS recency, frequency, CAST(monetary AS DOUBLE) AS monetary
FROM cc, cr WHERE frequency > 0 AND monetary > 0""")
def q_csv_base(spark, d):
    """The RFM base of that upload: every text id keeps its customer."""
    return rfm.rfm_base(_csv_clean(spark, d)).withColumn("monetary", F.col("monetary").cast("double"))


REJECT_SQL = """, up AS (SELECT *, CAST(stockcode AS BIGINT) AS sk FROM raw),
marked AS (SELECT CASE WHEN sk % 31 = 0 THEN 1 END AS q, CASE WHEN sk % 43 = 0 THEN 1 END AS p, CASE WHEN try_cast(invoicedate AS TIMESTAMP) IS NULL THEN 1 END AS d FROM up)
SELECT 'kept' AS reason, count(*) AS records FROM marked WHERE q IS NULL AND p IS NULL AND d IS NULL
UNION ALL SELECT 'rejected', count(*) FROM marked WHERE q = 1 OR p = 1 OR d = 1
UNION ALL SELECT 'quantity_not_a_number', count(q) FROM marked UNION ALL SELECT 'unitprice_not_a_number', count(p) FROM marked
UNION ALL SELECT 'invoicedate_not_a_date', count(d) FROM marked"""


@register("csv_rejects", REJECT_SQL)
def q_csv_rejects(spark, d):
    """An upload with bad quantities, prices and dates: records kept, set aside, and set aside by reason."""
    from ledgerlens.sources import io
    raw, sk = fx.raw(spark, d), F.col("stockcode").cast("bigint")
    upload = raw.withColumns({"quantity": F.when(sk % 31 == 0, F.lit("six")).otherwise(F.col("quantity").cast("string")),
                              "unitprice": F.when(sk % 43 == 0, F.lit("1,5 each")).otherwise(F.col("unitprice").cast("string"))})
    path = f"{_sink_path(spark, 'rejects', d)}.csv"
    upload.write.mode("overwrite").option("header", True).csv(path)
    kept, rejects = io.read_csv_with_rejects(spark, path)
    quarantine = _sink_path(spark, "quarantine", d)
    counts = io.quarantine(rejects, quarantine)
    rows = [df.agg(F.lit(name).alias("reason"), F.count(F.lit(1)).alias("records")) for name, df in (("kept", kept), ("rejected", io.read_stage(spark, quarantine)))]
    return counts.unionByName(rows[0]).unionByName(rows[1])

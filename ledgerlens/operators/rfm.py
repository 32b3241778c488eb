"""Recency, frequency and monetary features.

The RFM base is one ``groupBy(customerid)`` over the cleaned transactions
(max date, distinct invoices, revenue sum); the reference's three
per-metric frames joined on customer id give the same rows, so the join
form is kept only as ``rfm_base_joined``. Scalars such as the reference
date are attached as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.exprs import as_timestamp, floor_days, iso_string
from ledgerlens.operators.rank import column_quantiles, exact_quantiles
from ledgerlens.functions.scalars import one_row, with_scalars


def _ref_literal(reference) -> Column:
    return F.to_timestamp(F.lit(str(reference)))


def _with_customer(tx: DataFrame) -> DataFrame:
    """The lines that count: those with a customer id (every line, after cleaning)."""
    return tx.where(F.col("customerid").isNotNull()) if "customerid" in tx.columns else tx


def reference_date(tx: DataFrame, reference=None, date_col: str = "invoicedate") -> DataFrame:
    """One row with the reference date (given, or max date + 1 day),
    max/min dates and the whole-day span between them."""
    ts = as_timestamp(date_col)
    agg = _with_customer(tx).agg(F.max(ts).alias("max_ts"), F.min(ts).alias("min_ts"))
    ref = (agg["max_ts"] + F.expr("INTERVAL 1 DAY")) if reference is None else _ref_literal(reference)
    return agg.select(
        iso_string(ref).alias("reference_date"),
        iso_string("max_ts").alias("max_date_in_data"),
        iso_string("min_ts").alias("min_date_in_data"),
        floor_days("max_ts", "min_ts").alias("date_range_days"),
    )


def _with_reference(cust: DataFrame, reference, tx: DataFrame | None = None, date_col: str = "invoicedate",
                    last_col: str = "last_purchase") -> DataFrame:
    """Attach ``_ref_ts`` (given date, or latest purchase + 1 day) as a scalar subquery.

    The latest purchase is read from the transactions (``tx``) with a global
    ``max``: a one-column scan with map-side partial aggregation, instead of
    a second run of the customer aggregation.
    """
    if reference is not None:
        return cust.withColumn("_ref_ts", _ref_literal(reference))
    if tx is not None:
        src = _with_customer(tx).select(as_timestamp(date_col).alias(last_col))
    else:
        src = cust
    ref = src.agg((F.max(last_col) + F.expr("INTERVAL 1 DAY")).alias("_ref_ts"))
    return with_scalars(cust, ref)


def customer_last_purchase(tx: DataFrame, date_col: str = "invoicedate") -> DataFrame:
    return tx.where(F.col("customerid").isNotNull()) \
             .groupBy("customerid").agg(F.max(as_timestamp(date_col)).alias("last_purchase"))


def customer_recency(tx: DataFrame, reference=None, date_col: str = "invoicedate") -> DataFrame:
    """(customerid, recency) with recency = floor days since last purchase."""
    cust = _with_reference(customer_last_purchase(tx, date_col), reference, tx, date_col)
    return cust.select("customerid", floor_days("_ref_ts", "last_purchase").alias("recency"))


def transactions_with_recency(tx: DataFrame, recency: DataFrame) -> DataFrame:
    """Customer recency joined back to every transaction (left join).

    Whether the customer side is broadcast is left to the optimiser's sizes;
    where it is not, AQE splits a skewed customer.
    """
    return tx.join(recency, "customerid", "left")


def _figures(df: DataFrame, c: str, p: str) -> list[Column]:
    """Aggregates min, max, mean and std of one column."""
    exact = isinstance(df.schema[c].dataType, (T.IntegerType, T.LongType, T.DecimalType, T.ShortType))
    # Exact sums for integers and decimals, so the mean does not depend on summation order.
    mean = F.sum(c).cast("double") / F.count(c).cast("double") if exact else F.avg(F.col(c).cast("double"))
    return [F.min(c).alias(f"{p}min"), F.max(c).alias(f"{p}max"), mean.alias(f"{p}mean"),
            F.round(F.stddev_samp(F.col(c).cast("double")), 6).alias(f"{p}std")]


def describe(df: DataFrame, c: str, with_median: bool = True, prefix: str | None = None) -> DataFrame:
    """min, max, mean, median, sample std of one column as one row.

    ``std`` is rounded to 6 digits: its last bits depend on the summation
    algorithm of the engine.
    """
    p = f"{prefix}_" if prefix else ""
    base = df.agg(F.count(c).alias(f"{p}count"), *_figures(df, c, p))
    if not with_median:
        return base
    med = exact_quantiles(df, c, [0.5], names=[f"{p}median"])
    return one_row(base, med)


def recency_stats(recency: DataFrame) -> DataFrame:
    """A8 statistics: customers, min, max, mean, median, std of recency."""
    d = describe(recency, "recency")
    return d.select(F.col("count").alias("unique_customers"),
                    F.col("min").cast("bigint").alias("recency_min"),
                    F.col("max").cast("bigint").alias("recency_max"),
                    F.col("mean").alias("recency_mean"), F.col("median").alias("recency_median"),
                    F.col("std").alias("recency_std"))


def recency_quartiles(recency: DataFrame) -> DataFrame:
    """A10: 25th/50th/75th/100th percentiles, linear interpolation.

    Named by the percentile they hold (the reference's names are swapped).
    """
    return exact_quantiles(recency, "recency", [0.25, 0.5, 0.75, 1.0], names=["p25", "p50", "p75", "p100"])


def recency_buckets(recency: DataFrame) -> DataFrame:
    """Customers by days since last purchase (<=30, 31-60, 61-90, >90)."""
    r = F.col("recency")
    return recency.agg(
        F.count(F.lit(1)).alias("unique_customers"),
        F.count_if(r <= 30).alias("recent_0_30_days"),
        F.count_if((r > 30) & (r <= 60)).alias("recent_31_60_days"),
        F.count_if((r > 60) & (r <= 90)).alias("recent_61_90_days"),
        F.count_if(r > 90).alias("recent_90_plus_days"),
    )


def recency_summary(tx: DataFrame, recency: DataFrame) -> DataFrame:
    """A11 summary row: transactions, customers, stats, quartiles, buckets,
    and the median truncated to whole days.

    One exact quantile pass serves both the quartiles and the median (p50).
    A left join of recency onto the transactions keeps their row count, so
    the transactions are counted directly.
    """
    d = describe(recency, "recency", with_median=False)
    st = d.select(F.col("count").alias("unique_customers"),
                  F.col("min").cast("bigint").alias("recency_min"),
                  F.col("max").cast("bigint").alias("recency_max"),
                  F.col("mean").alias("recency_mean"), F.col("std").alias("recency_std"))
    q = recency_quartiles(recency)
    b = recency_buckets(recency).drop("unique_customers")
    n_tx = tx.agg(F.count(F.lit(1)).alias("total_transactions"))
    return one_row(n_tx, st, q, b) \
        .withColumn("recency_median", F.col("p50")) \
        .withColumn("median_days", F.col("p50").cast("bigint"))


def finalize_recency(recency: DataFrame) -> DataFrame:
    """recency coerced to a number (bad text to null), null rows dropped."""
    return recency.withColumn("recency", F.col("recency").cast("string").try_cast("double")) \
                  .where(F.col("recency").isNotNull())


def customer_frequency(tx: DataFrame) -> DataFrame:
    """Distinct invoices per customer, kept when > 0."""
    return tx.where(F.col("customerid").isNotNull()).groupBy("customerid") \
             .agg(F.count_distinct("invoiceno").alias("frequency")).where(F.col("frequency") > 0)


def _revenue(tx: DataFrame) -> Column:
    if "total_revenue" in tx.columns:
        return F.col("total_revenue")
    return F.col("quantity") * F.col("unitprice")


def cents(c: Column) -> Column:
    return F.bround(c, 2)


def customer_monetary(tx: DataFrame) -> DataFrame:
    """Revenue per customer (exact decimal sum, rounded half-even to cents), kept when > 0."""
    return _with_customer(tx).groupBy("customerid") \
             .agg(cents(F.sum(_revenue(tx))).alias("monetary")).where(F.col("monetary") > 0)


def rfm_base_joined(recency: DataFrame, frequency: DataFrame, monetary: DataFrame) -> DataFrame:
    """J2 as written by the reference: recency ⋈ frequency ⋈ monetary (inner)."""
    return recency.join(frequency, "customerid").join(monetary, "customerid") \
                  .select("customerid", "recency", "frequency", "monetary")


def rfm_base(tx: DataFrame, reference=None, date_col: str = "invoicedate") -> DataFrame:
    """RFM base in one aggregation: (customerid, recency, frequency, monetary).

    Equal to :func:`rfm_base_joined` on the same input. Recency is counted
    from the reference date, which by default is the latest purchase of any
    customer plus one day (a one-column maximum over the same lines).
    """
    cust = tx.where(F.col("customerid").isNotNull()).groupBy("customerid").agg(
        F.max(as_timestamp(date_col)).alias("last_purchase"),
        F.count_distinct("invoiceno").alias("frequency"),
        cents(F.sum(_revenue(tx))).alias("monetary"))
    cust = _with_reference(cust, reference, tx, date_col)
    return cust.where((F.col("frequency") > 0) & (F.col("monetary") > 0)).select(
        "customerid", floor_days("_ref_ts", "last_purchase").alias("recency"),
        "frequency", "monetary")


def validate_rfm_base(rfm: DataFrame) -> DataFrame:
    """F16: one row: required columns present, null count per column, ``is_valid``."""
    required = ["customerid", "recency", "frequency", "monetary"]
    missing = [c for c in required if c not in rfm.columns]
    if missing:
        return rfm.sparkSession.createDataFrame(
            [(False, f"Missing columns: {', '.join(missing)}", 0)], "is_valid boolean, message string, null_values bigint")
    nulls = sum((F.sum(F.col(c).isNull().cast("bigint")) for c in required[1:]),
                F.sum(F.col(required[0]).isNull().cast("bigint")))
    return rfm.agg(F.coalesce(nulls, F.lit(0)).cast("bigint").alias("null_values")).select(
        (F.col("null_values") == 0).alias("is_valid"),
        F.when(F.col("null_values") > 0, F.lit("Found null values in required columns")).alias("message"),
        "null_values")


def rfm_statistics(rfm: DataFrame) -> DataFrame:
    """min/max/mean/median/std of recency, frequency and monetary, one row."""
    cols = ("recency", "frequency", "monetary")
    stats = rfm.agg(F.count(F.lit(1)).alias("total_customers"), *[a for c in cols for a in _figures(rfm, c, f"{c}_")])
    medians = column_quantiles(rfm, cols, [0.5]).agg(
        *[F.max(F.when(F.col("column_name") == c, F.col("quantiles")[0])).alias(f"{c}_median") for c in cols])
    out = with_scalars(stats, medians)
    return out.select("total_customers", *[
        (F.col(f"{c}_{k}").cast("double") if c == "monetary" else F.col(f"{c}_{k}")).alias(f"{c}_{k}")
        for c in cols for k in ("min", "max", "mean", "std", "median")])


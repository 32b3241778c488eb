"""Cleaning rules (F4-F12), the two stage pipelines (F13, F14) and the
one-pass waterfall report (A1).

Rules are row predicates over the grouping columns of the dedupe, so
Catalyst pushes them below the de-duplication aggregate: only surviving
rows are shuffled. The dedupe itself is a hash aggregate with a map-side
partial step, so a very large group of identical copies collapses before
the shuffle instead of landing in one task.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import parse_timestamp, pct

# Default cut-off for invoice dates (inclusive upper bound).
DEFAULT_DATE_CUTOFF = "2011-12-31 00:00:00"

# Step names of the waterfall, in the order the reference applies them.
STEPS = [
    (1, "duplicates"),
    (2, "missing_customer_id"),
    (3, "non_positive_quantity"),
    (4, "non_positive_unit_price"),
    (5, "invalid_date"),
    (6, "cancelled_invoice"),
]


def _cutoff(cutoff) -> Column | None:
    if cutoff is None:
        return None
    if isinstance(cutoff, Column):
        return cutoff
    if isinstance(cutoff, _dt.datetime):
        cutoff = cutoff.strftime("%Y-%m-%d %H:%M:%S")
    return F.to_timestamp(F.lit(str(cutoff)))


# ---------------------------------------------------------------- predicates

def missing_customer(c: str = "customerid") -> Column:
    """Null, empty, or the text 'nan' in any case."""
    col = F.col(c)
    return col.isNull() | (col.cast("string") == "") | (F.lower(col.cast("string")) == "nan")


def bad_quantity(c: str = "quantity") -> Column:
    return F.coalesce(F.col(c) <= 0, F.lit(True))


def bad_price(c: str = "unitprice") -> Column:
    return F.coalesce(F.col(c) <= 0, F.lit(True))


def bad_date(ts: Column, cutoff=DEFAULT_DATE_CUTOFF) -> Column:
    """Null, or after ``cutoff`` (``cutoff=None``: no upper bound)."""
    bound = _cutoff(cutoff)
    return ts.isNull() if bound is None else F.coalesce(ts > bound, F.lit(True))


def cancelled(c: str = "invoiceno") -> Column:
    """Invoice text starts with 'C' (case-sensitive); a null invoice is kept."""
    return F.coalesce(F.col(c).cast("string").startswith("C"), F.lit(False))


# ---------------------------------------------------------------- row operators

def dedupe(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed (F4); nulls compare equal."""
    return df.dropDuplicates()


def drop_missing_customers(df: DataFrame, c: str = "customerid") -> DataFrame:
    return df.where(~missing_customer(c))


def positive_quantity(df: DataFrame, c: str = "quantity") -> DataFrame:
    return df.where(F.col(c) > 0)


def positive_price(df: DataFrame, c: str = "unitprice") -> DataFrame:
    return df.where(F.col(c) > 0)


def parse_dates(df: DataFrame, c: str = "invoicedate", formats: list[str] | None = None,
                out: str | None = None) -> DataFrame:
    """Text dates to timestamps; bad text to null (F9). Timestamp input is kept."""
    dtype = dict(df.dtypes)[c]
    parsed = F.col(c).cast("timestamp") if dtype.startswith("timestamp") else parse_timestamp(F.col(c), formats)
    return df.withColumn(out or c, parsed)


def drop_invalid_dates(df: DataFrame, c: str = "invoicedate", cutoff=DEFAULT_DATE_CUTOFF) -> DataFrame:
    """Keep non-null timestamps not after ``cutoff`` (F10; ``None``: no upper bound)."""
    bound = _cutoff(cutoff)
    keep = F.col(c).isNotNull() if bound is None else F.col(c).isNotNull() & (F.col(c) <= bound)
    return df.where(keep)


def drop_cancelled(df: DataFrame, c: str = "invoiceno") -> DataFrame:
    return df.where(~cancelled(c))


def line_revenue(df: DataFrame, qty: str = "quantity", price: str = "unitprice",
                 out: str = "total_revenue") -> DataFrame:
    """``quantity * unitprice`` (F12): exact decimal product."""
    return df.withColumn(out, F.col(qty) * F.col(price))


def customer_id_key(c: str = "customerid") -> Column:
    """Customer id as text: every present id is kept as given, without spaces
    around it. Whole numbers written with a fraction (``17850.0``, as numeric
    ids with gaps are often written out) lose it, so both forms are one customer.
    """
    return F.regexp_replace(F.trim(F.col(c).cast("string")), r"^(-?\d+)\.0+$", "$1")


# ---------------------------------------------------------------- pipelines

def clean_step1(raw: DataFrame) -> DataFrame:
    """dedupe, then drop rows without a customer id."""
    return drop_missing_customers(dedupe(raw))


def clean_step2(step1: DataFrame, cutoff=DEFAULT_DATE_CUTOFF, formats: list[str] | None = None) -> DataFrame:
    """quantity > 0, price > 0, parse and bound dates, drop cancelled,
    add ``total_revenue``. ``invoicedate`` becomes a timestamp, ``customerid`` text."""
    df = positive_price(positive_quantity(step1))
    df = drop_invalid_dates(parse_dates(df, formats=formats), cutoff=cutoff)
    return line_revenue(drop_cancelled(df)).withColumn("customerid", customer_id_key())


def clean_transactions(raw: DataFrame, cutoff=DEFAULT_DATE_CUTOFF, formats: list[str] | None = None) -> DataFrame:
    """Both cleaning stages: raw lines to cleaned transactions."""
    return clean_step2(clean_step1(raw), cutoff=cutoff, formats=formats)


def rule_code(ts: Column, cutoff=DEFAULT_DATE_CUTOFF) -> Column:
    """First failing step-2 rule: 3 quantity, 4 price, 5 date, 6 cancelled, 0 kept."""
    return (F.when(bad_quantity(), 3).when(bad_price(), 4)
             .when(bad_date(ts, cutoff), 5).when(cancelled(), 6).otherwise(0))


def cleaning_waterfall(raw: DataFrame, cutoff=DEFAULT_DATE_CUTOFF, formats: list[str] | None = None) -> DataFrame:
    """A1: rows removed by each cleaning step, in one pass over the input.

    One aggregate over all columns yields the number of copies of each
    distinct row (map-side combined); each distinct row is then tagged with
    the first step that removes it and the tags are counted. Output has one
    row per step: step, rule, rows_before, removed, rows_after, removed_pct.
    """
    cols = raw.columns
    copies = raw.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    is_ts = dict(raw.dtypes)["invoicedate"].startswith("timestamp")
    ts = F.col("invoicedate").cast("timestamp") if is_ts else parse_timestamp(F.col("invoicedate"), formats)
    tagged = copies.select(
        F.col("_copies"),
        F.when(missing_customer(), 2).otherwise(rule_code(ts, cutoff)).alias("_step"))
    per_step = tagged.groupBy("_step").agg(F.count(F.lit(1)).alias("distinct_rows"),
                                           F.sum("_copies").alias("raw_rows"))
    # per_step has at most 6 rows: pivot them into one row, then unpivot the steps.
    one = per_step.agg(
        F.sum("raw_rows").alias("n_raw"),
        F.sum("distinct_rows").alias("n_distinct"),
        *[F.coalesce(F.sum(F.when(F.col("_step") == s, F.col("distinct_rows"))), F.lit(0)).alias(f"r{s}")
          for s in range(2, 7)])
    removed = [F.col("n_raw") - F.col("n_distinct")] + [F.col(f"r{s}") for s in range(2, 7)]
    rows = []
    before = F.col("n_raw")
    for (step, name), rem in zip(STEPS, removed):
        after = before - rem
        rows.append(F.struct(F.lit(step).alias("step"), F.lit(name).alias("rule"),
                             before.cast("bigint").alias("rows_before"), rem.cast("bigint").alias("removed"),
                             after.cast("bigint").alias("rows_after"), pct(rem, before).alias("removed_pct")))
        before = after
    return one.select(F.explode(F.array(*rows)).alias("w")).select("w.*")


def parse_date_stats(df: DataFrame, c: str = "invoicedate", formats: list[str] | None = None) -> DataFrame:
    """F9 statistics: rows, parsed, failed and success rate (one pass)."""
    parsed = parse_dates(df, c, formats, out="_ts")
    return parsed.agg(F.count(F.lit(1)).alias("total_rows"), F.count("_ts").alias("parsed_count")) \
                 .select("total_rows", "parsed_count",
                         (F.col("total_rows") - F.col("parsed_count")).alias("parse_errors"),
                         pct("parsed_count", "total_rows").alias("success_rate"))

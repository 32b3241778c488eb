"""Exploration profile of a raw table.

Counts that the reference computes per column in separate passes are
folded into single aggregates here; results come back in long form (one
row per column) via ``stack``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.exprs import parse_timestamp, pct
from ledgerlens.operators.rank import column_quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
EXACT_SUM = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


def _lit_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def data_types(df: DataFrame) -> DataFrame:
    """A2: column name and Spark type, one row per column (schema only)."""
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, dtype string")


def missing_values(df: DataFrame) -> DataFrame:
    """A3: null count, null % and non-null count per column (one pass)."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"{_lit_str(c)}, _m{i}" for i, c in enumerate(cols))
    long = agg.selectExpr("_n", f"stack({len(cols)}, {pairs}) AS (column_name, null_count)")
    return long.select("column_name", "null_count", pct("null_count", "_n").alias("null_percentage"),
                       (F.col("_n") - F.col("null_count")).alias("non_null_count"))


def duplicate_counts(df: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """A4: total rows, exact duplicate rows and duplicates on the key columns.

    One scan: copies per distinct row (map-side combined), then distinct
    rows per key over that smaller result; nulls compare equal as in pandas.
    """
    key_cols = [c for c in (key_cols or ["invoiceno", "customerid"]) if c in df.columns]
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    if key_cols:
        per_key = copies.groupBy(*key_cols).agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_d"))
        tot = per_key.agg(F.sum("_c").alias("total_rows"), F.sum("_d").alias("_distinct"),
                          F.count(F.lit(1)).alias("_keys"))
    else:
        tot = copies.agg(F.sum("_c").alias("total_rows"), F.count(F.lit(1)).alias("_distinct"),
                         F.lit(None).cast("bigint").alias("_keys"))
    tot = tot.select(F.coalesce("total_rows", F.lit(0)).cast("bigint").alias("total_rows"),
                     F.coalesce("_distinct", F.lit(0)).cast("bigint").alias("_distinct"),
                     F.coalesce("_keys", F.lit(0)).cast("bigint").alias("_keys"))
    return tot.select("total_rows", (F.col("total_rows") - F.col("_distinct")).alias("duplicate_rows"),
                      pct(F.col("total_rows") - F.col("_distinct"), "total_rows").alias("duplicate_percentage"),
                      (F.col("total_rows") - F.col("_keys")).alias("key_column_duplicates"),
                      F.lit(",".join(key_cols)).alias("key_columns_used"))


def invalid_values(df: DataFrame, quantity: str = "quantity", price: str = "unitprice",
                   customer: str = "customerid", date: str = "invoicedate",
                   formats: list[str] | None = None) -> DataFrame:
    """A5: quantity <= 0 and < 0, price < 0 and = 0, null customer ids and
    unparseable dates, with percentages, in one aggregate."""
    q, p = F.col(quantity), F.col(price)
    dtype = dict(df.dtypes)[date]
    ts = F.col(date).cast("timestamp") if dtype.startswith("timestamp") else parse_timestamp(F.col(date), formats)
    agg = df.agg(F.count(F.lit(1)).alias("total_rows"),
                 F.count_if(q <= 0).alias("quantity_negative_or_zero"),
                 F.count_if(q < 0).alias("quantity_negative"),
                 F.count_if(p < 0).alias("unitprice_negative"),
                 F.count_if(p == 0).alias("unitprice_zero"),
                 F.count_if(F.col(customer).isNull()).alias("customerid_null"),
                 F.count_if(ts.isNull()).alias("invoicedate_invalid"))
    return agg.withColumns({
        "customerid_null_percentage": pct("customerid_null", "total_rows"),
        "invoicedate_invalid_percentage": pct("invoicedate_invalid", "total_rows"),
    })


def _as_text(field: T.StructField) -> Column:
    """A value as text, equal values alike."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(c)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(c)))
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0)  # one zero
    return c.cast("string")


def value_counts(df: DataFrame) -> DataFrame:
    """(position, value, n): every column's distinct values as text and how often each occurs, in one scan.

    The values of a row are grouped column by column with a map-side step, so what is shuffled is
    each task's distinct values, and a value of a third of all rows is one row a task."""
    each = F.array(*[F.struct(F.lit(i).alias("position"), _as_text(f).alias("value")) for i, f in enumerate(df.schema.fields)])
    return df.select(F.explode(each).alias("e")).groupBy(F.col("e.position").alias("position"), F.col("e.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: type, distinct count (nulls skipped), null count; for
    numeric columns mean, median, min, max and sample std (6 digits).

    One scan of all columns gives distinct and null counts (:func:`value_counts`), one plain
    aggregate the figures of the numeric columns, and their medians come from
    :func:`ledgerlens.operators.rank.column_quantiles`. ``approx=True`` counts distinct values by
    HyperLogLog sketches in the plain aggregate instead. Sample values (the reference's ``head(5)``)
    are in :func:`sample_values`.
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        if approx:
            aggs += [F.count_if(c.isNull()).alias(f"_z{i}"), F.approx_count_distinct(c).alias(f"_u{i}")]
        if isinstance(f.dataType, NUMERIC):
            mean = (F.sum(c).cast("double") / F.count(c).cast("double")) if isinstance(f.dataType, EXACT_SUM) \
                else F.avg(c.cast("double"))
            aggs += [mean.alias(f"_a{i}"), F.min(c).cast("double").alias(f"_lo{i}"),
                     F.max(c).cast("double").alias(f"_hi{i}"),
                     F.round(F.stddev_samp(c.cast("double")), 6).alias(f"_s{i}")]
    rows = []
    for i, f in enumerate(fields):
        numeric = isinstance(f.dataType, NUMERIC)
        nul = F.lit(None).cast("double")
        counts = [F.col(f"_u{i}").cast("bigint").alias("unique_count"), F.col(f"_z{i}").cast("bigint").alias("null_count")] if approx else []
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("dtype"), *counts,
            (F.col(f"_a{i}") if numeric else nul).alias("mean"),
            (F.col(f"_lo{i}") if numeric else nul).alias("min"),
            (F.col(f"_hi{i}") if numeric else nul).alias("max"),
            (F.col(f"_s{i}") if numeric else nul).alias("std")))
    prof = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("p")).select("p.*")
    if not approx:
        # a row a column on both sides
        counts = value_counts(df).groupBy("position").agg(F.count("value").alias("unique_count"),
                                                          F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"))
        prof = prof.join(F.broadcast(counts), "position", "left").select(
            "position", "column_name", "dtype", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("unique_count", "null_count")],
            "mean", "min", "max", "std")
    numeric = [f.name for f in fields if isinstance(f.dataType, NUMERIC)]
    if not numeric:
        return prof.withColumn("median", F.lit(None).cast("double"))
    medians = column_quantiles(df, numeric, [0.5]).select("column_name", F.col("quantiles")[0].alias("median"))
    # medians has one row per numeric column.
    return prof.join(F.broadcast(medians), "column_name", "left")


def sample_values(df: DataFrame, n: int = 5) -> DataFrame:
    """Up to ``n`` non-null sample values per column (as text), long form.

    A preview: the limit is the feature. Spark has no file row order, so the
    samples are each column's ``n`` smallest values (deterministic, repeats
    included). One scan: equal values are counted first, and each task keeps ``n`` of a column.
    """
    counted = value_counts(df).where(F.col("value").isNotNull())
    first = counted.withColumn("r", F.row_number().over(Window.partitionBy("position").orderBy("value"))).where(F.col("r") <= n)
    # of the smallest distinct values, as many copies as there are, up to n in all
    before = F.coalesce(F.sum("n").over(Window.partitionBy("position").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    copies = F.least(F.col("n"), F.greatest(F.lit(n) - before, F.lit(0))).cast("int")
    names = F.array(*[F.lit(c) for c in df.columns])
    return first.withColumn("copies", copies).where(F.col("copies") > 0).select(
        names[F.col("position")].alias("column_name"), F.explode(F.array_repeat("value", F.col("copies"))).alias("value"))


def exploration(df: DataFrame) -> dict[str, DataFrame]:
    """Every exploration output over one input."""
    return {"data_types": data_types(df), "missing_values": missing_values(df),
            "duplicates": duplicate_counts(df), "invalid_values": invalid_values(df),
            "column_profile": column_profile(df), "sample_values": sample_values(df)}

"""Stage readers and writers.

Stage tables are Parquet by default (typed, splittable, with pushdown);
CSV with a header is an option for interchange. Stage summaries are
one-row DataFrames written as JSON. Exploration snapshots are written
partitioned by dataset and snapshot time, and the latest one is chosen
with an aggregate, not by listing files on the driver.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.exprs import normalise_missing, parse_timestamp
from ledgerlens.sources.adapters import RAW_SCHEMA

# An uploaded file's quantities and prices keep six decimals, and 12 digits before them.
UPLOAD_TYPES = {f.name: T.DecimalType(18, 6) if f.name in ("quantity", "unitprice") else f.dataType for f in RAW_SCHEMA.fields}


def read_raw_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Raw transaction CSV with a header, every column read as text, then
    typed with ``try_cast`` (bad numbers become null, as in the reference).

    ``multiline`` is off by default: quoted newlines make a file unsplittable.
    Any of the usual missing-value tokens becomes null.
    """
    raw = (spark.read.option("header", True).option("multiLine", multiline)
           .option("mode", "PERMISSIVE").csv(path))
    return typed_transactions(raw)


#: Reasons for which a CSV record is set aside.
REJECT_REASONS = ("malformed_line", "quantity_not_a_number", "unitprice_not_a_number", "invoicedate_not_a_date")
CORRUPT = "_corrupt_record"


def read_csv_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S1 with reject records: (kept, rejects) of a raw transaction CSV; each record is in one of them.

    A record is rejected if its line does not have the header's fields, or a quantity, price or
    date that is there cannot be read (missing-value tokens are missing, not bad). rejects: file, reasons
    (array), record (the line if it is malformed, else its fields as JSON). One scan serves both when they are
    read from the stored table of :func:`quarantine`.
    """
    header = spark.read.option("header", True).csv(path).schema
    schema = T.StructType([*header.fields, T.StructField(CORRUPT, T.StringType())])
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
           .option("enforceSchema", True).schema(schema).csv(path))
    marked = raw.select(F.struct(*[F.col(f"`{f.name}`") for f in header]).alias("_raw"), F.col(CORRUPT), F.col("_metadata.file_path").alias("_file"), *[F.col(f"`{f.name}`") for f in header])
    typed = typed_transactions(marked)
    names = dict(zip(map(_standard, header.names), header.names))

    def given(name: str):
        return normalise_missing(F.col("_raw")[names[name]]) if name in names else F.lit(None).cast("string")

    bad_date = given("invoicedate").isNotNull() & parse_timestamp(given("invoicedate")).isNull()
    tests = (F.col(CORRUPT).isNotNull(), given("quantity").isNotNull() & F.col("quantity").isNull(),
             given("unitprice").isNotNull() & F.col("unitprice").isNull(), bad_date)
    reasons = F.filter(F.array(*[F.when(t, F.lit(r)) for t, r in zip(tests, REJECT_REASONS)]), lambda r: r.isNotNull())
    judged = typed.withColumn("_reasons", reasons)
    kept = judged.where(F.size("_reasons") == 0).drop("_raw", CORRUPT, "_file", "_reasons")
    rejects = judged.where(F.size("_reasons") > 0).select(
        F.col("_file").alias("file"), F.col("_reasons").alias("reasons"), F.coalesce(F.col(CORRUPT), F.to_json("_raw")).alias("record"))
    return kept, rejects


def _standard(name: str) -> str:
    from ledgerlens.functions.names import standardize_name
    return standardize_name(name)


def quarantine(rejects: DataFrame, path: str) -> DataFrame:
    """Write the rejects and return their counts by reason (a record with two reasons counts in both)."""
    write_stage(rejects, path)
    stored = read_stage(rejects.sparkSession, path)
    return stored.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


def typed_transactions(raw: DataFrame) -> DataFrame:
    """Canonical names and types for a text-typed transaction frame.

    Columns are matched by standardised name; optional columns pass through.
    """
    from ledgerlens.functions.names import standardize_columns
    df = standardize_columns(raw)
    out = []
    for name, dtype in UPLOAD_TYPES.items():
        if name not in df.columns:
            out.append(F.lit(None).cast(dtype).alias(name))
            continue
        c = normalise_missing(F.col(name).cast("string"))
        out.append((c if isinstance(dtype, T.StringType) else F.trim(c).try_cast(dtype)).alias(name))
    return df.select(*out, *[F.col(c) for c in df.columns if c not in UPLOAD_TYPES])


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on extension; other types raise (Excel is not read)."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".csv":
        return read_raw_csv(spark, path)
    if ext == ".parquet":
        return spark.read.parquet(path)
    if ext == ".json":
        return spark.read.json(path)
    raise ValueError(f"Unsupported file format: {ext}")


def read_stage(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """Read a stage output; an absent stage gives None. A CSV stage
    comes back with the types that :func:`write_stage` noted beside it."""
    if not _exists(spark, path):
        return None
    if fmt == "csv":
        noted = spark.read.text(f"{path}_schema").first()
        return spark.read.schema(T.StructType.fromJson(json.loads(noted.value))).option("header", True).csv(path)
    return spark.read.format(fmt).load(path)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Overwrite a stage output (Parquet, or CSV with a header)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
        df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_schema")
    else:
        w.format(fmt).save(path)
    return path


def write_summary(summary: DataFrame, path: str) -> str:
    """A one-row summary DataFrame as JSON (one file)."""
    summary.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_summary(spark: SparkSession, path: str) -> DataFrame | None:
    """A summary written by :func:`write_summary` (None when absent)."""
    if not _exists(spark, path):
        return None
    return spark.read.json(path)


def read_summary_variant(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored summary as one VARIANT column ``summary``: nothing is inferred from the file, so a summary
    that lacks a field, or has others, reads the same (None when absent)."""
    if not _exists(spark, path):
        return None
    return spark.read.text(path).select(F.try_parse_json("value").alias("summary"))


def write_snapshot(summary: DataFrame, root: str, dataset_id: int, snapshot_ts: str) -> str:
    """Timestamped exploration snapshot, partitioned by dataset and time. Written again, it replaces itself
    and no other snapshot (dynamic partition overwrite)."""
    out = summary.withColumn("dataset_id", F.lit(dataset_id)).withColumn("snapshot_ts", F.lit(snapshot_ts))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id", "snapshot_ts").json(root)
    return root


def read_latest_snapshot(spark: SparkSession, root: str, dataset_id: int, schema: str | None = None) -> DataFrame | None:
    """The newest snapshot of one dataset, reading its partition alone.

    The newest time comes from the partition values of the dataset's folder (no JSON field is read)."""
    if not _exists(spark, root):
        return None
    values = spark.read.schema("dataset_id int, snapshot_ts string").json(root)
    newest = values.where(F.col("dataset_id") == dataset_id).agg(F.max("snapshot_ts")).first()[0]
    if newest is None:
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    found = reader.json(f"{root.rstrip('/')}/dataset_id={dataset_id}/snapshot_ts={newest}")
    return found.withColumns({"dataset_id": F.lit(dataset_id), "snapshot_ts": F.lit(newest)})


def latest_snapshot(snapshots: DataFrame, key: str = "dataset_id", ts: str = "snapshot_ts") -> DataFrame:
    """The newest snapshot per dataset (greatest timestamp text)."""
    latest = snapshots.groupBy(key).agg(F.max(ts).alias(ts))
    return snapshots.join(latest, [key, ts])


def dataset_header(df: DataFrame) -> DataFrame:
    """Column count and record count (records, not physical lines)."""
    return df.agg(F.count(F.lit(1)).alias("row_count")) \
             .select(F.lit(len(df.columns)).cast("bigint").alias("column_count"), "row_count")


def dataset_columns(df: DataFrame) -> list[str]:
    """Column names of a stored dataset."""
    return list(df.columns)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)

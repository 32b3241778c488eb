"""A training-data pipeline over ``documents``: five stages, each written and read again.

Stages, in order: quality classifier, SimHash near-dedup, substring dedup, benchmark
decontamination, best-fit packing. Each takes (spark, docs, sf_dir) and works on all rows that
its predecessor kept; the first four return the columns of ``documents``, the last the packed
pieces. A stage reads ``labels`` or ``benchmark`` from ``sf_dir`` where it needs them, and writes
what it hands on to the shared scratch folder.

Every row is judged for itself, whatever its doc_id: rows that share an id, or have none, keep
their own texts and fates.

Cases, for every stage: extra columns are handed on as they are, whatever their names; an empty table
gives an empty table; a null text is an empty one to the operators and stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, packing, quality, simhash, substrings
from ledgerlens.llm.common import scratch, table, without_rows, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on the labelled documents, rejects."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays, the one with the smallest doc_id (a null id
    comes last; of rows with one id, the first read). Rows are numbered first, and the numbers stand in for ids."""
    row = "row"
    while row in docs.columns:
        row += "_"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), scratch(spark, "rows"))
    groups = simhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    linked = written(groups.join(rows.select(row, "doc_id"), row), scratch(spark, "near-duplicates"))
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first"))
    lost = linked.select(row).join(first.select(F.col("first")[row].alias(row)), row, "left_anti")
    return without_rows(rows, row, lost)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages: a text that loses words becomes its kept words joined by one space,
    and n_chars their length; the others stay as they are. No row is dropped, so a text that
    repeats earlier ones as a whole becomes empty. A row with a null doc_id has no place in the order and keeps its text."""
    return substrings.cut_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item, whole or edited."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: SQL cannot express the stages; tests/llm holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), scratch(spark, name))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Stage drivers: the reference's batch steps as Spark jobs.

Each driver reads its input stage, runs the operators, writes its output
table (Parquet by default) and a one-row JSON summary under ``out_dir``,
and returns ``(output DataFrame, summary DataFrame)``. Outputs are read
back from storage, so every later stage starts from a materialised table
rather than replaying the lineage of all earlier stages.

Stage order: exploration -> cleaning step 1 -> cleaning step 2 -> recency
-> RFM base -> scores -> segments -> clusters.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import iso_string, parse_timestamp, pct
from ledgerlens.functions.names import standardize_columns, validate_required_strict
from ledgerlens.functions.scalars import one_row
from ledgerlens.operators import clean, cluster, profile, rfm, score, segment
from ledgerlens.sources import io


def _path(out_dir: str, name: str) -> str:
    return os.path.join(out_dir, name)


def _store(df: DataFrame, out_dir: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Write a stage table and read it back: what follows never recomputes it."""
    io.write_stage(df, _path(out_dir, name), fmt=fmt)
    return io.read_stage(df.sparkSession, _path(out_dir, name), fmt=fmt)


def _note(summary: DataFrame, out_dir: str, name: str) -> DataFrame:
    """Write a one-row summary and read it back."""
    io.write_summary(summary, _path(out_dir, f"{name}_summary"))
    return io.read_summary(summary.sparkSession, _path(out_dir, f"{name}_summary"))


def run_exploration(raw: DataFrame, out_dir: str) -> dict[str, DataFrame]:
    """Every exploration table, each written as JSON."""
    parts = profile.exploration(raw)
    for name, df in parts.items():
        io.write_summary(df, _path(out_dir, f"exploration_{name}"))
    return parts


def _noted_row(spark: SparkSession, figures: dict) -> DataFrame:
    """Observed figures (all bigint but dates) as a one-row frame."""
    kinds = {k: "timestamp" if k.startswith("_") else "bigint" for k in figures}
    row = tuple(v if kinds[k] == "timestamp" or v is not None else 0 for k, v in figures.items())
    return spark.createDataFrame([row], ", ".join(f"{k} {t}" for k, t in kinds.items()))


def run_cleaning_step1(raw: DataFrame, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """standardise names, check the 8 required columns, dedupe, drop missing ids.

    One scan and one shuffle: the dedupe keeps the copies of each distinct row, and the
    summary's counts are observed on the distinct rows while the stage is written. They are taken in the
    writing stage, whose tasks count once each, so a lost executor does not change them.
    """
    df = standardize_columns(raw)
    ok, msg = validate_required_strict(df.columns)
    if not ok:
        raise ValueError(msg)
    copies = "copies"
    while copies in df.columns:
        copies += "_"
    distinct = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))
    seen, missing = Observation("step 1"), clean.missing_customer()
    observed = distinct.observe(seen, F.sum(copies).alias("initial_rows"), F.count_if(missing).alias("missing_customers_removed"),
                                F.count_if(~missing).alias("final_rows"))
    out = _store(clean.drop_missing_customers(observed).drop(copies), out_dir, "cleaned_step1")
    return out, _note(step1_summary(_noted_row(df.sparkSession, seen.get), out.columns), out_dir, "cleaned_step1")


def step1_summary(counts: DataFrame, columns: list[str]) -> DataFrame:
    """The figures of step 1 from (initial_rows, final_rows, missing_customers_removed)."""
    gone = F.col("initial_rows") - F.col("final_rows")
    return counts.select("initial_rows", (gone - F.col("missing_customers_removed")).alias("duplicates_removed"), "missing_customers_removed",
                         "final_rows", gone.alias("rows_removed"), pct(gone, "initial_rows").alias("removed_pct"),
                         F.array(*[F.lit(c) for c in columns]).alias("columns"))


def step2_summary(counts: DataFrame) -> DataFrame:
    """The figures of step 2 from the observed counts."""
    return counts.select("initial_rows", *[f"{name}_removed" for code, name in clean.STEPS if code > 2], "dates_parsed", "parse_errors",
                         pct("dates_parsed", "initial_rows").alias("parse_success_rate"), "final_rows",
                         iso_string("_low").alias("min_date"), iso_string("_high").alias("max_date"),
                         pct(F.col("initial_rows") - F.col("final_rows"), "initial_rows").alias("removed_pct"))


def run_cleaning_step2(step1: DataFrame, out_dir: str, cutoff=clean.DEFAULT_DATE_CUTOFF) -> tuple[DataFrame, DataFrame]:
    """the step-2 rules and revenue; the summary has the figures of each rule.

    One scan: each row is tagged with the first rule that removes it, and rows by rule, parse figures and
    dates of what is left are observed while the stage is written."""
    is_ts = dict(step1.dtypes)["invoicedate"].startswith("timestamp")
    ts = F.col("invoicedate").cast("timestamp") if is_ts else parse_timestamp("invoicedate")
    seen, rule = Observation("step 2"), clean.rule_code(ts, cutoff)
    observed = step1.observe(
        seen, F.count(F.lit(1)).alias("initial_rows"), *[F.count_if(rule == code).alias(f"{name}_removed") for code, name in clean.STEPS if code > 2],
        F.count(ts).alias("dates_parsed"), F.count_if(ts.isNull()).alias("parse_errors"), F.count_if(rule == 0).alias("final_rows"),
        F.min(F.when(rule == 0, ts)).alias("_low"), F.max(F.when(rule == 0, ts)).alias("_high"))
    out = _store(clean.clean_step2(observed, cutoff=cutoff), out_dir, "cleaned_final")
    return out, _note(step2_summary(_noted_row(step1.sparkSession, seen.get)), out_dir, "cleaned_final")


def run_recency(tx: DataFrame, out_dir: str, reference=None) -> tuple[DataFrame, DataFrame]:
    """Customer recency table, the transactions with their customer's
    recency (``data_with_recency``), and the recency summary (stats, quartiles, buckets)."""
    rec = _store(rfm.customer_recency(tx, reference), out_dir, "rfm_recency")
    io.write_stage(rfm.transactions_with_recency(tx, rec), _path(out_dir, "data_with_recency"))
    summary = one_row(rfm.reference_date(tx, reference), rfm.recency_summary(tx, rec))
    return rec, _note(summary, out_dir, "rfm_recency")


#: Fields of the short recency view and their types.
PREVIEW = {"reference_date": "string", "unique_customers": "bigint", "recency_min": "bigint", "recency_max": "bigint",
           "recency_mean": "double", "recency_median": "double"}


def stored_recency_preview(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """The short view of a stored recency summary: six of its fields; one that the summary lacks is null."""
    found = io.read_summary_variant(spark, _path(out_dir, "rfm_recency_summary"))
    if found is None:
        return None
    return found.select(*[F.try_variant_get("summary", f"$.{name}", dtype).alias(name) for name, dtype in PREVIEW.items()])


def run_rfm_base(tx: DataFrame, out_dir: str, reference=None) -> tuple[DataFrame, DataFrame]:
    """The RFM base, validated, with its statistics.

    One aggregation by customer over the cleaned transactions; it gives the
    same rows as joining the recency, frequency and monetary frames
    (``rfm.rfm_base_joined``, checked in the tests) with one pass instead of
    three plus two joins.
    """
    base = _store(rfm.rfm_base(tx, reference), out_dir, "rfm_base")
    check = rfm.validate_rfm_base(base).first()
    if not check.is_valid:
        raise ValueError(check.message)
    return base, _note(rfm.rfm_statistics(base), out_dir, "rfm_base")


def run_scoring(base: DataFrame, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """Quintile scores and the score distribution summary."""
    out = _store(score.score_rfm(base), out_dir, "rfm_scores")
    io.write_summary(score.score_distribution(out), _path(out_dir, "rfm_scores_distribution"))
    io.write_summary(score.top_rfm_scores(out), _path(out_dir, "rfm_scores_top"))
    return out, _note(score.rfm_total_stats(out), out_dir, "rfm_scores")


def run_segment_mapping(scores: DataFrame, out_dir: str, mode: str = "last_match") -> tuple[DataFrame, DataFrame]:
    """Segments, per-segment metrics, ranking and totals."""
    out = _store(segment.assign_segments(scores, mode), out_dir, "customer_segments")
    io.write_summary(segment.segment_metrics(out), _path(out_dir, "customer_segments_metrics"))
    io.write_summary(segment.segment_ranking(segment.segment_metrics(out)), _path(out_dir, "customer_segments_ranking"))
    return out, _note(segment.segment_totals(out), out_dir, "customer_segments")


def run_clustering(seg: DataFrame, out_dir: str, k: int = 4, seed: int = 42, n_init: int = 10
                   ) -> tuple[DataFrame, DataFrame]:
    """M6: scale, fit (best of ``n_init`` seeds), assign, label; centroid summary.

    ``seg``: the segment table or, where there is none yet, the score table."""
    scaled = cluster.scale_rfm(seg)
    assigned, cents, cost = cluster.kmeans_clusters(scaled, k=k, seed=seed, n_init=n_init)
    out = _store(assigned, out_dir, "customer_clusters")
    return out, _note(cluster.centroid_summary(out, cents, k, inertia=cost), out_dir, "customer_clusters")


def clustering_input(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """The stored segments, else the stored scores, else None."""
    seg = io.read_stage(spark, _path(out_dir, "customer_segments"))
    return seg if seg is not None else io.read_stage(spark, _path(out_dir, "rfm_scores"))


def run_all(raw: DataFrame, out_dir: str, cutoff=clean.DEFAULT_DATE_CUTOFF, reference=None,
            mode: str = "last_match", clusters: bool = True) -> dict[str, DataFrame]:
    """Every stage in order; returns the stage tables."""
    s1, _ = run_cleaning_step1(raw, out_dir)
    tx, _ = run_cleaning_step2(s1, out_dir, cutoff)
    rec, _ = run_recency(tx, out_dir, reference)
    base, _ = run_rfm_base(tx, out_dir, reference)
    scores, _ = run_scoring(base, out_dir)
    seg, _ = run_segment_mapping(scores, out_dir, mode)
    out = {"cleaned_step1": s1, "cleaned_final": tx, "rfm_recency": rec, "rfm_base": base,
           "rfm_scores": scores, "customer_segments": seg}
    if clusters:
        out["customer_clusters"], _ = run_clustering(seg, out_dir)
    return out

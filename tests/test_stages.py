"""The stage drivers end to end on fixture A (sf0.001)."""

import os
import tempfile

from ledgerlens.plans import fixture as fx
from ledgerlens.plans.stages import run_all, run_exploration
from ledgerlens.sources import io
from ledgerlens.sources.adapters import dirty_transactions


def test_run_all_stages(spark, sf001):
    out_dir = tempfile.mkdtemp(prefix="ledgerlens-stages-")
    raw = dirty_transactions(spark, sf001)
    tables = run_all(raw, out_dir, cutoff=fx.FIXTURE_CUTOFF, clusters=True)
    assert tables["cleaned_final"].count() == 4134
    assert tables["rfm_base"].count() == 150
    counts = {r.segment: r["count"] for r in tables["customer_segments"].groupBy("segment").count().collect()}
    assert counts == {"Loyal": 37, "New": 10, "At Risk": 30, "Low Engagement": 23, "Other": 50}
    assert tables["customer_clusters"].select("cluster_id").distinct().count() <= 4
    for name in ("cleaned_step1_summary", "cleaned_final_summary", "rfm_recency_summary", "rfm_base_summary",
                 "rfm_scores_summary", "customer_segments_summary", "customer_clusters_summary"):
        assert io.read_summary(spark, os.path.join(out_dir, name)) is not None, name
    s = io.read_summary(spark, os.path.join(out_dir, "cleaned_final_summary")).first()
    assert (s.initial_rows, s.final_rows) == (5127, 4134)


def test_exploration_stage(spark, sf001):
    out_dir = tempfile.mkdtemp(prefix="ledgerlens-explore-")
    parts = run_exploration(dirty_transactions(spark, sf001), out_dir)
    dup = parts["duplicates"].first()
    assert (dup.total_rows, dup.duplicate_rows) == (6207, 209)

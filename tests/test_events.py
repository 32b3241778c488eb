"""Fixture B (purchase events, times of day) against the FIXTURES.md golden values."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import clean, rfm
from ledgerlens.sources.adapters import event_purchases

SF01 = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(f"{SF01}/events.parquet"), reason="test tables not available")
def test_event_fixture_golden_sf001(spark):
    tx = clean.clean_transactions(event_purchases(spark, SF01), cutoff=None)
    assert tx.count() == 1981
    base = rfm.rfm_base(tx)
    a = base.agg(F.count(F.lit(1)).alias("n"), F.sum("monetary").alias("m"),
                 F.min("recency").alias("lo"), F.max("recency").alias("hi")).first()
    assert (a.n, float(a.m), a.lo, a.hi) == (150, 95455.77, 1, 12)
    last = rfm.customer_last_purchase(tx)
    ref = last.agg(F.max("last_purchase")).first()[0]
    cal = base.join(last, "customerid").withColumn(
        "cal", F.datediff(F.to_date(F.lit(ref) + F.expr("INTERVAL 1 DAY")), F.to_date("last_purchase")))
    assert cal.where(F.col("cal") != F.col("recency")).count() == 4

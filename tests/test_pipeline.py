"""Cleaning rules, waterfall, RFM base and segments (fixture A golden values)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import iso_string, parse_timestamp
from ledgerlens.operators import clean, dashboard, rfm, score, segment
from ledgerlens.plans import fixture as fx
from ledgerlens.plans import stages
from ledgerlens.sources.adapters import RAW_SCHEMA, dirty_transactions

CUT = fx.FIXTURE_CUTOFF


def _raw(spark, rows):
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_rules_with_nulls(spark):
    rows = [
        ("1", "A", "x", 2, "2010-12-01 08:26:00", Decimal("2.55"), "17850", "UK"),   # kept
        ("2", "A", "x", None, "2010-12-01 08:26:00", Decimal("2.55"), "17850", "UK"),  # null qty
        ("3", "A", "x", 1, "2010-12-01 08:26:00", None, "17850", "UK"),  # null price
        (None, "A", "x", 1, "2010-12-01 08:26:00", Decimal("1.00"), "17850", "UK"),  # null invoice kept
        ("c123", "A", "x", 1, "2010-12-01 08:26:00", Decimal("1.00"), "17850", "UK"),  # lower-case c kept
        ("C124", "A", "x", 1, "2010-12-01 08:26:00", Decimal("1.00"), "17850", "UK"),  # cancelled
        ("5", "A", "x", 1, "garbage", Decimal("1.00"), "17850", "UK"),  # bad date
        ("6", "A", "x", 1, "2012-01-01 00:00:00", Decimal("1.00"), "17850", "UK"),  # after cutoff
        ("7", "A", "x", 1, "2010-12-01 08:26:00", Decimal("1.00"), "nAn", "UK"),  # missing id
        ("8", "A", "x", 1, "2010-12-01 08:26:00", Decimal("1.00"), "", "UK"),  # missing id
        ("1", "A", "x", 2, "2010-12-01 08:26:00", Decimal("2.55"), "17850", "UK"),  # duplicate
    ]
    df = _raw(spark, rows)
    out = clean.clean_transactions(df).collect()
    assert sorted(str(r.invoiceno) for r in out) == ["1", "None", "c123"]
    assert all(r.customerid == "17850" for r in out)
    w = {r.rule: (r.rows_before, r.removed, r.rows_after) for r in clean.cleaning_waterfall(df).collect()}
    assert w["duplicates"] == (11, 1, 10)
    assert w["missing_customer_id"][1] == 2
    assert w["non_positive_quantity"][1] == 1
    assert w["non_positive_unit_price"][1] == 1
    assert w["invalid_date"][1] == 2
    assert w["cancelled_invoice"] == (4, 1, 3)


def test_waterfall_golden_sf0001(spark, sf001):
    raw = dirty_transactions(spark, sf001)
    w = {r.rule: r for r in clean.cleaning_waterfall(raw, cutoff=CUT).collect()}
    assert w["duplicates"].rows_before == 6207 and w["duplicates"].rows_after == 5998
    assert w["missing_customer_id"].rows_after == 5127
    assert [w[k].removed for k in ("non_positive_quantity", "non_positive_unit_price", "invalid_date",
                                   "cancelled_invoice")] == [265, 100, 195, 433]
    assert w["cancelled_invoice"].rows_after == 4134
    # the waterfall adds up: every removal plus what is kept equals the input
    assert sum(r.removed for r in w.values()) + 4134 == 6207


def test_rfm_golden_sf0001(spark, sf001):
    tx = clean.clean_transactions(dirty_transactions(spark, sf001), cutoff=CUT)
    base = rfm.rfm_base(tx)
    agg = base.agg(F.count(F.lit(1)).alias("n"), F.sum("frequency").alias("f"), F.sum("monetary").alias("m"),
                   F.min("recency").alias("rmin"), F.max("recency").alias("rmax")).first()
    assert (agg.n, agg.f, float(agg.m), agg.rmin, agg.rmax) == (150, 1085, 95288950.5, 1, 2039)
    joined = rfm.rfm_base_joined(rfm.customer_recency(tx), rfm.customer_frequency(tx), rfm.customer_monetary(tx))
    assert base.exceptAll(joined).count() == 0 and joined.exceptAll(base).count() == 0
    q = rfm.recency_quartiles(rfm.customer_recency(tx)).first()
    assert (q.p25, q.p50, q.p75) == (118.75, 264.0, 450.75)
    b = rfm.recency_buckets(rfm.customer_recency(tx)).first()
    assert (b.recent_0_30_days, b.recent_31_60_days, b.recent_61_90_days, b.recent_90_plus_days) == (12, 10, 8, 120)
    scores = score.score_rfm(base)
    counts = sorted(r["count"] for r in scores.groupBy("recency_score").count().collect())
    assert counts == [30, 30, 30, 30, 30]
    for mode, want in (("last_match", {"Loyal": 37, "New": 10, "At Risk": 30, "Low Engagement": 23, "Other": 50}),
                       ("first_match", {"High Value": 25, "Loyal": 12, "New": 10, "At Risk": 30,
                                        "Low Engagement": 23, "Other": 50})):
        seg = segment.assign_segments(scores, mode)
        got = {r.segment: r.customer_count for r in segment.segment_counts(seg).collect()}
        assert got == want


def test_scores_with_forced_buckets_equal_single_window(spark, sf001):
    tx = clean.clean_transactions(dirty_transactions(spark, sf001), cutoff=CUT)
    base = rfm.rfm_base(tx).cache()
    a = score.score_rfm(base).select("customerid", "rfm_score")
    b = score.score_rfm(base, ranges=12).select("customerid", "rfm_score")
    assert a.exceptAll(b).count() == 0 and b.count() == 150


def test_recency_floor_and_earlier_reference(spark):
    rows = [("1", "A", "x", 1, "2011-12-09 23:00:00", Decimal("1.00"), "1", "UK")]
    tx = clean.clean_transactions(_raw(spark, rows))
    assert rfm.customer_recency(tx, reference="2011-12-10 12:50:00").first().recency == 0
    assert rfm.customer_recency(tx, reference="2011-12-09 22:00:00").first().recency == -1


def test_monetary_not_positive_absent(spark):
    rows = [("1", "A", "x", 1, "2011-01-01 00:00:00", Decimal("5.00"), "1", "UK"),
            ("2", "A", "x", 1, "2011-01-02 00:00:00", Decimal("5.00"), "2", "UK")]
    tx = clean.clean_transactions(_raw(spark, rows))
    # customer 2 nets to zero once a negative line is included directly in the transactions
    neg = tx.unionByName(tx.where(F.col("customerid") == 2).withColumn("total_revenue", -F.col("total_revenue"))
                           .withColumn("invoiceno", F.lit("3")))
    ids = [r.customerid for r in rfm.rfm_base(neg).collect()]
    assert ids == ["1"]


def test_reference_date_row(spark):
    rows = [("1", "A", "x", 1, "2011-01-01 10:00:00", Decimal("5.00"), "1", "UK"),
            ("2", "A", "x", 1, "2011-01-05 08:00:00", Decimal("5.00"), "2", "UK")]
    r = rfm.reference_date(clean.clean_transactions(_raw(spark, rows))).first()
    assert r.reference_date == "2011-01-06T08:00:00"
    assert r.date_range_days == 3
    assert dt.date.fromisoformat(r.max_date_in_data[:10]) == dt.date(2011, 1, 5)


def test_validate_rfm_base(spark):
    ok = spark.createDataFrame([(1, 2, 3, 4.0)], "customerid long, recency long, frequency long, monetary double")
    assert rfm.validate_rfm_base(ok).first().is_valid
    bad = spark.createDataFrame([(1, None, 3, 4.0)], "customerid long, recency long, frequency long, monetary double")
    r = rfm.validate_rfm_base(bad).first()
    assert not r.is_valid and r.null_values == 1
    r = rfm.validate_rfm_base(ok.drop("monetary")).first()
    assert not r.is_valid and "monetary" in r.message


def test_customer_id_text_forms(spark):
    rows = [("1", "A", "x", 1, "2011-01-01 00:00:00", Decimal("5.00"), "17850.0", "UK"),
            ("2", "A", "x", 1, "2011-01-01 00:00:00", Decimal("5.00"), " 17851 ", "UK"),
            ("3", "A", "x", 1, "2011-01-01 00:00:00", Decimal("5.00"), "17852.5", "UK")]
    ids = sorted(r.customerid for r in clean.clean_transactions(_raw(spark, rows)).collect())
    assert ids == ["17850", "17851", "17852.5"]


def test_text_ids_keep_their_customers(spark, tmp_path):
    """Ids that are no numbers go through all stages."""
    rows = [(str(i), "A", "x", 1, "2011-01-01 00:00:00", Decimal("5.00"), f"C{i:03d}", "UK") for i in range(30)]
    step1, _ = stages.run_cleaning_step1(_raw(spark, rows), str(tmp_path))
    tx, _ = stages.run_cleaning_step2(step1, str(tmp_path))
    base, _ = stages.run_rfm_base(tx, str(tmp_path))
    assert sorted(r.customerid for r in base.collect()) == [f"C{i:03d}" for i in range(30)]


@pytest.mark.parametrize("text,iso", [
    ("2010-12-01 08:26:00", "2010-12-01T08:26:00"), ("12/1/10 8:26", "2010-12-01T08:26:00"), ("12/01/2010", "2010-12-01T00:00:00"),
    ("2010-12-01T08:26:00Z", "2010-12-01T08:26:00"), ("2010-12-01T08:26:00.123", "2010-12-01T08:26:00"),
    ("2010-12-01T11:00:00+02:00", "2010-12-01T09:00:00"), ("2010-12", "2010-12-01T00:00:00"), ("12/1/2010 8:26:05", "2010-12-01T08:26:05"),
    ("2010-13-01", None), ("13/45/2010", None), ("08:26", None), ("not-a-date", None), ("", None), (None, None)])
def test_date_forms(spark, text, iso):
    df = spark.createDataFrame([(text,)], "invoicedate string")
    assert df.select(iso_string(parse_timestamp("invoicedate"))).first()[0] == iso


def test_date_bounds_read_zones_fractions_and_other_forms(spark):
    df = spark.createDataFrame([("2010-12-01T10:00:00.600Z",), ("2010-12-02 00:00:00",)], "invoicedate string")
    n = lambda *b, **k: dashboard.filter_dates(df, *b, **k).count()
    assert n("2010-12-01T11:00:00+02:00") == 2 and n("2010-12-01T13:00:00+02:00") == 1
    assert n("2010-12-01T10:00:00.500") == 2 and n("2010-12-01T10:00:00.700") == 1
    assert n("12/02/2010") == 1 and n(None, "2010-12") == 0 and n("2010-12", None) == 2 and n("nonsense") == 2
    with pytest.raises(ValueError):
        n("nonsense", strict=True)

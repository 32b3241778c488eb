"""Names, rule table and the quintile formula (fixture C)."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import names
from ledgerlens.functions.exprs import floor_days, quintile_bin
from ledgerlens.functions.rules import segment_expr
from ledgerlens.operators.dashboard import parse_segments, parse_segments_col


def test_standardize_names():
    got = [names.standardize_name(c) for c in ["InvoiceNo", " Stock-Code ", "Invoice No", "Unit Price (£)", "a__b"]]
    assert got == ["invoiceno", "stock_code", "invoice_no", "unit_price_", "a_b"]
    ok, msg = names.validate_required_strict(got)
    assert not ok and "stockcode" in msg and "unitprice" in msg


def test_standardize_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`Invoice No` int, invoice_no int")
    with pytest.raises(ValueError):
        names.standardize_columns(df)


def test_fuzzy_validation():
    ok, missing, extra = names.validate_required_fuzzy(["no"])
    assert not ok
    assert "InvoiceNo" not in missing  # 'no' is contained in 'invoiceno'
    assert "Quantity" in missing and extra == ["no"]
    ok, missing, _ = names.validate_required_fuzzy([c.upper() for c in names.REQUIRED_COLUMNS])
    assert ok and missing == []


def test_column_check_frame(spark):
    rows = {r["required"]: r["status"] for r in names.column_check_frame(spark, ["InvoiceNo", "no", "qty"]).collect()}
    assert rows["InvoiceNo"] == "exact"
    assert rows["Quantity"] == "missing"
    assert len(rows) == 8


def _qcut_bins(n):
    ranks = pd.Series(np.arange(1, n + 1), dtype=float)
    return pd.qcut(ranks, q=5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()


def test_quintile_formula_matches_qcut(spark):
    rows = [(n, rn) for n in range(2, 61) for rn in range(1, n + 1)]
    df = spark.createDataFrame(rows, "n long, rn long").select("n", "rn", quintile_bin("rn", "n").alias("b"))
    got = {}
    for r in df.collect():
        got.setdefault(r.n, {})[r.rn] = r.b
    for n in range(2, 61):
        assert [got[n][i] for i in range(1, n + 1)] == _qcut_bins(n), n


def test_quintile_single_row_is_null(spark):
    r = spark.createDataFrame([(1, 1)], "n long, rn long").select(quintile_bin("rn", "n").alias("b")).first()
    assert r.b is None


def test_segment_rules_all_cells(spark):
    cells = list(itertools.product(range(1, 6), repeat=3))
    df = spark.createDataFrame(cells, "recency_score int, frequency_score int, monetary_score int")
    last = {r["s"]: r["count"] for r in df.select(segment_expr(mode="last_match").alias("s")).groupBy("s").count().collect()}
    first = {r["s"]: r["count"] for r in df.select(segment_expr(mode="first_match").alias("s")).groupBy("s").count().collect()}
    assert last == {"Other": 59, "At Risk": 24, "Loyal": 18, "New": 16, "Low Engagement": 8}
    assert first == {"Other": 59, "At Risk": 24, "Loyal": 10, "High Value": 8, "New": 16, "Low Engagement": 8}


def test_parse_segments(spark):
    assert parse_segments(" Loyal, ,At Risk ,") == ["Loyal", "At Risk"]
    assert parse_segments(None) == []
    r = spark.createDataFrame([(" Loyal, ,At Risk ,",)], "s string").select(parse_segments_col("s").alias("a")).first()
    assert r.a == ["Loyal", "At Risk"]


def test_floor_days(spark):
    df = spark.createDataFrame([("2011-12-10 12:50:00", "2011-12-09 23:00:00"),
                                ("2011-12-09 22:00:00", "2011-12-09 23:00:00")], "ref string, last string")
    got = [r.d for r in df.select(floor_days(F.to_timestamp("ref"), F.to_timestamp("last")).alias("d")).collect()]
    assert got == [0, -1]  # calendar difference would give 1 for the first

"""Texts, sections, empty selections and null segments of the reports; typed CSV stages."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import plain_number
from ledgerlens.functions.names import validation_report
from ledgerlens.operators import dashboard, insight, narrative
from ledgerlens.plans import stages
from ledgerlens.sources import io

SCHEMA = "customerid string, segment string, recency long, frequency long, monetary decimal(20,2)"


def _seg(spark, rows):
    return spark.createDataFrame([(f"c{i}", s, 5, 2, Decimal(m)) for i, (s, m) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("value,text", [(218673536.1, "218673536.1"), (2e8, "200000000.0"), (12.345, "12.35"), (0.0, "0.0"), (7.1, "7.1")])
def test_numbers_are_never_scientific(spark, value, text):
    assert spark.createDataFrame([(value,)], "x double").select(plain_number("x")).first()[0] == text


def test_money_in_sentences_is_plain(spark):
    seg = _seg(spark, [("At Risk", "218673536.10"), ("Loyal", "1.00")])
    row = insight.executive_sentences(seg).first()
    assert "representing $218673536.1 in potential revenue loss" in row.risk_alert


def test_of_equally_large_segments_the_one_with_more_revenue_is_named(spark):
    seg = _seg(spark, [("At Risk", "5.00")] * 10 + [("Loyal", "15.00")] * 10)
    bullets = narrative.executive_text(narrative.narrative_metrics(seg)).first().bullets
    assert bullets[1] == "Loyal is the largest segment with 10 customers"


def test_totals_come_from_the_rows_when_metrics_are_supplied(spark, tmp_path):
    seg = _seg(spark, [("Loyal", "10.00"), ("New", "30.00")])
    supplied = narrative.narrative_metrics(seg).where("segment = 'Loyal'")
    parts = narrative.full_summary(seg, supplied_metrics=supplied)
    assert parts["executive"].first().summary_text.startswith("Analysis of 2 customers generating $40 ")
    assert set(parts) == {"totals", "segment_metrics", "executive", "segment_summaries", "risk", "growth"}
    narrative.write_full_summary(parts, str(tmp_path / "summary"))
    assert io.read_summary(spark, str(tmp_path / "summary/totals")).first().total_customers == 2


def test_rows_without_a_segment_are_in_no_group(spark):
    seg = _seg(spark, [("Loyal", "10.00"), (None, "99.00")])
    assert [r.segment for r in narrative.narrative_metrics(seg).collect()] == ["Loyal"]
    assert insight.top_revenue_segment(seg).first().segment == "Loyal"
    trends = spark.createDataFrame([("2011-01", "Loyal", 1.0), ("2011-02", None, 2.0), ("2011-02", "it's", 3.0)],
                                   "year_month string, segment string, revenue double")
    found = {(r.year_month, r.segment): r.revenue for r in dashboard.monthly_trends_filled(trends).collect()}
    assert found == {("2011-01", "Loyal"): 1.0, ("2011-01", "it's"): 0.0, ("2011-02", "Loyal"): 0.0, ("2011-02", "it's"): 3.0}


def test_empty_selection_says_so_and_sections_are_complete(spark):
    seg = _seg(spark, [("Loyal", "10.00"), ("New", "30.00")])
    empty = dashboard.dashboard(seg, segments=["At Risk"])
    assert tuple(empty["status"].first()) == (False, "No data matches the specified filters.")
    assert tuple(dashboard.dashboard(seg, segments=["Loyal"])["status"].first()) == (True, None)
    parts = insight.filtered_sections(seg, ["Loyal"])
    assert {k: v.count() for k, v in parts.items()} == {"main": 1, "segment_distribution": 1, "segment_value_analysis": 1, "growth_opportunities": 1}
    assert parts["segment_distribution"].first().percentage == 100.0
    assert set(insight.generate_insights(seg)) >= {"totals", "at_risk", "executive_summary", "distribution"}


def test_validation_report_maps_every_column():
    columns = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "Discount", "Country"]
    report = validation_report(columns)
    assert report == {"is_valid": False, "errors": ["CustomerID"], "warnings": ["Discount"], "mapping": {c: c for c in columns}}


def test_csv_stage_keeps_its_types(spark, tmp_path):
    df = _seg(spark, [("Loyal", "10.00"), ("New", "9.50")])
    path = io.write_stage(df, str(tmp_path / "seg"), fmt="csv")
    back = io.read_stage(spark, path, fmt="csv")
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())


def test_clustering_falls_back_to_the_scores(spark, tmp_path):
    assert stages.clustering_input(spark, str(tmp_path)) is None
    io.write_stage(spark.range(3).withColumn("a", F.lit(1)), str(tmp_path / "rfm_scores"))
    assert stages.clustering_input(spark, str(tmp_path)).count() == 3
    io.write_stage(spark.range(2), str(tmp_path / "customer_segments"))
    assert stages.clustering_input(spark, str(tmp_path)).count() == 2


def test_text_quantities_and_prices_of_an_upload(spark, tmp_path):
    path = tmp_path / "up.csv"
    path.write_text("CustomerID,InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,Country\n"
                    "C1,1,A,x,6.0,12/1/10 8:26,0.001,UK\nC2,2,A,x,1.5,2010-12-01T08:26:00Z,1.2345,UK\nNA,3,A,x,#N/A,2010-12-01,-nan,UK\n")
    rows = {r.invoiceno: r for r in io.load_table(spark, str(path)).collect()}
    assert (rows["1"].quantity, rows["1"].unitprice) == (6, Decimal("0.001000"))
    assert (rows["2"].quantity, rows["2"].unitprice) == (Decimal("1.5"), Decimal("1.234500"))
    assert rows["3"].customerid is None and rows["3"].quantity is None and rows["3"].unitprice is None

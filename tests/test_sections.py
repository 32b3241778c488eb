"""Sections from one grouping-sets pass, observed stage counts, rejects, snapshots, variant summaries, k-means seeding."""

import json
import os
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import cluster, dashboard, insight, profile, sections
from ledgerlens.plans import stages
from ledgerlens.sources import io


@pytest.fixture(scope="module")
def dated(spark):
    r = random.Random(3)
    names = ["Loyal", "At Risk", "New", "Low Engagement", "High Value", None]
    rows = [(i, r.choice(names), r.choice([None, *range(200)]), r.randint(1, 9), Decimal(r.randint(100, 99999)) / 100,
             r.choice([None, "nonsense", f"2011-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} 10:00:00"])) for i in range(400)]
    return spark.createDataFrame(rows, "customerid long, segment string, recency int, frequency int, monetary decimal(12,2), invoicedate string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert len(x) == len(y) and all(p == q or (isinstance(p, float) and p == pytest.approx(q, rel=1e-12)) for p, q in zip(x, y)), (x, y)


def test_sections_equal_their_own_aggregates(dated):
    cube = sections.cube(dated)
    close(rows(sections.kpi(cube)), rows(dashboard.kpi_summary(dated)))
    close(rows(sections.revenue_by_segment(cube)), rows(dashboard.revenue_by_segment(dated)))
    close(rows(sections.segment_share(cube)), rows(dashboard.segment_share(dated)))
    month = F.substring("invoicedate", 1, 7)
    plain = dated.where(F.col("invoicedate").startswith("2011")).groupBy(month.alias("year_month"), "segment").agg(
        F.count(F.lit(1)).alias("customer_count"), F.sum("monetary").cast("double").alias("revenue"))
    close(rows(sections.monthly_trends(cube)), rows(plain))
    parts = sections.insights(cube, dated)
    close(rows(parts["segment_value_analysis"]), rows(insight.segment_value_analysis(dated)))
    close(rows(parts["growth_opportunities"]), rows(insight.growth_opportunities(dated)))
    close(rows(parts["main"]), rows(insight.filtered_insights(dated)))


def test_sections_read_the_table_once(spark, dated, tmp_path):
    dated.write.parquet(str(tmp_path / "t"))
    out = dashboard.dashboard(spark.read.parquet(str(tmp_path / "t")), segments=["Loyal", "New"], date_from="2011-03-01", date_to="2011-09-30")
    for name, df in out.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert ("/t]" in plan) == (name == "scatter"), name
    want = dashboard.apply_filters(dated, ["Loyal", "New"], "2011-03-01", "2011-09-30")
    close(rows(out["kpi"]), rows(dashboard.kpi_summary(want)))


def test_sections_without_rows_or_dates(dated):
    empty = dashboard.dashboard(dated.drop("invoicedate"), segments=["nobody"])
    assert tuple(empty["status"].first()) == (False, dashboard.NO_DATA)
    close(rows(empty["kpi"]), rows(dashboard.kpi_summary(dated.limit(0))))
    assert empty["revenue_by_segment"].count() == 0 and "monthly_trends" not in empty
    main = insight.filtered_sections(dated, ["nobody"])["main"].first()
    assert (main.total_customers, main.total_revenue, main.at_risk_count, main.top_revenue_segment) == (0, 0.0, 0, None)


RAW = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]


def test_stage_counts_are_observed_in_one_scan(spark, tmp_path):
    data = [(str(i % 50), "A", "x", str(i % 7 - 1), "2011-01-01 00:00:00" if i % 9 else "bad", str(i % 4), None if i % 5 == 0 else f"{i % 11}", "UK") for i in range(1000)]
    spark.createDataFrame(data, ", ".join(f"{c} string" for c in RAW)).repartition(5).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw")).withColumns({"Quantity": F.col("Quantity").cast("int"), "UnitPrice": F.col("UnitPrice").cast("decimal(12,2)")})
    step1, note = stages.run_cleaning_step1(raw, str(tmp_path))
    s = note.first()
    distinct = {tuple(d) for d in data}
    lost = [d for d in distinct if d[6] is None]
    assert (s.initial_rows, s.duplicates_removed, s.missing_customers_removed, s.final_rows) == (1000, 1000 - len(distinct), len(lost), len(distinct) - len(lost))
    assert step1.count() == s.final_rows
    tx, note = stages.run_cleaning_step2(step1, str(tmp_path))
    s = note.first()
    left = [d for d in distinct if d[6] is not None]
    bad_q = [d for d in left if int(d[3]) <= 0]
    bad_p = [d for d in left if int(d[3]) > 0 and int(d[5]) <= 0]
    bad_d = [d for d in left if int(d[3]) > 0 and int(d[5]) > 0 and d[4] == "bad"]
    assert (s.initial_rows, s.non_positive_quantity_removed, s.non_positive_unit_price_removed, s.invalid_date_removed, s.cancelled_invoice_removed) == (
        len(left), len(bad_q), len(bad_p), len(bad_d), 0)
    assert s.final_rows == tx.count() == len(left) - len(bad_q) - len(bad_p) - len(bad_d)
    assert s.dates_parsed + s.parse_errors == s.initial_rows and s.min_date == "2011-01-01T00:00:00"


def test_stage_counts_of_an_empty_upload(spark, tmp_path):
    raw = spark.createDataFrame([], ", ".join(f"{c} {'int' if c == 'Quantity' else 'decimal(12,2)' if c == 'UnitPrice' else 'string'}" for c in RAW))
    step1, note = stages.run_cleaning_step1(raw, str(tmp_path))
    assert (note.first().initial_rows, note.first().final_rows) == (0, 0)
    _, note = stages.run_cleaning_step2(step1, str(tmp_path))
    assert (note.first().initial_rows, note.first().final_rows) == (0, 0)


def test_bad_lines_and_cells_are_set_aside(spark, tmp_path):
    path = str(tmp_path / "up.csv")
    with open(path, "w") as f:
        f.write("Invoice No,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
                "1,A,x,6,2011-01-01,2.50,17,UK\n2,A,x,six,2011-01-01,2.50,17,UK\n3,A,x,6,2011-01-01,2.50\n4,A,x,6,2011-01-01,2.50,17,UK,more,more\n"
                "5,A,x,,n/a,NaN,17,UK\n6,A,x,1,not a date,two,17,UK\n")
    df = spark.read.option("header", True).csv(path)
    assert "Invoice No" in df.columns
    kept, rejects = io.read_csv_with_rejects(spark, path)
    assert sorted(r["invoice_no"] if "invoice_no" in r else r["invoiceno"] for r in (x.asDict() for x in kept.collect())) == ["1", "5"]
    found = {json.loads(r.record)["Invoice No"] if r.record.startswith("{") else r.record.split(",")[0]: set(r.reasons) for r in rejects.collect()}
    assert found["2"] == {"quantity_not_a_number"} and "malformed_line" in found["3"] and "malformed_line" in found["4"]
    assert found["6"] == {"unitprice_not_a_number", "invoicedate_not_a_date"} and len(found) == 4
    counts = {r.reason: r.records for r in io.quarantine(rejects, str(tmp_path / "q")).collect()}
    assert counts["malformed_line"] == 2 and all(r.file.endswith("up.csv") for r in rejects.collect())


def test_a_snapshot_written_twice_is_there_once(spark, tmp_path):
    root = str(tmp_path / "snap")
    one = spark.createDataFrame([(10,)], "total_rows int")
    assert io.read_latest_snapshot(spark, root, 1) is None
    for value, dataset, at in ((10, 1, "20240101T000000"), (11, 1, "20240202T000000"), (12, 1, "20240202T000000"), (7, 2, "20240303T000000")):
        io.write_snapshot(one.withColumn("total_rows", F.lit(value)), root, dataset, at)
    assert [(r.total_rows, r.dataset_id, r.snapshot_ts) for r in io.read_latest_snapshot(spark, root, 1).collect()] == [(12, 1, "20240202T000000")]
    assert spark.read.json(root).count() == 3
    latest = io.read_latest_snapshot(spark, root, 2, "total_rows int")
    assert [r.total_rows for r in latest.collect()] == [7] and io.read_latest_snapshot(spark, root, 9) is None
    assert len(latest.inputFiles()) == 1


def test_older_summaries_still_read(spark, tmp_path):
    path = os.path.join(str(tmp_path), "rfm_recency_summary")
    os.makedirs(path)
    with open(os.path.join(path, "part-0.json"), "w") as f:
        f.write(json.dumps({"reference_date": "2011-12-10T00:00:00", "unique_customers": 5, "other": {"x": [1]}}) + "\n")
    r = stages.stored_recency_preview(spark, str(tmp_path)).first()
    assert tuple(r) == ("2011-12-10T00:00:00", 5, None, None, None, None)
    assert stages.stored_recency_preview(spark, str(tmp_path / "none")) is None


def test_kmeans_seeds_come_from_all_points(spark):
    """Far groups of a few points among many equal ones, a third of all rows: each gets a centre."""
    r = np.random.default_rng(1)
    far = [(50.0, 0.0), (-50.0, 3.0), (0.0, 80.0)]
    pts = [(0.0, 0.0)] * 2000 + [tuple(x) for x in r.normal(0, 1, (4000, 2)).tolist()] + [(a + e, b + e) for a, b in far for e in (0.0, 0.5, 1.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "customerid long, x_scaled double, y_scaled double").repartition(6)
    centres, cost = cluster.fit_kmeans(df, k=4, n_init=4)
    for a, b in far:
        assert min(abs(c[0] - a) + abs(c[1] - b) for c in centres) < 2
    x = np.array(pts)
    d = ((x[:, None] - np.array(centres)[None]) ** 2).sum(2)
    assert cost == pytest.approx(d.min(1).sum(), rel=1e-6)
    for j, c in enumerate(centres):
        assert np.abs(x[d.argmin(1) == j].mean(0) - c).max() < 1e-3


def test_kmeans_of_few_points(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0)], "customerid long, x_scaled double")
    centres, cost = cluster.fit_kmeans(df, k=3, n_init=2)
    assert len(centres) == 3 and cost == 0
    with pytest.raises(ValueError):
        cluster.fit_kmeans(df.limit(0), k=2)


def test_profile_of_odd_columns(spark):
    data = [(1, 2.5, "a", None, b"\x00\xff", [1], True), (1, -0.0, "a", None, b"\x00\xfe", [1, 2], None), (None, 0.0, "", None, None, None, False), (3, None, "b", None, b"", [], True)]
    df = spark.createDataFrame(data, "`a.b` int, d double, t string, nothing string, bin binary, arr array<int>, flag boolean")
    got = {r.column_name: r for r in profile.column_profile(df).collect()}
    assert {c: (r.unique_count, r.null_count) for c, r in got.items()} == {
        "a.b": (2, 1), "d": (2, 1), "t": (3, 0), "nothing": (0, 4), "bin": (3, 1), "arr": (3, 1), "flag": (2, 1)}
    assert (got["a.b"].median, got["d"].median, got["d"].min, got["d"].max) == (1.0, 0.0, 0.0, 2.5)
    samples = {}
    for r in profile.sample_values(df, 2).collect():
        samples.setdefault(r.column_name, []).append(r.value)
    assert samples["a.b"] == ["1", "1"] and sorted(samples["t"]) == ["", "a"] and "nothing" not in samples
    empty = profile.column_profile(df.limit(0)).collect()
    assert len(empty) == 7 and all((r.unique_count, r.null_count, r.mean) == (0, 0, None) for r in empty)
    assert profile.sample_values(df.limit(0)).count() == 0

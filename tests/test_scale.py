"""Steps whose memory, shuffles or time grew faster than the input."""

import datetime as dt
from decimal import Decimal

import numpy as np

import __spark_entry__ as entry
from ledgerlens.operators import cluster, dashboard
from ledgerlens.plans import fixture as fx


def test_raw_is_written_without_a_further_shuffle(spark, sf001, monkeypatch):
    monkeypatch.setattr(fx, "staged", lambda spark, key, build: build())
    assert "RoundRobinPartitioning" not in fx.raw(spark, sf001)._jdf.queryExecution().toString()


def test_queries_scan_small_splits(spark):
    entry._prepare(spark)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m"


def test_filled_trends_aggregate_the_transactions_once(spark):
    tx = spark.createDataFrame([(str(i % 7), dt.datetime(2011, 1 + i % 3, 2), Decimal(i)) for i in range(40)],
                               "customerid string, invoicedate timestamp, total_revenue decimal(12,2)")
    seg = spark.createDataFrame([(str(i), "Loyal" if i % 2 else "New") for i in range(7)], "customerid string, segment string")
    out = dashboard.monthly_trends_filled(dashboard.monthly_trends(tx, seg))
    assert out.count() == 6
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_kmeans_pass_is_the_plain_sums(spark):
    x = np.random.default_rng(5).normal(size=(500, 2))
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "_id long, a double, b double").repartition(3)
    centres = np.random.default_rng(6).normal(size=(3, 4, 2))
    moved, cost = cluster._pass(points, centres, ["a", "b"])
    for r in range(3):
        d = ((x[:, None] - centres[r][None]) ** 2).sum(2)
        near = d.argmin(1)
        assert np.isclose(cost[r], d.min(1).sum())
        for c in range(4):
            assert np.allclose(moved[r, c], x[near == c].mean(0) if (near == c).any() else centres[r, c])
    d = ((x[:, None] - centres[0][None]) ** 2).sum(2)
    got = {row["_id"]: (row["_d"], row["_j"]) for row in cluster._nearest(points, centres[0], ["a", "b"]).collect()}
    assert all(np.isclose(got[i][0], d[i].min()) and got[i][1] == d[i].argmin() for i in range(500))

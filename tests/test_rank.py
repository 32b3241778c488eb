"""Exact partitioned rank and exact quantiles against brute force."""

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.rank import column_quantiles, exact_quantiles, exact_row_number, exact_running_sum, laid_out


def _frame(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # heavy tie: a third of all rows share value 1 (like frequency = 1)
        v = 1 if i % 3 == 0 else rnd.randint(1, 400)
        rows.append((i * 7 + 3, v, rnd.choice(["a", "b", "c"]), round(rnd.uniform(0, 1000), 2)))
    return spark.createDataFrame(rows, "id long, v long, g string, m double")


def test_partitioned_rank_equals_window(spark):
    df = _frame(spark)
    plain = df.withColumn("rn0", F.row_number().over(Window.orderBy("v", "id")))
    got = exact_row_number(plain, ["v", "id"], ranges=15)
    rows = got.select("rn", "rn0").collect()
    assert all(r.rn == r.rn0 for r in rows)
    assert sorted(r.rn for r in rows) == list(range(1, 3001))


def test_ranges_split_ties(spark):
    """Rows of one key, a third or all of them, lie in several ranges."""
    df = _frame(spark)
    for keys in (["v", "id"], ["v"]):
        sizes = [r["count"] for r in laid_out(df, keys, ranges=15).groupBy("_range").count().collect()]
        assert sum(sizes) == 3000 and len(sizes) > 10 and max(sizes) < 600
    same = df.withColumn("v", F.lit(1))
    got = exact_row_number(same, ["v"], ranges=12)
    assert sorted(r.rn for r in got.collect()) == list(range(1, 3001))
    assert max(r["count"] for r in laid_out(same, ["v"], ranges=12).groupBy("_range").count().collect()) < 900


def test_nothing_is_collected(spark):
    """Ranking sends no rows to the driver besides what Spark itself samples for its ranges."""
    from ledgerlens.operators import rank
    source = open(rank.__file__).read()
    assert ".collect(" not in source and ".first(" not in source and ".count()" not in source


def test_running_sum_with_null_groups(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "ab"[i % 2], None if i % 7 == 0 else float(i)) for i in range(400)], "id long, g string, w double")
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = df.withColumn("want", F.sum("w").over(w))
    got = exact_running_sum(plain, ["id"], ["g"], "w", "have", ranges=9).where("w is not null").collect()
    assert len(got) == df.where("w is not null").count()
    assert all(r.want == r.have for r in got)


def test_small_and_empty_inputs_take_the_same_plan(spark):
    for n in (0, 1, 2, 5):
        df = spark.range(n).select("id", (F.col("id") % 2).alias("v"))
        got = exact_row_number(df, ["v", "id"])
        assert "Exchange SinglePartition" not in got.drop("rn")._jdf.queryExecution().executedPlan().toString()
        assert [r.rn for r in got.orderBy("v", "id").collect()] == list(range(1, n + 1))


def test_grouped_partitioned_rank(spark):
    df = _frame(spark)
    plain = df.withColumn("rn0", F.row_number().over(Window.partitionBy("g").orderBy("m", "id")))
    got = exact_row_number(plain, ["m", "id"], ["g"], ranges=20)
    assert all(r.rn == r.rn0 for r in got.select("rn", "rn0").collect())


def _pandas_quantiles(values, probs):
    s = pd.Series(values, dtype=float)
    return [float(s.quantile(p, interpolation="linear")) for p in probs]


def test_exact_quantiles_global(spark):
    df = _frame(spark)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    r = exact_quantiles(df, "v", probs).first()
    vals = [row.v for row in df.select("v").collect()]
    assert np.allclose([r[f"q{int(p * 100)}"] for p in probs], _pandas_quantiles(vals, probs))


def test_exact_quantiles_grouped(spark):
    df = _frame(spark)
    got = {r.g: r.median for r in exact_quantiles(df, "m", [0.5], ["g"], ["median"]).collect()}
    pdf = df.toPandas()
    want = pdf.groupby("g")["m"].median().to_dict()
    assert set(got) == set(want)
    for k in want:
        assert abs(got[k] - want[k]) < 1e-9


def test_exact_quantiles_ignores_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert exact_quantiles(df, "v", [0.5], names=["m"]).first().m is None
    df2 = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert exact_quantiles(df2, "v", [0.5], names=["m"]).first().m == 2.0


def test_quantiles_of_columns_in_two_scans(spark, tmp_path):
    """Many values, so that sketches bound the quantiles; ties, nulls and NaN among them."""
    df = spark.range(40_000).select(
        (F.col("id") % 4).alias("g"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.rand(5) * 100).alias("a"),
        F.when(F.col("id") % 11 == 0, None).otherwise((F.rand(6) * 9).cast("int")).alias("b"),
        F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.randn(7)).alias("c"), F.lit(None).cast("double").alias("d"))
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    pdf = df.toPandas()
    plan = column_quantiles(df, ["a", "b", "c", "d"], probs)
    got = {r.column_name: r.quantiles for r in plan.collect()}
    assert got["d"] is None
    for c in "abc":
        assert np.allclose(got[c], _pandas_quantiles(pdf[c].dropna(), probs), atol=1e-12), c
    by_group = {(r.g, r.column_name): r.quantiles for r in column_quantiles(df, ["a", "c"], probs, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        for c in "ac":
            assert np.allclose(by_group[g, c], _pandas_quantiles(part[c].dropna(), probs), atol=1e-12)
    scans = re.findall(r"FileScan parquet \[[^\]]*\]", plan._jdf.queryExecution().executedPlan().toString())
    assert len(set(scans)) == 2


def test_quantile_plans_start_no_job(spark):
    df = _frame(spark)
    spark.sparkContext.setJobGroup("plan-only", "building a quantile plan")
    try:
        exact_quantiles(df, "m", [0.5], ["g"], ["median"])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

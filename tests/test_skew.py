"""A hot customer (a third of all lines) and heavy ties: results against brute force."""

import random
from decimal import Decimal

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import clean, rfm, score
from ledgerlens.sources.adapters import RAW_SCHEMA


def _lines(n=3000, seed=11):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        cust = "1" if i % 3 == 0 else str(rnd.randint(2, 400))       # customer 1 holds a third of all lines
        inv = str(rnd.randint(1, 900)) if cust != "1" else str(10_000 + i % 50)
        day = rnd.randint(1, 28)
        rows.append((inv, "S", "d", rnd.randint(1, 5), f"2011-0{rnd.randint(1, 9)}-{day:02d} 1{rnd.randint(0, 9)}:00:00",
                     Decimal(f"{rnd.randint(1, 999)}.{rnd.randint(0, 99):02d}"), cust, "UK"))
    rows += rows[:200]  # exact copies
    return rows


def test_hot_customer_rfm_matches_pandas(spark):
    rows = _lines()
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    base = rfm.rfm_base(clean.clean_transactions(raw)).toPandas()
    base = base.set_index(base["customerid"].astype(int)).sort_index()

    pdf = pd.DataFrame(rows, columns=[f.name for f in RAW_SCHEMA.fields]).drop_duplicates()
    pdf["ts"] = pd.to_datetime(pdf["invoicedate"])
    pdf["rev"] = pdf["quantity"] * pdf["unitprice"].map(lambda d: d)
    g = pdf.groupby(pdf["customerid"].astype(int)).agg(last=("ts", "max"), frequency=("invoiceno", "nunique"),
                                                       monetary=("rev", "sum"))
    ref = g["last"].max() + pd.Timedelta(days=1)
    g["recency"] = (ref - g["last"]).dt.days
    assert list(base.index) == list(g.index)
    assert (base["recency"].values == g["recency"].values).all()
    assert (base["frequency"].values == g["frequency"].values).all()
    assert all(Decimal(str(a)) == b for a, b in zip(base["monetary"], g["monetary"]))


def test_bucketed_scores_equal_window_scores_with_hot_values(spark):
    rnd = random.Random(5)
    rows = [(i, 1 if i % 3 == 0 else rnd.randint(1, 40), 1 if i % 2 == 0 else rnd.randint(1, 9),
             Decimal(f"{rnd.randint(1, 500)}.00")) for i in range(1, 2001)]
    base = spark.createDataFrame(rows, "customerid long, recency long, frequency long, monetary decimal(20,2)")
    a = score.score_rfm(base, keep_ranks=True)
    b = score.score_rfm(base, ranges=20, keep_ranks=True)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    plain = base.withColumn("rn", F.row_number().over(Window.orderBy("frequency", "customerid")))
    got = b.join(plain.select("customerid", "rn"), "customerid")
    assert got.where(F.col("frequency_rank") != F.col("rn")).count() == 0


def test_bucketed_rank_windows_are_partitioned(spark):
    base = spark.range(1, 3001).select(F.col("id").alias("customerid"), (F.col("id") % 7).alias("recency"),
                                       (F.col("id") % 3).alias("frequency"), (F.col("id") * 1.5).alias("monetary"))
    got = score.score_rfm(base, ranges=9, keep_ranks=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "row_number()" not in plan  # numbers are places in stored ranges
    assert sorted(r.frequency_rank for r in got.select("frequency_rank").collect()) == list(range(1, 3001))

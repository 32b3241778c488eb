"""Transaction inputs derived from the shared star-schema test tables.

``dirty_transactions`` turns lineitem/orders/part/customer/nation into the
raw invoice-line table the cleaning stage expects, with deterministic dirt
(cancelled invoices, returns, zero prices, bad dates, missing ids and
exact duplicate rows) so that every cleaning rule has work to do. It reads
the whole tables; its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType([
    T.StructField("invoiceno", T.StringType()),
    T.StructField("stockcode", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("invoicedate", T.StringType()),
    T.StructField("unitprice", T.DecimalType(12, 2)),
    T.StructField("customerid", T.StringType()),
    T.StructField("country", T.StringType()),
])
RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw invoice lines with injected dirt (see FIXTURES.md, fixture A).

    Duplicates are produced by ``explode`` of a one- or two-element array
    instead of a self-union, so the join tree is scanned once.
    """
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    base = (l.join(o, l.l_orderkey == o.o_orderkey)
             .join(p, l.l_partkey == p.p_partkey)
             .join(c, o.o_custkey == c.c_custkey)
             .join(F.broadcast(n), c.c_nationkey == n.n_nationkey))  # 25-row dimension

    okey, pkey = F.col("o_orderkey"), F.col("l_partkey")
    qty = F.col("l_quantity").cast("int")
    out = base.select(
        F.when(okey % 11 == 0, F.concat(F.lit("C"), okey.cast("string")))
         .otherwise(okey.cast("string")).alias("invoiceno"),
        pkey.cast("string").alias("stockcode"),
        F.col("p_name").alias("description"),
        F.when((F.col("l_returnflag") == "R") & (pkey % 7 == 0), -qty).otherwise(qty).alias("quantity"),
        F.when(okey % 53 == 0, F.lit("not-a-date"))
         .otherwise(F.col("o_orderdate").cast("string")).alias("invoicedate"),
        F.when(pkey % 41 == 0, F.lit(0).cast("decimal(12,2)"))
         .otherwise(F.col("p_retailprice").cast("decimal(12,2)")).alias("unitprice"),
        F.when(okey % 17 == 0, F.lit(None).cast("string"))
         .when(okey % 19 == 0, F.lit(""))
         .when(okey % 23 == 0, F.lit("NaN"))
         .otherwise(F.col("o_custkey").cast("string")).alias("customerid"),
        F.col("n_name").alias("country"),
        F.explode(F.when(F.col("l_orderkey") % 29 == 0, F.array(F.lit(1), F.lit(2)))
                   .otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    return out.drop("_copy")


def event_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases from the event stream as raw lines (fixture B): one unit at
    ``value`` per purchase event; timestamps keep their time of day."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return ev.select(
        F.col("event_id").cast("string").alias("invoiceno"),
        F.lit("EVENT").alias("stockcode"),
        F.col("event_type").alias("description"),
        F.lit(1).cast("int").alias("quantity"),
        F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("invoicedate"),
        F.col("value").cast("decimal(12,2)").alias("unitprice"),
        F.col("user_id").cast("string").alias("customerid"),
        F.lit(None).cast("string").alias("country"),
    )

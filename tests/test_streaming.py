"""Incremental cleaning of uploaded files with Structured Streaming."""

import os
import tempfile

from pyspark.sql import functions as F

from ledgerlens.streaming.ingest import clean_uploads

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"


def test_clean_uploads_available_now(spark):
    root = tempfile.mkdtemp(prefix="ledgerlens-stream-")
    up, out, ck = (os.path.join(root, x) for x in ("uploads", "out", "ckpt"))
    os.makedirs(up)
    with open(os.path.join(up, "a.csv"), "w") as f:
        f.write(HEADER)
        f.write("1,A,x,2,2010-12-01 08:26:00,2.55,17850,UK\n")
        f.write("1,A,x,2,2010-12-01 08:26:00,2.55,17850,UK\n")   # duplicate
        f.write("C2,A,x,1,2010-12-01 08:26:00,1.00,17850,UK\n")  # cancelled
    with open(os.path.join(up, "b.csv"), "w") as f:
        f.write(HEADER)
        f.write("3,B,y,1,2011-01-05 10:00:00,5.00,,UK\n")        # missing id
        f.write("4,B,y,3,2011-01-05 10:00:00,5.00,12000,UK\n")
    q = clean_uploads(spark, up, out, checkpoint=ck)
    q.awaitTermination(120)
    cleaned = spark.read.parquet(os.path.join(out, "cleaned"))
    got = sorted((r.dataset, r.invoiceno) for r in cleaned.collect())
    assert got == [("a.csv", "1"), ("b.csv", "4")]
    wf = spark.read.parquet(os.path.join(out, "waterfall"))
    dup = {r.dataset: r.removed for r in wf.where(F.col("rule") == "duplicates").collect()}
    assert dup == {"a.csv": 1, "b.csv": 0}
    assert wf.select("batch_id").distinct().count() == 2


def test_columns_are_found_by_name_in_each_file(spark):
    root = tempfile.mkdtemp(prefix="ledgerlens-stream-")
    up, out, ck = (os.path.join(root, x) for x in ("uploads", "out", "ckpt"))
    os.makedirs(up)
    with open(os.path.join(up, "a.csv"), "w") as f:
        f.write("CustomerID,Discount,Country,UnitPrice,InvoiceDate,Quantity,Description,StockCode,InvoiceNo\n")
        f.write("C017,0.1,UK,2.55,12/1/10 8:26,2,x,A,1\n")
    clean_uploads(spark, up, out, checkpoint=ck).awaitTermination(120)
    (row,) = spark.read.parquet(os.path.join(out, "cleaned")).collect()
    assert (row.invoiceno, row.customerid, row.discount, float(row.quantity)) == ("1", "C017", "0.1", 2.0)


def _csv(path, lines, header="InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country"):
    path.write_text("\n".join([header, *lines]) + "\n")


def test_a_line_of_two_uploads_is_counted_once(spark, tmp_path):
    from ledgerlens.streaming import ingest
    up, out = tmp_path / "up", str(tmp_path / "out")
    up.mkdir()
    line = [f"{i},A,x,{i % 5 + 1},2011-01-0{i % 9 + 1} 08:00:00,2.50,{i % 4},UK" for i in range(40)]
    _csv(up / "a.csv", line[:20] + line[:3])
    _csv(up / "b.csv", line[10:30])

    def run():
        ingest.type_uploads(spark, str(up), out).awaitTermination()
        query = ingest.dedupe_uploads(spark, out)
        query.awaitTermination()
        return query, ingest.cleaned_uploads(spark, out)

    query, first = run()
    assert first.count() == 30 and first.dropDuplicates().count() == 30
    assert any("rocksdb" in str(k).lower() for p in query.recentProgress for op in p["stateOperators"] for k in op["customMetrics"])
    # the same uploads under another name, one line with its columns in another order, and one new line
    _csv(up / "c.csv", line[:30])
    _csv(up / "d.csv", ["UK,0,2.50,2011-01-01 08:00:00,1,x,A,0", "UK,9,2.50,2011-01-01 08:00:00,1,x,A,900"],
         "Country,CustomerID,UnitPrice,InvoiceDate,Quantity,Description,StockCode,InvoiceNo")
    _, again = run()
    assert again.count() == 31 and again.where("invoiceno = '900'").count() == 1
    _, same = run()  # a restart with nothing new
    assert same.exceptAll(again).count() == 0 and same.count() == 31


def test_other_columns_tell_lines_apart(spark, tmp_path):
    from ledgerlens.streaming import ingest
    up, out = tmp_path / "up", str(tmp_path / "out")
    up.mkdir()
    header = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country,Discount"
    _csv(up / "a.csv", ["1,A,x,1,2011-01-01,2.50,7,UK,5", "1,A,x,1,2011-01-01,2.50,7,UK,6"], header)
    ingest.type_uploads(spark, str(up), out).awaitTermination()
    ingest.dedupe_uploads(spark, out).awaitTermination()
    assert sorted(r.more for r in ingest.cleaned_uploads(spark, out).collect()) == ['{"discount":"5"}', '{"discount":"6"}']

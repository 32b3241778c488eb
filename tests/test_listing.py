"""Paged listing (F8): filter, order, offset/limit, totals."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.listing import paged


def test_paged_listing(spark):
    df = spark.range(1, 46).select(F.col("id"), (F.col("id") % 2).alias("odd"))
    page = paged(df, 2, 10, [F.desc("id")]).collect()
    assert [r.id for r in page] == list(range(35, 25, -1))
    assert {(r.total, r.total_pages) for r in page} == {(45, 5)}
    odd = paged(df, 3, 10, ["id"], equals={"odd": 1}).collect()
    assert [r.id for r in odd] == [41, 43, 45] and odd[0].total == 23 and odd[0].total_pages == 3
    assert paged(df, 9, 10, ["id"]).count() == 0
    with pytest.raises(ValueError):
        paged(df, 0, 10, ["id"])

"""Paged listing (F8): filter, sort, offset/limit, with total and page count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from ledgerlens.functions.scalars import with_scalars


def paged(df: DataFrame, page: int, page_size: int, order: Sequence[str | Column],
          equals: dict | None = None) -> DataFrame:
    """Rows of page ``page`` (1-based) of ``df`` sorted by ``order``.

    A paging view: the limit is the feature. Spark plans the sort + offset +
    limit as a per-partition top-(offset+limit) followed by a merge, so no
    full sort of the input is needed. ``equals`` is an optional equality
    filter. Adds ``total`` (matching rows) and ``total_pages``.
    """
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size must be positive")
    for k, v in (equals or {}).items():
        df = df.where(F.col(k) == F.lit(v))
    rows = df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    total = df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(float(page_size))).cast("bigint").alias("total_pages"))
    return with_scalars(rows, total)  # one row

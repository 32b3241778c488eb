"""One-row aggregates: attach them to other frames, or combine them.

A grand total or a reference date is one row; attaching it as a scalar
subquery keeps the plan free of cross joins, and Catalyst merges sibling
scalar subqueries over the same input into a single aggregate. Several
one-row results are combined by stacking, not by nesting subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, one_row: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Add each column of ``one_row`` (at most one row) to every row of ``df``.
    An empty ``one_row`` gives nulls."""
    cols = list(cols or one_row.columns)
    return df.withColumns({c: one_row.select(c).scalar() for c in cols})


def one_row(*parts: DataFrame) -> DataFrame:
    """Combine one-row frames (disjoint column names) into a single row.

    The parts are stacked with ``unionByName`` (each part fills only its own
    columns) and folded with ``first(ignorenulls)``: at most one row per
    part reaches the final aggregate. Unlike nested scalar subqueries this
    composes to any depth. An empty part leaves its columns null.
    """
    if len(parts) == 1:
        return parts[0]
    cols: list[str] = []
    for p in parts:
        for c in p.columns:
            if c in cols:
                raise ValueError(f"column {c!r} appears in more than one part")
            cols.append(c)
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])

"""Column-name standardisation and required-column checks.

These work on ``df.columns`` (driver-side metadata, never data), plus a
small DataFrame form of the fuzzy check so it can be joined and queried.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The canonical transaction columns, in the reference's order.
REQUIRED_COLUMNS = [
    "InvoiceNo", "StockCode", "Description", "Quantity",
    "InvoiceDate", "UnitPrice", "CustomerID", "Country",
]
# Optional columns that are carried through untouched.
OPTIONAL_COLUMNS = [
    "ProductCategory", "ProductGroup", "Discount", "ShippingCost",
    "InvoiceMonth", "InvoiceYear",
]

_NOT_ALPHANUMERIC = re.compile(r"[\W_]+")
_SEPARATOR = re.compile(r"[ _-]")


def standardize_name(name: str) -> str:
    """Trimmed and lower-case; a run of other characters than letters and digits becomes one
    underscore if a space, dash or underscore is in it, and is left out if not."""
    return _NOT_ALPHANUMERIC.sub(lambda run: "_" if _SEPARATOR.search(run[0]) else "", name.lower().strip())


def standardize_columns(df: DataFrame) -> DataFrame:
    """Rename every column with :func:`standardize_name` (F1).

    Spark resolves names case-insensitively, so two inputs that collapse to
    the same name would become ambiguous: raise instead of guessing.
    """
    new = [standardize_name(c) for c in df.columns]
    seen: dict[str, str] = {}
    for old, nn in zip(df.columns, new):
        if nn in seen:
            raise ValueError(f"columns {seen[nn]!r} and {old!r} both standardise to {nn!r}")
        seen[nn] = old
    return df.toDF(*new)


def validate_required_strict(columns: list[str]) -> tuple[bool, str | None]:
    """Exact check after standardisation (F2): all 8 lower-case names present."""
    required = [c.lower() for c in REQUIRED_COLUMNS]
    missing = [c for c in required if c not in columns]
    if missing:
        return False, f"Missing required columns: {', '.join(missing)}"
    return True, None


def validate_required_fuzzy(columns: list[str]) -> tuple[bool, list[str], list[str]]:
    """Upload-time check (F3): case-insensitive; a required name counts as
    present when it and some column name contain one another. Returns
    (ok, missing, extra)."""
    lower = [c.lower().strip() for c in columns]
    missing = []
    for req in REQUIRED_COLUMNS:
        r = req.lower()
        if r in lower:
            continue
        if not any(r in c or c in r for c in lower):
            missing.append(req)
    required_lower = {r.lower() for r in REQUIRED_COLUMNS}
    extra = [c for c in columns if c.lower().strip() not in required_lower]
    return not missing, missing, extra


def column_check_frame(spark: SparkSession, columns: list[str]) -> DataFrame:
    """F3 as a DataFrame: one row per required name with its matched column.

    ``status`` is ``exact``, ``fuzzy`` or ``missing``. Built from a tiny
    names table (bounded by the schema width) so it can be broadcast.
    """
    req = spark.createDataFrame([(r, r.lower()) for r in REQUIRED_COLUMNS], "required string, req_l string")
    have = spark.createDataFrame([(c, c.lower().strip()) for c in columns], "column_name string, col_l string")
    cond = (F.col("req_l") == F.col("col_l")) | F.expr("instr(col_l, req_l) > 0") | F.expr("instr(req_l, col_l) > 0")
    joined = req.join(F.broadcast(have), cond, "left")
    return (joined.groupBy("required")
            .agg(F.max((F.col("req_l") == F.col("col_l")).cast("int")).alias("exact"),
                 F.min("column_name").alias("matched_column"))
            .select("required", "matched_column",
                    F.when(F.col("exact") == 1, "exact")
                     .when(F.col("matched_column").isNotNull(), "fuzzy")
                     .otherwise("missing").alias("status")))


def validation_report(columns: list[str]) -> dict:
    """Validity, the missing names as errors, the extra ones as warnings,
    and every column mapped to itself."""
    ok, missing, extra = validate_required_fuzzy(columns)
    return {"is_valid": ok, "errors": missing, "warnings": extra, "mapping": {c: c for c in columns}}

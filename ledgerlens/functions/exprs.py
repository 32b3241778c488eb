"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# Text tokens that mean "missing" when reading raw text (as pandas reads CSV).
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
               "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Date text: year first (ISO, with or without time, fraction and zone), or month/day/year.
YEAR_FIRST = r"^\s*\d{4}-\d"
SLASH_LONG = r"^\s*\d{1,2}/\d{1,2}/\d{4}"
SLASH_SHORT = r"^\s*\d{1,2}/\d{1,2}/\d{2}(\D|$)"

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_missing(c: str | Column) -> Column:
    """Map any of :data:`NULL_TOKENS` to null."""
    c = col_(c)
    return F.when(c.isin(NULL_TOKENS), F.lit(None)).otherwise(c)


def parse_timestamp(c: str | Column, formats: list[str] | None = None) -> Column:
    """Text to timestamp, in UTC where the text names a zone; other text becomes null.

    One pattern test picks the parser, so a row is parsed once: a general
    cast for year-first text (``2010-12``, ``2010-12-01T08:26:00.123Z``), or
    month/day/year with a two- or four-digit year and an optional time.
    ``formats`` replaces both: the first that parses wins.
    """
    c = col_(c)
    if formats:
        return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])
    trimmed = F.trim(c)
    return (F.when(c.rlike(YEAR_FIRST), trimmed.try_cast("timestamp"))
             .when(c.rlike(SLASH_LONG), F.try_to_timestamp(trimmed, F.lit("M/d/yyyy[ H:mm[:ss]]")))
             .when(c.rlike(SLASH_SHORT), F.try_to_timestamp(trimmed, F.lit("M/d/yy[ H:mm[:ss]]"))))


def as_timestamp(c: str | Column) -> Column:
    """Timestamp column as session-zone ``timestamp`` (input may be ``timestamp_ntz``)."""
    return col_(c).cast("timestamp")


def floor_days(later: str | Column, earlier: str | Column) -> Column:
    """Whole elapsed days, floored (negative when ``later`` is earlier)."""
    diff = F.unix_micros(as_timestamp(later)) - F.unix_micros(as_timestamp(earlier))
    return F.floor(diff / F.lit(MICROS_PER_DAY)).cast("bigint")


def pct(part: str | Column, whole: str | Column) -> Column:
    """``part * 100 / whole`` in double arithmetic; null when ``whole`` is 0."""
    return F.try_divide(col_(part).cast("double") * F.lit(100), col_(whole).cast("double"))


def money(c: str | Column) -> Column:
    """Decimal money as plain double for output (exact sums are done in decimal)."""
    return col_(c).cast("double")


def quintile_bin(rn: str | Column, n: str | Column, q: int = 5) -> Column:
    """Bin of a 1-based rank ``rn`` among ``n`` rows: ``max(1, ceil(q*(rn-1)/(n-1)))``.

    Equals ``qcut(rank, q)`` with equal-width bins over the rank range.
    Computed with integer arithmetic so bin edges are exact; ``n <= 1``
    gives null (the reference raises there).
    """
    rn, n = col_(rn).cast("bigint"), col_(n).cast("bigint")
    num = F.lit(q).cast("bigint") * (rn - 1)
    den = n - 1
    a = num + den - 1
    # (a - a % den) is an exact multiple of den, so the division is exact.
    ceil_div = ((a - a % den) / den).cast("int")
    return F.when(n > 1, F.greatest(F.lit(1), ceil_div))


def plain_number(c: str | Column, digits: int = 2) -> Column:
    """A rounded number as text, never in scientific form: trailing zeros go,
    but for the first decimal (``218673536.1``, ``100.0``)."""
    text = F.round(col_(c), digits).cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(text, r"(\.\d+?)0+$", "$1")


def iso_string(c: str | Column) -> Column:
    return F.date_format(as_timestamp(c), ISO_SECONDS)

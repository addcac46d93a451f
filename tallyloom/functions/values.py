"""Column expressions: text, amounts, dates and number formats."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character Python's str.strip() removes; all lie at or below U+3000.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$"


def named(names: Iterable[str]) -> list[Column]:
    """Columns by their exact names, which may hold dots and spaces as CSV headers do."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def strip_text(c: Column) -> Column:
    """Trim Unicode whitespace from both ends."""
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def null_if_token(c: Column, tokens: Iterable[str]) -> Column:
    """NULL where the text is exactly one of the missing-value spellings."""
    return F.when(~c.isin(*tokens), c)


def finite(c: Column) -> Column:
    """NULL for NaN and the infinities, so that no comparison or sum ever meets them."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def parse_amount(c: Column, kind: T.DataType) -> Column:
    """A DOUBLE, or NULL where the text is not a plain decimal number.

    The pattern keeps out spellings only a JVM parser accepts, such as ``3d`` and ``0x1p3``.
    """
    if isinstance(kind, T.StringType):
        return finite(F.when(c.rlike(NUMBER), c.try_cast("double")))
    return finite(c.try_cast("double"))


def parse_date(c: Column, kind: T.DataType, formats: Iterable[str]) -> Column:
    """A TIMESTAMP_NTZ by the first format that fits the whole text, else NULL."""
    if isinstance(kind, T.StringType):
        c = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])
    return c.cast("timestamp_ntz")


def month_bucket(date_parsed: Column) -> Column:
    """``YYYY-MM``, or ``NaT`` where there is no date."""
    return F.coalesce(F.date_format(date_parsed, "yyyy-MM"), F.lit("NaT"))


def fixed(c: Column, digits: int) -> Column:
    """Fixed decimals without separators, rounded half to even on the exact binary value."""
    return F.call_function("format_number", c, F.lit("0." + "0" * digits))


def thousands(c: Column) -> Column:
    """Two decimals with thousands separators, rounded as in ``fixed``."""
    return F.format_number(c, 2)


def not_blank(c: Column) -> Column:
    return F.coalesce(strip_text(c), F.lit("")) != ""

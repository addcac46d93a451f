"""Validation and cleaning of a ledger."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.config import BATCH, NULL_TOKENS, REQUIRED_COLUMNS, TEXT_COLUMNS, LedgerConfig
from tallyloom.functions.values import (
    month_bucket,
    named,
    null_if_token,
    parse_amount,
    parse_date,
    strip_text,
)
from tallyloom.operators.dates import settled

ROW_KEY = "row_index"


def require_columns(df: DataFrame) -> None:
    """Raise if a required column is absent. Looks at names only, runs no job."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"ledger is missing required columns: {missing}")


def null_tokens(df: DataFrame, besides: tuple[str, ...] = ()) -> DataFrame:
    """Turn the missing-value spellings of every text column, besides some, into NULL."""
    text = [isinstance(f.dataType, T.StringType) and f.name not in besides for f in df.schema]
    return df.select(
        *[
            null_if_token(c, NULL_TOKENS).alias(name) if is_text else c
            for name, c, is_text in zip(df.columns, named(df.columns), text)
        ]
    )


def drop_blank_rows(df: DataFrame, besides: tuple[str, ...] = (ROW_KEY,)) -> DataFrame:
    """Drop rows in which every column is NULL or NaN, besides those that are never."""
    columns = [f for f in df.schema if f.name not in besides]
    present = [
        F.nanvl(c, F.lit(None)).isNotNull() if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c.isNotNull()
        for f, c in zip(columns, named(f.name for f in columns))
    ]
    return df.where(reduce(or_, present))


def clean(df: DataFrame, cfg: LedgerConfig = BATCH) -> DataFrame:
    """Drop blank rows, trim text, parse amounts, add ``date_parsed``; keep other columns.

    Without given date formats the dates are read once, at once, to vote for one.
    """
    require_columns(df)
    cfg = settled(df, cfg)
    df = drop_blank_rows(df)
    kinds = {f.name: f.dataType for f in df.schema}
    changed = {}
    for name in TEXT_COLUMNS:
        if name in kinds:
            text = strip_text(F.col(name))
            changed[name] = text if cfg.missing_text is None else F.coalesce(text, F.lit(cfg.missing_text))
    changed["amount"] = parse_amount(F.col("amount"), kinds["amount"])
    changed["date_parsed"] = parse_date(F.col("date"), kinds["date"], cfg.date_formats)
    return df.withColumns(changed)


def with_month(df: DataFrame, cfg: LedgerConfig = BATCH) -> DataFrame:
    """Add ``month`` as ``YYYY-MM`` text, ``NaT`` where the date cannot be read."""
    if "date_parsed" in df.columns:
        parsed = F.col("date_parsed")
    else:
        parsed = parse_date(F.col("date"), df.schema["date"].dataType, settled(df, cfg).date_formats)
    return df.withColumn("month", month_bucket(parsed))

"""The date format of a ledger, by a vote of its dates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.config import BATCH, DATE_SHAPES, LedgerConfig

ISO = "yyyy-MM-dd"


def read_as(c: Column, fmt: str) -> Column:
    """The timestamp of a text of the format's shape, else NULL; other texts are never parsed."""
    return F.when(c.rlike(f"^{DATE_SHAPES[fmt]}$"), F.try_to_timestamp(c, F.lit(fmt)))


def vote_format(df: DataFrame, column: str = "date") -> str:
    """The format that reads most values of a text column; one aggregate over the column.

    Each value votes for every format that reads it, so a day above 12 settles which of day and
    month comes first, wherever it stands. Of formats that read equally many values, the one counts
    whose shape more values have, such as a 30th of February. Formats that are still equal and read
    different dates are a tie, which raises an error: name the format in ``date_formats``. A column
    that no format reads counts as ISO dates.
    """
    text = F.trim(F.col(column))
    read = {f"_{i}": read_as(text, fmt) for i, fmt in enumerate(DATE_SHAPES)}
    shaped = {fmt: f"_shape{i}" for i, fmt in enumerate(DATE_SHAPES)}
    shapes = [text.rlike(f"^{DATE_SHAPES[fmt]}$").alias(n) for fmt, n in shaped.items()]
    rows = df.select(*[r.alias(n) for n, r in read.items()], *shapes)
    # How often a format agrees with the first one of as many votes is known only for all pairs of
    # a shape; those are few.
    pairs = [(a, b) for i, a in enumerate(DATE_SHAPES) for b in list(DATE_SHAPES)[:i] if DATE_SHAPES[a] == DATE_SHAPES[b]]
    number = {fmt: f"_{i}" for i, fmt in enumerate(DATE_SHAPES)}
    differ = [F.count_if(~F.col(number[a]).eqNullSafe(F.col(number[b]))).alias(f"{number[a]}{number[b]}") for a, b in pairs]
    votes = rows.agg(*[F.count(n).alias(n) for n in read], *[F.count_if(n).alias(n) for n in shaped.values()], *differ).first()
    best = max(votes[n] for n in read)
    if not best:
        return ISO
    tied = [fmt for fmt, n in number.items() if votes[n] == best]
    tied = [fmt for fmt in tied if votes[shaped[fmt]] == max(votes[shaped[f]] for f in tied)]
    apart = [(a, b) for a, b in pairs if a in tied and b in tied and votes[f"{number[a]}{number[b]}"]]
    if apart or len({DATE_SHAPES[f] for f in tied}) > 1:
        raise ValueError(f"dates fit {' and '.join(tied)} equally well ({best} values): set date_formats")
    return tied[0]


def settled(df: DataFrame, cfg: LedgerConfig = BATCH) -> LedgerConfig:
    """The settings with the date formats of this ledger: those given, else the one its dates vote for."""
    if cfg.date_formats is not None:
        return cfg
    kinds = {f.name: f.dataType for f in df.schema}
    if not isinstance(kinds.get("date"), T.StringType):
        return replace(cfg, date_formats=(ISO,))
    return replace(cfg, date_formats=(vote_format(df),))

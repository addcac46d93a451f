"""The three anomaly rules and their explanation."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import BATCH, LedgerConfig
from tallyloom.functions.values import finite, named
from tallyloom.operators.duplicates import duplicate_columns, flag_duplicates
from tallyloom.operators.quantile import approximate_quantile, exact_quantile

REASONS = "anomaly_reasons_rule"
FLAG = "is_anomaly_rule"
# The reason texts that results must share.
NEGATIVE = "Negative amount (possible refund or data issue)"
DUPLICATE = "Possible duplicate transaction"


def high_threshold(df: DataFrame, cfg: LedgerConfig = BATCH) -> float | None:
    """The amount above which a row is unusually high; None if no row has an amount.

    Exact, unless ``quantile_error`` allows a rank error for the sake of a single pass.
    """
    if cfg.quantile_error is not None:
        return approximate_quantile(df, "amount", cfg.quantile, cfg.quantile_error)
    return exact_quantile(df, "amount", cfg.quantile)


def threshold_text(threshold: float | None) -> str | None:
    return None if threshold is None else f"{threshold:.2f}"


def is_high(threshold: float | None) -> Column:
    return finite(F.col("amount")) > F.lit(threshold).cast("double")


def is_negative() -> Column:
    return finite(F.col("amount")) < 0


def detect_anomalies(df: DataFrame, cfg: LedgerConfig = BATCH) -> DataFrame:
    """Add the rule reasons, in fixed order, and the flag to a cleaned ledger.

    The threshold is one number, so it enters the plan as a literal. The table is read for the
    threshold, for the key counts and for the result: pass a written table (see ``stage``), not
    a long chain of transformations. Threshold and key counts are computed when the plan is built.
    Reason and flag columns of an earlier run are replaced.
    """
    df = df.drop(REASONS, FLAG)
    flagged = flag_duplicates(df, duplicate_columns(df), "_duplicate")
    return judge(flagged, "_duplicate", cfg, df)


def judge(df: DataFrame, duplicate: str, cfg: LedgerConfig = BATCH, amounts: DataFrame | None = None) -> DataFrame:
    """The reasons and the flag of rows of which a column tells whether they are duplicates; it goes.

    The threshold is that of ``amounts``, a written table with the same amounts, or of ``df``.
    """
    threshold = high_threshold(df if amounts is None else amounts, cfg)
    tests = {
        f"Unusually high amount (> {threshold_text(threshold)})": is_high(threshold),
        NEGATIVE: is_negative(),
        DUPLICATE: F.col(duplicate),
    }
    reasons = F.concat_ws(", ", *[F.when(test, F.lit(text)) for text, test in tests.items()])
    # The same as reasons != "", without building the text where only the flag is asked for.
    hit = reduce(or_, [F.coalesce(test, F.lit(False)) for test in tests.values()])
    columns = [c for c in df.columns if c not in (REASONS, FLAG, duplicate)]
    return df.select(*named(columns), reasons.alias(REASONS), hit.alias(FLAG))

"""Order-independent money sums and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Four decimals cover the minor units of every ISO 4217 currency.
MONEY = "decimal(20,4)"


def money_parts(amount: Column, prefix: str = "amount") -> list[Column]:
    """Two partial sums: the decimal part, and what a decimal of that size cannot hold.

    The second is exactly zero for ordinary money, so totals do not depend on how rows are
    spread over tasks; finer or larger amounts still count in full.
    """
    exact = amount.try_cast(MONEY)
    rest = F.coalesce(amount - exact.cast("double"), amount)
    return [F.sum(exact).alias(f"{prefix}_exact"), F.sum(rest).alias(f"{prefix}_rest")]


def money_total(prefix: str = "amount") -> Column:
    """The DOUBLE total of two part columns; 0 where every amount was missing."""
    return F.coalesce(F.col(f"{prefix}_exact").cast("double"), F.lit(0.0)) + F.coalesce(
        F.col(f"{prefix}_rest"), F.lit(0.0)
    )


def resum_parts(prefix: str = "amount") -> list[Column]:
    """Roll part columns of groups up into part columns of the whole."""
    return [F.sum(f"{prefix}_{part}").alias(f"{prefix}_{part}") for part in ("exact", "rest")]


def percent_of(amount: Column, total: Column, digits: int | None) -> Column:
    """``amount / total`` in percent, 0 where the total is 0, rounded half to even."""
    percent = F.coalesce(F.try_divide(amount, total), F.lit(0.0)) * 100
    if digits is None:
        return percent
    scale = float(10**digits)
    return F.rint(percent * scale) / scale

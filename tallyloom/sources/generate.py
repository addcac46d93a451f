"""A synthetic expense ledger with known errors, for demos and acceptance tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.values import named

# The merchants, weights, amount ranges and error cases results must share with
# the tool this library stands in for.
MERCHANTS = {
    "Travel": ("Uber", "United Airlines", "Marriott Hotel", "Shell Gas Station"),
    "Meals": ("Starbucks", "McDonald's", "Chipotle", "Pizza Hut"),
    "Software": ("AWS", "OpenAI API", "GitHub", "Microsoft 365"),
    "Utilities": ("Electric Co", "Water Department", "Comcast Internet"),
    "Office": ("Staples", "Office Depot", "Amazon Business"),
    "Salary": ("Payroll - Employee",),
    "Miscellaneous": ("Walmart", "Target", "CVS Pharmacy"),
}
WEIGHTS = {
    "Travel": 0.20,
    "Meals": 0.25,
    "Software": 0.15,
    "Utilities": 0.10,
    "Office": 0.15,
    "Salary": 0.05,
    "Miscellaneous": 0.10,
}
AMOUNT_RANGES = {"Travel": (25, 400), "Software": (15, 150), "Salary": (3000, 5000)}
OTHER_RANGE = (10, 120)
PAYMENT_METHODS = ("Credit Card", "Debit Card", "Bank Transfer", "Cash")
LOCATIONS = ("New York, NY", "San Francisco, CA", "Chicago, IL", "Austin, TX", "Boston, MA")
START_DATE, DAYS, NOTE, NOTE_SHARE = "2025-01-01", 90, "Business expense", 0.3
COLUMNS = (
    "transaction_id", "date", "merchant", "description", "amount",
    "currency", "payment_method", "location", "notes",
)
ERROR_ROWS = (
    ("TXN2001", "2025-02-15", "Unknown Store", "", 75.50, "USD", "Credit Card", "New York, NY", ""),
    ("TXN2002", "15-Feb-2025", "Best Buy", "Best Buy Electronics", 199.99, "USD", "Debit Card", "Chicago, IL", "Office supplies"),
    ("TXN2003", "2025-02-20", "Suspicious Vendor LLC", "Large Equipment Purchase", 9500.0, "USD", "Bank Transfer", "Austin, TX", "Urgent purchase"),
    ("TXN2004", "2025-01-25", "Starbucks", "Starbucks Coffee", 45.67, "USD", "Credit Card", "San Francisco, CA", "Team meeting"),
    ("TXN2005", "2025-01-25", "Starbucks", "Starbucks Coffee", 45.67, "USD", "Credit Card", "San Francisco, CA", "Team meeting"),
    ("TXN2006", "2025-03-01", "Refund Processing", "Refund", -150.0, "USD", "Credit Card", "Boston, MA", "Return"),
)

DRAWS = ("category", "merchant", "amount", "date", "payment", "location", "notes")


def merchant_table(spark: SparkSession) -> DataFrame:
    """The 22 known merchants and their category label."""
    rows = [
        (merchant, "Office Supplies" if category == "Office" else category)
        for category, merchants in MERCHANTS.items()
        for merchant in merchants
    ]
    return spark.createDataFrame(rows, "merchant string, category string")


def _draw(name: str) -> Column:
    """A number in [0, 1): eight hex digits of the row's digest."""
    digits = F.substring("_digest", 1 + 8 * DRAWS.index(name), 8)
    return F.conv(digits, 16, 10).cast("double") / float(2**32)


def _pick(values: tuple[str, ...], draw: Column) -> Column:
    options = F.array(*[F.lit(v) for v in values])
    return F.element_at(options, F.floor(draw * len(values)).cast("int") + 1)


def _per_category(make) -> Column:
    """A choice by the ``_category`` column."""
    first, *others = MERCHANTS
    chosen = F.when(F.col("_category") == first, make(first))
    for category in others:
        chosen = chosen.when(F.col("_category") == category, make(category))
    return chosen


def _weighted_category(draw: Column) -> Column:
    *head, last = WEIGHTS
    reached, chosen = 0.0, F
    for category in head:
        reached = round(reached + WEIGHTS[category], 4)
        chosen = chosen.when(draw < reached, F.lit(category))
    return chosen.otherwise(F.lit(last))


def _amount(category: str) -> Column:
    low, high = AMOUNT_RANGES.get(category, OTHER_RANGE)
    cents = F.floor(_draw("amount") * ((high - low) * 100) + 0.5) + low * 100
    return cents / 100.0


def generate_rows(ids: DataFrame, seed: int = 42) -> DataFrame:
    """One ordinary expense per BIGINT ``id``, e.g. of ``spark.range(n)``.

    All draws of a row come from one digest of the seed and the id. Unlike a random stream they
    do not depend on partitioning, so a retried task makes the same rows.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = ids.select("id", digest.alias("_digest")).withColumn(
        "_category", _weighted_category(_draw("category"))
    )
    merchant = _per_category(lambda c: _pick(MERCHANTS[c], _draw("merchant")))
    day = F.date_add(F.lit(START_DATE).cast("date"), F.floor(_draw("date") * DAYS).cast("int"))
    return rows.select(
        F.concat(F.lit("TXN"), F.col("id") + 1000).alias("transaction_id"),
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        merchant.alias("merchant"),
        merchant.alias("description"),
        _per_category(_amount).alias("amount"),
        F.lit("USD").alias("currency"),
        _pick(PAYMENT_METHODS, _draw("payment")).alias("payment_method"),
        _pick(LOCATIONS, _draw("location")).alias("location"),
        F.when(_draw("notes") <= NOTE_SHARE, NOTE).otherwise("").alias("notes"),
    )


def error_rows(spark: SparkSession) -> DataFrame:
    """Six labelled cases: no description, bad date, outlier, a duplicate pair, a refund."""
    kinds = ["double" if c == "amount" else "string" for c in COLUMNS]
    return spark.createDataFrame(ERROR_ROWS, ", ".join(f"{c} {k}" for c, k in zip(COLUMNS, kinds)))


def shuffle_rows(df: DataFrame, seed: int = 42) -> DataFrame:
    """The rows in an order drawn from their content and the seed: one range-partitioned sort."""
    return df.orderBy(F.xxhash64(F.lit(seed), *named(df.columns)), *named(df.columns))


def generate_ledger(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Ordinary rows and the error cases, in shuffled order."""
    return shuffle_rows(generate_rows(ids, seed).unionByName(error_rows(ids.sparkSession)), seed)

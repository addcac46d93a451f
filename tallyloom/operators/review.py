"""Reviewer edits and the rules run again on top of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.config import BATCH, REVIEW_COLUMNS, LedgerConfig
from tallyloom.functions.values import named, parse_amount, parse_date
from tallyloom.operators.clean import ROW_KEY
from tallyloom.operators.dates import settled
from tallyloom.operators.duplicates import duplicate_columns, same_keys
from tallyloom.operators.rules import DUPLICATE, REASONS, detect_anomalies, judge
from tallyloom.sources.staging import stage


def review_view(df: DataFrame) -> DataFrame:
    """The row key and those of the eight review columns that exist."""
    return df.select(ROW_KEY, *[c for c in REVIEW_COLUMNS if c in df.columns])


def apply_edits(df: DataFrame, edits: DataFrame, cfg: LedgerConfig = BATCH) -> DataFrame:
    """Replace the edited columns in the edited rows; an edit to NULL counts.

    ``edits`` holds the row key and any columns of the ledger, each row key at most once: a
    second edit of a row raises an error. Edits of unknown rows are ignored. ``date_parsed``
    follows an edited date.
    """
    edited = [c for c in edits.columns if c != ROW_KEY]
    unknown = [c for c in edited if c not in df.columns]
    if unknown:
        raise ValueError(f"edits of columns the ledger does not have: {unknown}")
    if not edited:
        return df
    once = F.when(F.col("n") == 1, F.col("e")).otherwise(
        F.raise_error(F.concat(F.lit("row edited more than once: "), F.col(ROW_KEY)))
    )
    overlay = (
        edits.groupBy(ROW_KEY)
        .agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*named(edited))).alias("e"))
        .select(F.col(ROW_KEY).alias("_row"), once.alias("_edit"))
    )
    kinds = {f.name: f.dataType for f in df.schema}
    hit = F.col("_row").isNotNull()
    columns = dict(zip(df.columns, named(df.columns)))
    for c in edited:
        value = F.col("_edit").getField(c)
        # An edited amount is read like any other: text that is no number becomes NULL.
        new = parse_amount(value, edits.schema[c].dataType) if c == "amount" else value
        columns[c] = F.when(hit, new.cast(kinds[c])).otherwise(columns[c])
    if "date" in edited and "date_parsed" in df.columns:
        repaired = parse_date(columns["date"], kinds["date"], settled(df, cfg).date_formats)
        columns["date_parsed"] = F.when(hit, repaired).otherwise(F.col("date_parsed"))
    return df.join(overlay, df[ROW_KEY] == overlay["_row"], "left").select(
        *[value.alias(name) for name, value in columns.items()]
    )


def reanalyse(df: DataFrame, edits: DataFrame, cfg: LedgerConfig = BATCH) -> DataFrame:
    """Overlay edits and judge the result by the rules; predictions are kept.

    A ledger that the rules have judged is judged again only where edits can matter. High and
    negative amounts are tests of the row against a literal. Whether a row is a duplicate is known
    from its reasons, unless its key is the old or new key of an edited row: only the rows of such
    keys are counted again, found by a list as long as the edits. No row is shuffled by its key. A
    ledger without reasons is judged in full.
    """
    edited = stage(apply_edits(df, edits, cfg))
    keys = duplicate_columns(df)
    if REASONS not in df.columns or REASONS in edits.columns:
        return detect_anomalies(edited, cfg)
    was = F.coalesce(F.col(REASONS).contains(DUPLICATE), F.lit(False))
    if not set(keys) & set(edits.columns):
        return judge(edited.withColumn("_duplicate", was), "_duplicate", cfg)
    rows = stage(edits.select(F.col(ROW_KEY).alias("_row")).distinct())
    touched = [
        side.join(rows, F.col(ROW_KEY) == F.col("_row"), "left_semi").select(*named(keys)) for side in (df, edited)
    ]
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    touched = stage(touched[0].unionByName(touched[1]).distinct().withColumnsRenamed(names))
    again = edited.select(*named(keys)).join(touched, same_keys(names), "left_semi")
    counts = again.groupBy(*named(keys)).agg(F.count(F.lit(1)).alias("_n")).withColumnsRenamed(names)
    counts = stage(counts)
    flagged = edited.join(counts, same_keys(names), "left").select(
        *named(edited.columns), F.coalesce(F.col("_n") > 1, was).alias("_duplicate")
    )
    return judge(flagged, "_duplicate", cfg, edited)

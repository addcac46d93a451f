"""CSV ledgers in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.config import BATCH, LedgerConfig
from tallyloom.operators.clean import (
    ROW_KEY,
    clean,
    drop_blank_rows,
    null_tokens,
    require_columns,
    with_month,
)
from tallyloom.operators.dates import settled
from tallyloom.operators.review import review_view
from tallyloom.sources.records import csv_lines, csv_records, number_records, parse_records
from tallyloom.sources.staging import stage

BROKEN = "_broken_record"
PLACE = ("_file", "_split", "_id", "_is_header")


def read_ledger(spark: SparkSession, path: str, cfg: LedgerConfig = BATCH) -> DataFrame:
    """Read CSV files with a header (a file, a folder or a glob) and number the rows.

    All columns are read as text in one parse, checked, and written as a Parquet table with
    the rows that are not blank. ``row_index`` counts them from 0 in file-name and line order.
    It needs no sort: a row's place inside its input split is known when the split is parsed,
    and the counts per split, one row each, give the start of every split. Quoted fields may hold
    line breaks, read as line feeds; such files are split as well, and then the rows are
    dealt by ranges once (see ``records``).
    """
    return ledger_of_lines(spark, path, csv_lines(spark, path))


def ledger_of_lines(spark: SparkSession, path: str, lines: DataFrame) -> DataFrame:
    """``read_ledger`` of the written lines of a path."""
    rows, in_order = _parse(spark, path, lines)
    return number_records(rows, [c for c in rows.columns if c not in PLACE], ROW_KEY, in_order)


def read_clean_ledger(spark: SparkSession, path: str, cfg: LedgerConfig = BATCH) -> DataFrame:
    """``read_ledger`` and ``clean`` in one pass, with one written table."""
    rows, in_order = _parse(spark, path, csv_lines(spark, path))
    if cfg.date_formats is None:
        rows = stage(rows)  # read once more, for the vote
    cleaned = clean(rows, cfg)
    return number_records(cleaned, [c for c in cleaned.columns if c not in PLACE], ROW_KEY, in_order)


def _parse(spark: SparkSession, path: str, lines: DataFrame) -> tuple[DataFrame, bool]:
    """The checked rows that are not blank, with their place in the files; whether they are in scan order.

    The text is scanned once, and its lines are written. Only if some line leaves a quote open are
    records put together from lines, in the splits where that happens; files stay splittable.
    """
    header = spark.read.option("header", True).option("escape", '"').csv(path).schema
    require_columns(spark.createDataFrame([], header))
    if ROW_KEY in header.names:
        raise ValueError(f"the column name {ROW_KEY} is taken by the row number")
    records = csv_records(lines)
    parsed = parse_records(lines if records is None else records, header, BROKEN)
    rows = null_tokens(_refuse_long(parsed, len(header.names)).drop(BROKEN), besides=PLACE)
    return drop_blank_rows(rows, besides=PLACE), records is None


def _refuse_long(lines: DataFrame, width: int) -> DataFrame:
    """Raise on a record with too many fields; a short one is padded."""
    record = F.col(BROKEN)
    fields = F.size(F.split(F.regexp_replace(record, '"[^"]*"', ""), ",", -1))
    message = F.concat(F.lit(f"CSV record with more than {width} fields: "), record)
    too_long = record.isNotNull() & (fields > width)
    return lines.where(F.when(too_long, F.raise_error(message).cast("boolean")).otherwise(True))


def write_csv(df: DataFrame, path: str) -> None:
    """Write a folder of CSV files with header; quotes are doubled, as ``read_ledger`` expects."""
    kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**kept).csv(path)


def enriched_view(df: DataFrame, cfg: LedgerConfig = BATCH) -> DataFrame:
    """All columns but the row key, with ``month`` where the profile exports it.

    Dates are written without a time if no date format has hours.
    """
    rows = with_month(df, cfg) if cfg.export_month else df
    if "date_parsed" in df.columns and not any("h" in f.lower() for f in settled(df, cfg).date_formats):
        rows = rows.withColumn("date_parsed", F.col("date_parsed").cast("date"))
    return (rows.orderBy(ROW_KEY) if cfg.ordered_export else rows).drop(ROW_KEY)


def write_enriched(df: DataFrame, path: str, cfg: LedgerConfig = BATCH) -> None:
    write_csv(enriched_view(df, cfg), path)


def write_enriched_parquet(df: DataFrame, path: str, cfg: LedgerConfig = BATCH, replace: str = "dynamic") -> None:
    """All columns as Parquet, a folder per month.

    Writing again replaces the months that ``df`` has and leaves the others, so that writing the same
    again leaves one copy; with ``static`` it replaces everything. Rows are dealt by month, and adaptive execution splits large months and
    joins small ones, so that a month has few files whatever the number of tasks.
    """
    rows = with_month(df, cfg).hint("rebalance", "month")
    rows.write.mode("overwrite").option("partitionOverwriteMode", replace).partitionBy("month").parquet(path)


def read_enriched_parquet(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What ``write_enriched_parquet`` wrote of a table with the columns of ``like``; ``month`` is text."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema if f.name != "month")
    return spark.read.schema(f"{kinds}, month string").parquet(path)


def write_review(df: DataFrame, path: str) -> None:
    """The eight review columns, with edits as they stand."""
    write_csv(review_view(df).drop(ROW_KEY), path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as text files in order, one unless there are very many categories."""
    lines.orderBy("section", "line_no").select("line").write.mode("overwrite").text(path)

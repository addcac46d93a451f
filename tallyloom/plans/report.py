"""Totals, shares, trends, the explained anomaly list and the written reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.config import BATCH, LedgerConfig
from tallyloom.functions.money import money_parts, money_total, percent_of, resum_parts
from tallyloom.functions.values import fixed, not_blank, strip_text, thousands
from tallyloom.operators.clean import ROW_KEY, with_month
from tallyloom.operators.position import with_position
from tallyloom.operators.rules import FLAG, REASONS
from tallyloom.sources.staging import stage

# Column names and the texts of reports.
CATEGORY = "category_llm"
DASH = "—"
COUNTS = ("n", "n_amounts", "n_rule", "n_suspicious", "n_flagged")
SAMPLE_COLUMNS = ("date", "amount", "merchant", "description", REASONS, "suspicious_reason_llm")
REPORT_COLUMNS = (
    "date",
    "amount",
    "merchant",
    "description",
    "analysis_source",
    "combined_reason",
    "category_display",
    "confidence_display",
)


def _rule_flag(df: DataFrame) -> Column:
    return F.col(FLAG) if FLAG in df.columns else F.lit(False)


def _suspicious(df: DataFrame) -> Column:
    if "suspicious_llm" not in df.columns:
        return F.lit(False)
    return F.coalesce(F.col("suspicious_llm"), F.lit(False))


def preview(df: DataFrame, cfg: LedgerConfig = BATCH) -> DataFrame:
    return df.orderBy(ROW_KEY).limit(cfg.preview_rows)


# --- totals -------------------------------------------------------------------------------


def _measures(df: DataFrame) -> list[Column]:
    """What every total is made of; each can be summed up again."""
    rule, suspicious = _rule_flag(df), _suspicious(df)
    return [
        F.count(F.lit(1)).alias("n"),
        F.count("amount").alias("n_amounts"),
        F.count_if(rule).alias("n_rule"),
        F.count_if(suspicious).alias("n_suspicious"),
        F.count_if(rule | suspicious).alias("n_flagged"),
        *money_parts(F.col("amount")),
    ]


def measure_cells(df: DataFrame, cfg: LedgerConfig = BATCH) -> DataFrame:
    """One pass over the ledger to a row per month and category, the NULL category included.

    Every total, share and trend can be summed up from these cells: pass them as ``cells`` to any
    report. Partial counts and sums are combined on the map side, so a category that most rows
    share is no burden. Written, since several reports read it.
    """
    return stage(with_month(df, cfg).groupBy("month", CATEGORY).agg(*_measures(df)))


def _resummed() -> list[Column]:
    """The measures of groups rolled up into those of the whole; counts of nothing are 0."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    return [*sums, *resum_parts()]


def _by_category(df: DataFrame, measures: list[Column], cells: DataFrame | None = None) -> DataFrame:
    """A row per category, the NULL category included: from the cells, or by one pass over the ledger.

    The pass is written, since totals and categories both come from it: a filter pushed into one of
    two branches would make Spark pass over the ledger twice.
    """
    if cells is not None:
        return cells.groupBy(CATEGORY).agg(*_resummed())
    return stage(df.groupBy(CATEGORY).agg(*measures))


def _kpi_columns(measured: DataFrame) -> DataFrame:
    return measured.select(
        F.col("n").alias("total_transactions"),
        F.col("n_amounts").alias("transactions_with_amount"),
        money_total().alias("total_amount"),
        F.col("n_rule").alias("rule_anomalies"),
        F.col("n_suspicious").alias("suspicious_transactions"),
        F.col("n_flagged").alias("num_anomalies"),
    )


def _totals(groups: DataFrame) -> DataFrame:
    return _kpi_columns(groups.agg(*_resummed()))


def _category_amounts(groups: DataFrame) -> DataFrame:
    return groups.where(F.col(CATEGORY).isNotNull()).select(CATEGORY, money_total().alias("amount"))


def kpis(df: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """One row: transactions, total amount, and the rule, suspicious and combined counts."""
    return _kpi_columns(df.agg(*_measures(df))) if cells is None else _totals(cells)


def category_totals(df: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Amount per category, largest first. Rows without a category are left out."""
    if cells is None:
        groups = df.groupBy(CATEGORY).agg(*money_parts(F.col("amount")))
    else:
        groups = cells.groupBy(CATEGORY).agg(*resum_parts())
    return _category_amounts(groups).orderBy(F.desc("amount"), CATEGORY)


def category_share(df: DataFrame, cfg: LedgerConfig = BATCH, cells: DataFrame | None = None) -> DataFrame:
    """Amount and percent of the grand total per category; the total counts every row."""
    return _share(_by_category(df, money_parts(F.col("amount")), cells), cfg.percent_digits)


def _share(groups: DataFrame, digits: int | None) -> DataFrame:
    total = groups.agg(*resum_parts()).select(money_total()).scalar()
    percent = percent_of(F.col("amount"), total, digits)
    return (
        _category_amounts(groups)
        .select(CATEGORY, "amount", percent.alias("Percent"))
        .orderBy(F.desc("amount"), CATEGORY)
    )


def monthly_trend(df: DataFrame, cfg: LedgerConfig = BATCH, cells: DataFrame | None = None) -> DataFrame:
    """Amount per month and category, in key order; ``NaT`` collects rows without a date."""
    if cells is None:
        rows = with_month(df, cfg).where(F.col(CATEGORY).isNotNull())
        sums = rows.groupBy("month", CATEGORY).agg(*money_parts(F.col("amount")))
    else:
        sums = cells.where(F.col(CATEGORY).isNotNull())
    return sums.select("month", CATEGORY, money_total().alias("amount")).orderBy("month", CATEGORY)


# --- anomalies ----------------------------------------------------------------------------


def flagged_rows(df: DataFrame) -> DataFrame:
    """Rows flagged by a rule, by the classifier, or by both."""
    return df.where(F.col(FLAG) | _suspicious(df))


def explain_anomalies(df: DataFrame) -> DataFrame:
    """Flagged rows with the source of the flag, the joined reasons and display columns."""
    suspicious = _suspicious(df)
    source = (
        F.when(F.col(FLAG) & suspicious, "Rule-based + AI")
        .when(F.col(FLAG), "Rule-based only")
        .when(suspicious, "AI only")
        .otherwise("Unknown")
    )
    parts = [F.when(not_blank(F.col(REASONS)), strip_text(F.col(REASONS)))]
    if "suspicious_reason_llm" in df.columns:
        said = F.col("suspicious_reason_llm")
        parts.append(F.when(not_blank(said), F.concat(F.lit("AI: "), strip_text(said))))
    combined = F.concat_ws(" | ", *parts)
    added = {
        "analysis_source": source,
        "combined_reason": F.when(combined == "", DASH).otherwise(combined),
    }
    if CATEGORY in df.columns:
        added["category_display"] = F.when(not_blank(F.col(CATEGORY)), F.col(CATEGORY)).otherwise(DASH)
    if "confidence_llm" in df.columns:
        sure = F.col("confidence_llm")
        added["confidence_display"] = F.when(sure > 0, fixed(sure, 2)).otherwise(DASH)
    return flagged_rows(df).withColumns(added)


def anomaly_report(df: DataFrame) -> DataFrame:
    """The row key and the eight report columns, those that exist."""
    explained = explain_anomalies(df)
    return explained.select(ROW_KEY, *[c for c in REPORT_COLUMNS if c in explained.columns])


def first_anomalies(df: DataFrame, cfg: LedgerConfig = BATCH) -> DataFrame:
    """The first flagged rows in row order, as a report shows them."""
    return flagged_rows(df).orderBy(ROW_KEY).limit(cfg.sample_rows)


# --- documents ----------------------------------------------------------------------------


def summary_json(df: DataFrame, cfg: LedgerConfig = BATCH, cells: DataFrame | None = None) -> DataFrame:
    """The JSON summary as lines (section, line_no, summary): totals, categories, first anomalies.

    A line per category, so that neither a row nor a task grows with their number.
    """
    groups = _by_category(df, _measures(df), cells)

    def as_json(*columns: str) -> Column:
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("summary")

    totals = _totals(groups).select(
        F.lit("1 totals").alias("section"),
        F.lit(1).cast("bigint").alias("line_no"),
        as_json("total_transactions", "total_amount", "num_anomalies"),
    )
    categories = _numbered_categories(groups, None).select(
        F.lit("2 categories").alias("section"), "line_no", as_json(CATEGORY, "amount")
    )
    columns = [c for c in SAMPLE_COLUMNS if c in df.columns]
    anomalies = (
        first_anomalies(df, cfg)
        .withColumn("line_no", F.row_number().over(Window.orderBy(ROW_KEY)).cast("bigint"))
        .select(F.lit("3 anomalies").alias("section"), "line_no", as_json(*columns))
    )
    return totals.unionByName(categories).unionByName(anomalies)


def _numbered_categories(groups: DataFrame, digits: int | None) -> DataFrame:
    placed = with_position(_share(groups, digits), [F.desc("amount"), F.asc(CATEGORY)], "_position")
    return placed.withColumn("line_no", F.col("_position") + 1).drop("_position")


def _text_lines(one_row: DataFrame, section: str, lines: list[Column]) -> DataFrame:
    return one_row.select(F.lit(section).alias("section"), F.posexplode(F.array(*lines)).alias("line_no", "line")).select(
        "section", (F.col("line_no") + 1).cast("bigint").alias("line_no"), "line"
    )


def report_lines(df: DataFrame, cfg: LedgerConfig = BATCH, cells: DataFrame | None = None) -> DataFrame:
    """The printable report as (section, line_no, line): totals, categories, first anomalies."""
    groups = _by_category(df, _measures(df), cells)
    totals = _text_lines(
        _totals(groups),
        "1 totals",
        [
            F.concat(F.lit("Total transactions: "), F.col("total_transactions")),
            F.concat(F.lit("Total amount: "), thousands(F.col("total_amount"))),
            F.concat(F.lit("Total anomalies: "), F.col("num_anomalies")),
        ],
    )
    categories = _numbered_categories(groups, None).select(
        F.lit("2 categories").alias("section"),
        "line_no",
        F.concat(F.lit("- "), F.col(CATEGORY), F.lit(": "), thousands(F.col("amount"))).alias("line"),
    )
    anomalies = (
        first_anomalies(df, cfg)
        .withColumn("line_no", F.row_number().over(Window.orderBy(ROW_KEY)).cast("bigint"))
        .select(
            F.lit("3 anomalies").alias("section"),
            "line_no",
            F.concat_ws(
                " | ",
                F.coalesce(F.col("date").cast("string"), F.lit("nan")),
                F.coalesce(thousands(F.col("amount")), F.lit("nan")),
                F.coalesce(F.col("merchant"), F.lit("")) if "merchant" in df.columns else F.lit(""),
                F.col(REASONS),
            ).alias("line"),
        )
    )
    return totals.unionByName(categories).unionByName(anomalies)


def summary_lines(df: DataFrame, cfg: LedgerConfig = BATCH, cells: DataFrame | None = None) -> DataFrame:
    """The batch summary as (section, line_no, line), with percent per category.

    Lines on categories, rules and the classifier appear if the ledger has their columns.
    """
    with_category = CATEGORY in df.columns
    measures = _measures(df)
    groups = _by_category(df, measures, cells) if with_category else None
    totals = _totals(groups) if with_category else _kpi_columns(df.agg(*measures))
    # No total is stated when no row has an amount.
    total = F.when(
        F.col("transactions_with_amount") > 0,
        F.concat(F.lit("Total amount: "), fixed(F.col("total_amount"), 2)),
    )
    rows = F.concat(F.lit("Total transactions: "), F.col("total_transactions"))
    lines = _text_lines(totals, "1 basic", [rows, total]).where(F.col("line").isNotNull())
    if with_category:
        text = F.concat(
            F.lit("- "), F.col(CATEGORY), F.lit(": "), fixed(F.col("amount"), 2),
            F.lit(" ("), fixed(F.col("Percent"), 1), F.lit("%)"),
        )
        categories = _numbered_categories(groups, None)
        lines = lines.unionByName(
            categories.select(F.lit("2 categories").alias("section"), "line_no", text.alias("line"))
        )
    counts = []
    if FLAG in df.columns:
        counts.append(F.concat(F.lit("Rule-based anomalies flagged: "), F.col("rule_anomalies")))
    if "suspicious_llm" in df.columns:
        counts.append(F.concat(F.lit("LLM-suspicious transactions: "), F.col("suspicious_transactions")))
    return lines.unionByName(_text_lines(totals, "3 anomalies", counts)) if counts else lines

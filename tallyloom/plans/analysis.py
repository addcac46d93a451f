"""The whole run: file in, enriched files and reports out."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.config import BATCH, LedgerConfig
from tallyloom.functions.values import named
from tallyloom.operators.clean import ROW_KEY, clean
from tallyloom.operators.dates import settled
from tallyloom.operators.enrich import (
    Classifier,
    classifier_responses,
    enrich_by_lookup,
    failed_batches,
    merge_predictions,
    parse_responses,
)
from tallyloom.operators.review import apply_edits, reanalyse, review_view
from tallyloom.operators.rules import detect_anomalies
from tallyloom.plans import report
from tallyloom.sources.files import (
    read_clean_ledger,
    read_enriched_parquet,
    write_csv,
    write_enriched,
    write_enriched_parquet,
    write_report,
)
from tallyloom.sources.generate import merchant_table
from tallyloom.sources.staging import owned_staging, stage


@dataclass(frozen=True)
class Analysis:
    """A written, enriched ledger and the reports over it.

    ``failed_batches`` lists the batches that a classifier did not answer; None without one.
    ``pending`` are edits beside the ledger: the review shows them, the reports do not.
    """

    ledger: DataFrame
    cfg: LedgerConfig
    failed_batches: DataFrame | None = None
    pending: DataFrame | None = None

    @cached_property
    def cells(self) -> DataFrame:
        """The measures by month and category, counted when a report first asks for them."""
        return report.measure_cells(self.ledger, self.cfg)

    def preview(self) -> DataFrame:
        return report.preview(self.ledger, self.cfg)

    def kpis(self) -> DataFrame:
        return report.kpis(self.ledger, self.cells)

    def category_share(self) -> DataFrame:
        return report.category_share(self.ledger, self.cfg, self.cells)

    def monthly_trend(self) -> DataFrame:
        return report.monthly_trend(self.ledger, self.cfg, self.cells)

    def anomaly_report(self) -> DataFrame:
        return report.anomaly_report(self.ledger)

    def summary_json(self) -> DataFrame:
        return report.summary_json(self.ledger, self.cfg, self.cells)

    def summary_lines(self) -> DataFrame:
        return report.summary_lines(self.ledger, self.cfg, self.cells)

    def report_lines(self) -> DataFrame:
        return report.report_lines(self.ledger, self.cfg, self.cells)

    def review(self) -> DataFrame:
        """The review columns with the pending edits, and the reasons from before them."""
        return review_view(self.ledger if self.pending is None else apply_edits(self.ledger, self.pending, self.cfg))

    def propose(self, edits: DataFrame) -> Analysis:
        """The analysis with pending edits, which take the place of earlier pending ones."""
        return replace(self, pending=edits)

    def apply(self) -> Analysis:
        """The analysis after its pending edits."""
        return self if self.pending is None else self.edited(self.pending)

    def edited(self, edits: DataFrame) -> Analysis:
        """The analysis after reviewer edits: rules again, predictions kept."""
        return Analysis(stage(reanalyse(self.ledger, edits, self.cfg)), self.cfg, self.failed_batches)

    def write(self, folder: str) -> None:
        """Enriched and review CSV, the chart tables, the JSON summary and the text reports."""
        write_enriched(self.ledger, f"{folder}/enriched", self.cfg)
        write_csv(self.review().drop(ROW_KEY), f"{folder}/review")
        write_csv(self.category_share(), f"{folder}/category_share")
        write_csv(self.monthly_trend(), f"{folder}/monthly_trend")
        write_csv(self.anomaly_report(), f"{folder}/anomalies")
        write_report(self.summary_json().withColumnRenamed("summary", "line"), f"{folder}/summary_json")
        write_report(self.summary_lines(), f"{folder}/summary")
        write_report(self.report_lines(), f"{folder}/report")


def analyse(df: DataFrame, classifier: Classifier | None = None, cfg: LedgerConfig = BATCH) -> Analysis:
    """Clean, flag and enrich a ledger table that has a unique ``row_index``.

    Without a classifier, categories come from the table of known merchants. The cleaned table
    is written once, since the rules read it several times, and so is the result, since every
    report reads it.
    """
    cfg = settled(df, cfg)
    return _analyse_cleaned(stage(clean(df, cfg)), classifier, cfg, dense=False)


def _analyse_cleaned(
    cleaned: DataFrame, classifier: Classifier | None, cfg: LedgerConfig, dense: bool
) -> Analysis:
    flagged = detect_anomalies(cleaned, cfg)
    if classifier is None:
        known = F.broadcast(merchant_table(cleaned.sparkSession))  # 22 rows
        enriched = enrich_by_lookup(flagged, known, cfg)
    else:
        answers = classifier_responses(cleaned, classifier, cfg, dense)
        enriched = merge_predictions(flagged, parse_responses(answers, cfg))
        return Analysis(stage(enriched), cfg, failed_batches(answers))
    return Analysis(stage(enriched), cfg)


def run(
    spark: SparkSession,
    path: str,
    folder: str,
    classifier: Classifier | None = None,
    cfg: LedgerConfig = BATCH,
) -> Analysis:
    """Analyse CSV files and write every output to ``folder``, which must not hold the input.

    The ledger of the result is the Parquet output of the run, ``ledger``; what was staged on the way
    is removed.
    """
    with owned_staging(spark):
        ledger = read_clean_ledger(spark, path, cfg)
        made = _analyse_cleaned(ledger, classifier, settled(ledger, cfg), dense=True)
        write_enriched_parquet(made.ledger, f"{folder}/ledger", made.cfg, "static")
        failed = made.failed_batches
        if failed is not None:
            failed.write.mode("overwrite").parquet(f"{folder}/failed_batches")
            failed = spark.read.schema(failed.schema).parquet(f"{folder}/failed_batches")
        kept = read_enriched_parquet(spark, f"{folder}/ledger", made.ledger)
        analysis = Analysis(kept.select(*named(made.ledger.columns)), made.cfg, failed)
        analysis.write(folder)
    # Without the cells that were staged for the outputs, which are gone.
    return replace(analysis)

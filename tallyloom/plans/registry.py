"""The named queries: every operator over a ledger derived from the given tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.config import BATCH as PROFILE
from tallyloom.config import INTERACTIVE as INTERACTIVE_PROFILE
from tallyloom.functions.money import money_total
from tallyloom.operators import clean as cleaning
from tallyloom.operators import enrich, review, rules
from tallyloom.operators.duplicates import duplicate_columns, flag_duplicates, repeated_keys
from tallyloom.operators.position import with_position
from tallyloom.plans import report
from tallyloom.plans.analysis import Analysis
from tallyloom.sources import files, generate, records
from tallyloom.sources.staging import shared_folder, stage

COPY_OFFSET = 10_000_000
UNKNOWN_OFFSET = 500_000_000
# The dates of the derived ledger are known; see ``inferred_dates`` for a vote.
BATCH = replace(PROFILE, date_formats=("yyyy-MM-dd",))
INTERACTIVE = replace(INTERACTIVE_PROFILE, date_formats=("yyyy-MM-dd",))
RULE_COLUMNS = ("row_index", "amount", rules.REASONS, rules.FLAG)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(make: Query) -> Query:
    REGISTRY[make.__name__] = make
    return make


# --- the derived ledger -------------------------------------------------------------------


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a dirty ledger of text; every 101st row occurs twice, under another row key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, price, day = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderdate")
    copies = F.when(k % 101 == 0, F.array(F.lit(0), F.lit(COPY_OFFSET))).otherwise(F.array(F.lit(0)))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("copy", F.explode(copies))
        .select(
            (k + F.col("copy")).alias("row_index"),
            F.when(k % 89 == 0, F.date_format(day, "dd-MMM-yyyy"))
            .otherwise(F.date_format(day, "yyyy-MM-dd"))
            .alias("date"),
            F.col("c_name").alias("merchant"),
            F.when(k % 83 != 0, F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" "))).alias("description"),
            F.when(k % 79 == 0, "N/A")
            .when(k % 97 == 0, (-price).cast("string"))
            .otherwise(price.cast("string"))
            .alias("amount"),
            F.col("c_mktsegment").alias("category"),
        )
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(raw_ledger(spark, sf_dir), BATCH)


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules read the ledger several times, so the cleaned one is written first."""
    return rules.detect_anomalies(stage(cleaned(spark, sf_dir)))


def stand_in_predictions(ledger: DataFrame) -> DataFrame:
    """Predictions by key arithmetic: some rows have none, some a null category."""
    r = F.col("row_index")
    return ledger.where(r % 53 != 0).select(
        "row_index",
        F.when(r % 59 != 0, F.col("category")).alias("category_llm"),
        (r % 37 == 0).alias("suspicious_llm"),
        F.when(r % 37 == 0, "Unusual pattern").otherwise("Looks normal").alias("suspicious_reason_llm"),
        ((r % 100) / 100.0).cast("double").alias("confidence_llm"),
    )


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = stage(cleaned(spark, sf_dir))
    return enrich.merge_predictions(ledger, stand_in_predictions(ledger))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = stage(cleaned(spark, sf_dir))
    flagged = rules.detect_anomalies(ledger)
    return enrich.merge_predictions(flagged, stand_in_predictions(ledger))


# --- cleaning -----------------------------------------------------------------------------


@query
def clean_ledger(spark, sf_dir):
    return cleaned(spark, sf_dir).withColumn("date_parsed", F.col("date_parsed").cast("date"))


@query
def null_tokens(spark, sf_dir):
    return cleaning.null_tokens(raw_ledger(spark, sf_dir).drop("date"))


@query
def drop_blank_rows(spark, sf_dir):
    raw = raw_ledger(spark, sf_dir)
    kept = F.col("row_index") % 71 != 0
    blanked = raw.select("row_index", *[F.when(kept, F.col(c)).alias(c) for c in raw.columns[1:]])
    return cleaning.drop_blank_rows(blanked).select("row_index", "merchant", "category")


@query
def date_parse_failures(spark, sf_dir):
    failed = cleaned(spark, sf_dir).where(F.col("date_parsed").isNull())
    return failed.select("row_index", "date")


@query
def second_date_format(spark, sf_dir):
    cfg = replace(BATCH, date_formats=("yyyy-MM-dd", "dd-MMM-yyyy"))
    parsed = cleaning.clean(raw_ledger(spark, sf_dir), cfg)
    return parsed.select("row_index", F.col("date_parsed").cast("date").alias("date_parsed"))


@query
def inferred_dates(spark, sf_dir):
    """Month first, as only the days above 12 tell; ISO dates in between are outvoted."""
    day = F.to_timestamp(F.substring("date_text", 1, 10), "yyyy-MM-dd")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, text = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = orders.select(k.alias("row_index"), text.alias("date_text"), F.lit("1").alias("amount"), F.lit("x").alias("description"))
    american = F.when(F.col("row_index") % 7 == 0, F.col("date_text")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    parsed = cleaning.clean(raw.withColumn("date", american), PROFILE)
    return parsed.select("row_index", F.col("date_parsed").cast("date").alias("date_parsed"))


# --- rules --------------------------------------------------------------------------------


@query
def quantile_threshold(spark, sf_dir):
    ledger = stage(cleaned(spark, sf_dir).select("amount"))
    threshold = rules.high_threshold(ledger)
    return ledger.agg(F.count("amount").alias("n_amounts")).select(
        "n_amounts",
        F.lit(threshold).cast("double").alias("high_thresh"),
        F.lit(rules.threshold_text(threshold)).alias("threshold_text"),
    )


@query
def approx_threshold(spark, sf_dir):
    """The threshold by a sketch, and whether its rank is as near as stated: one row in 1000."""
    ledger, error = stage(cleaned(spark, sf_dir).select("amount")), 0.001
    threshold = rules.high_threshold(ledger, replace(BATCH, quantile_error=error))
    amount, n = F.col("amount"), F.count("amount")
    off = F.greatest(F.count_if(amount < threshold) - n * BATCH.quantile, n * BATCH.quantile - F.count_if(amount <= threshold), F.lit(0.0))
    # A rank between two rows counts as either.
    return ledger.agg(n.alias("n_amounts"), (off <= n * error + 1).alias("rank_holds"))


@query
def threshold_attached(spark, sf_dir):
    ledger = stage(cleaned(spark, sf_dir).select("row_index", "amount"))
    threshold = rules.high_threshold(ledger)
    return ledger.select(
        "row_index",
        "amount",
        F.lit(threshold).cast("double").alias("high_thresh"),
        F.coalesce(rules.is_high(threshold), F.lit(False)).alias("is_high"),
    )


@query
def high_amounts(spark, sf_dir):
    ledger = stage(cleaned(spark, sf_dir).select("row_index", "amount"))
    return ledger.where(rules.is_high(rules.high_threshold(ledger)))


@query
def negative_amounts(spark, sf_dir):
    return cleaned(spark, sf_dir).where(rules.is_negative()).select("row_index", "amount")


@query
def duplicate_keys(spark, sf_dir):
    ledger = stage(cleaned(spark, sf_dir))
    return repeated_keys(ledger, duplicate_columns(ledger))


@query
def duplicate_rows(spark, sf_dir):
    ledger = stage(cleaned(spark, sf_dir))
    marked = flag_duplicates(ledger, duplicate_columns(ledger), "is_duplicate")
    return marked.where("is_duplicate").select("row_index", "date", "amount", "merchant")


@query
def hot_duplicate_rows(spark, sf_dir):
    """A short key that a third of the rows may share: hashes are counted first, then the keys."""
    ledger = stage(cleaned(spark, sf_dir).select("row_index", "date_parsed", "description"))
    marked = flag_duplicates(ledger, ["date_parsed", "description"], "is_duplicate")
    return marked.select("row_index", "is_duplicate")


@query
def rule_anomalies(spark, sf_dir):
    return ruled(spark, sf_dir).select(*RULE_COLUMNS)


@query
def rule_anomaly_counts(spark, sf_dir):
    return ruled(spark, sf_dir).groupBy(rules.REASONS).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(rules.FLAG).alias("n_flagged")
    )


# --- aggregates ---------------------------------------------------------------------------


@query
def kpi_totals(spark, sf_dir):
    return report.kpis(enriched(spark, sf_dir))


@query
def measure_cells(spark, sf_dir):
    """What every total is summed up from: a row per month and category."""
    cells = report.measure_cells(enriched(spark, sf_dir), BATCH)
    return cells.select("month", report.CATEGORY, *report.COUNTS, money_total().alias("amount"))


@query
def totals_of_cells(spark, sf_dir):
    """The totals, of the cells instead of the ledger."""
    ledger = enriched(spark, sf_dir)
    return report.kpis(ledger, report.measure_cells(ledger, BATCH))


@query
def category_totals(spark, sf_dir):
    return report.category_totals(merged(spark, sf_dir))


@query
def category_share(spark, sf_dir):
    return report.category_share(merged(spark, sf_dir), INTERACTIVE)


@query
def monthly_trend(spark, sf_dir):
    return report.monthly_trend(merged(spark, sf_dir), BATCH)


# --- enrichment ---------------------------------------------------------------------------


@query
def merchant_lookup(spark, sf_dir):
    """Categories by merchant; every seventh merchant is not in the table."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_custkey") % 7 != 0)
    merchants = customer.select(F.col("c_name").alias("merchant"), F.col("c_mktsegment").alias("category"))
    ledger = cleaned(spark, sf_dir).select("row_index", "merchant")
    return enrich.lookup_categories(ledger, merchants)


@query
def strict_labels(spark, sf_dir):
    """Names outside the label set become ``Other``."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    label = F.when(F.col("c_custkey") % 3 == 0, "Travel").otherwise(F.col("c_mktsegment"))
    merchants = customer.select(F.col("c_name").alias("merchant"), label.alias("category"))
    ledger = cleaned(spark, sf_dir).select("row_index", "merchant")
    return enrich.lookup_categories(ledger, merchants, cfg=replace(BATCH, strict_labels=True))


@query
def batch_assignment(spark, sf_dir):
    return enrich.assign_batches(stage(cleaned(spark, sf_dir).select("row_index")))


@query
def interactive_batches(spark, sf_dir):
    """Batches of the interactive profile: smaller, of all rows."""
    return enrich.assign_batches(stage(cleaned(spark, sf_dir).select("row_index")), INTERACTIVE)


@query
def sparse_key_batches(spark, sf_dir):
    """Batches by keys spread over all of BIGINT."""
    far = (F.col("row_index") * 7_919 + 13) * F.when(F.col("row_index") % 2 == 0, 1).otherwise(-1)
    return enrich.assign_batches(cleaned(spark, sf_dir).select(far.alias("row_index")))


@query
def batch_payloads(spark, sf_dir):
    """The payload JSON, read back into rows."""
    record = (
        "array<struct<row_index bigint, date string, amount double, merchant string, "
        "description string, currency string>>"
    )
    return (
        enrich.batch_payloads(stage(cleaned(spark, sf_dir)))
        .select("batch_id", "first_row", "last_row", F.explode(F.from_json("payload", record)).alias("r"))
        .select("batch_id", "first_row", "last_row", "r.*")
    )


def answers_by_arithmetic(ledger: DataFrame) -> DataFrame:
    """Answer texts with the irregularities a model produces, by key arithmetic."""
    r = F.col("row_index")
    head = F.concat(F.lit('{"row_index": '), r)
    full = F.lit(', "category": "Meals", "suspicious": true, "suspicious_reason": "Odd", "confidence": 0.75}')
    item = (
        F.when(r % 7 == 0, F.concat(head, full))
        .when(r % 7 == 1, F.concat(head, F.lit("}")))
        .when(r % 7 == 2, F.concat(head, F.lit(', "category": null, "suspicious": null, "confidence": null}')))
        .when(r % 7 == 3, F.concat(F.lit('{"row_index": "'), r, F.lit('", "category": "Travel", "confidence": "0.5"}')))
        .when(r % 7 == 4, F.concat(head, F.lit(', "category": "Salary", "suspicious": "false"}')))
        .when(r % 7 == 5, F.concat(head, F.lit(', "category": "First"}, '), head, F.lit(', "category": "Second"}')))
        .otherwise(F.concat(F.lit('{"row_index": '), r + UNKNOWN_OFFSET, full))
    )
    items = F.transform(F.sort_array(F.collect_list(F.struct("row_index", item.alias("text")))), lambda x: x["text"])
    answer = F.concat(F.lit('{"results": ['), F.array_join(items, ", "), F.lit("]}"))
    return (
        enrich.assign_batches(ledger)
        .groupBy("batch_id")
        .agg(
            F.min("row_index").alias("first_row"),
            F.max("row_index").alias("last_row"),
            F.when(F.col("batch_id") % 13 == 0, "Sorry, no answer").otherwise(answer).alias("response"),
        )
    )


@query
def parse_responses(spark, sf_dir):
    answers = answers_by_arithmetic(stage(cleaned(spark, sf_dir).select("row_index")))
    return enrich.parse_responses(answers, replace(BATCH, on_classifier_error="skip"))


@query
def merged_predictions(spark, sf_dir):
    return merged(spark, sf_dir).select("row_index", *enrich.PREDICTION)


def priority_classifier() -> enrich.Classifier:
    """A deterministic stand-in for a model: the category follows the order priority.

    An inner function travels to the workers by value, so they need not have this package.
    """
    labels = {"1": "Travel", "2": "Software", "3": "Meals", "4": "Utilities", "5": "Miscellaneous"}

    def answer(payload: str) -> str:
        results = []
        for row in json.loads(payload):
            unsure = row["amount"] is None
            result = {
                "row_index": row["row_index"],
                "suspicious": unsure,
                "suspicious_reason": "No amount" if unsure else "Looks normal",
                "confidence": row["row_index"] % 100 / 100,
            }
            if row["description"][0] in labels:
                result["category"] = labels[row["description"][0]]
            results.append(result)
        return json.dumps({"results": results})

    return answer


@query
def classified_rows(spark, sf_dir):
    ledger = stage(cleaned(spark, sf_dir))
    return enrich.classifier_predictions(ledger, priority_classifier())


@query
def logged_answers(spark, sf_dir):
    """Two thirds of the batches are logged, then all are asked for, then a classifier that fails
    on every call takes all answers from the log."""
    cfg, answer = replace(BATCH, answer_log=exported(spark)), priority_classifier()

    def refuse(payload: str) -> str:
        raise ValueError("asked for a batch that the log holds")

    ledger = stage(cleaned(spark, sf_dir))
    batches = enrich.batch_payloads(ledger, cfg)
    enrich.logged_responses(batches.where(F.col("batch_id") % 3 != 0), answer, cfg.answer_log, cfg)
    enrich.logged_responses(batches, answer, cfg.answer_log, cfg)
    return enrich.classifier_predictions(ledger, refuse, cfg)


@query
def failed_batches(spark, sf_dir):
    """Every batch whose first row is a multiple of 13 fails each time it is tried."""

    def classifier(payload: str) -> str:
        if json.loads(payload)[0]["row_index"] % 13 == 0:
            raise TimeoutError("no answer")
        return '{"results": []}'

    ledger = stage(cleaned(spark, sf_dir))
    answers = enrich.classifier_responses(ledger, classifier, replace(BATCH, on_classifier_error="skip"))
    return enrich.failed_batches(answers)


# --- anomaly report -----------------------------------------------------------------------


@query
def flagged_rows(spark, sf_dir):
    return report.flagged_rows(enriched(spark, sf_dir)).select("row_index", "amount", "category_llm")


@query
def anomaly_sources(spark, sf_dir):
    explained = report.explain_anomalies(enriched(spark, sf_dir))
    return explained.groupBy("analysis_source").agg(F.count(F.lit(1)).alias("n"))


@query
def combined_reasons(spark, sf_dir):
    return report.explain_anomalies(enriched(spark, sf_dir)).select("row_index", "combined_reason")


@query
def anomaly_display(spark, sf_dir):
    return report.anomaly_report(enriched(spark, sf_dir))


@query
def first_ten_anomalies(spark, sf_dir):
    first = report.first_anomalies(enriched(spark, sf_dir))
    return first.select("row_index", "date", "amount", "merchant", rules.REASONS)


@query
def suspicious_counts(spark, sf_dir):
    return merged(spark, sf_dir).agg(F.count_if("suspicious_llm").alias("n_suspicious"))


@query
def preview_rows(spark, sf_dir):
    return report.preview(cleaned(spark, sf_dir), INTERACTIVE).select("row_index", "date", "merchant", "amount")


# --- review -------------------------------------------------------------------------------


def edits_by_arithmetic(ledger: DataFrame) -> DataFrame:
    """Edits of every 41st row: amounts tripled or removed, dates and categories set; some are
    of rows that do not exist."""
    r = F.col("row_index")
    unknown = F.when(r % 4100 == 0, F.array(F.lit(0), F.lit(UNKNOWN_OFFSET))).otherwise(F.array(F.lit(0)))
    return (
        ledger.where(r % 41 == 0)
        .withColumn("copy", F.explode(unknown))
        .select(
            (r + F.col("copy")).alias("row_index"),
            F.when(r % 5 == 0, "1997-01-15").otherwise(F.col("date")).alias("date"),
            F.when(r % 3 == 0, F.col("amount") * 3).when(r % 3 == 2, F.col("amount")).alias("amount"),
            F.when(r % 2 == 0, "Edited").otherwise(F.col("category_llm")).alias("category_llm"),
        )
    )


@query
def edit_overlay(spark, sf_dir):
    ledger = stage(merged(spark, sf_dir))
    edited = review.apply_edits(ledger, edits_by_arithmetic(ledger), BATCH)
    return edited.select(
        "row_index", "date", "amount", "category_llm", "merchant",
        F.col("date_parsed").cast("date").alias("date_parsed"),
    )


@query
def reanalysed_ledger(spark, sf_dir):
    ledger = stage(enriched(spark, sf_dir))
    again = review.reanalyse(ledger, edits_by_arithmetic(ledger), BATCH)
    return again.select(*RULE_COLUMNS, "category_llm", "suspicious_llm")


@query
def review_view(spark, sf_dir):
    return review.review_view(enriched(spark, sf_dir))


# --- documents, sources and sinks ---------------------------------------------------------


@query
def summary_json(spark, sf_dir):
    """The JSON lines, read back into columns."""
    shape = (
        "total_transactions bigint, total_amount double, num_anomalies bigint, category_llm string, amount double, "
        "date string, merchant string, description string, anomaly_reasons_rule string, suspicious_reason_llm string"
    )
    lines = report.summary_json(stage(enriched(spark, sf_dir)))
    return lines.select("section", "line_no", F.from_json("summary", shape).alias("s")).select("section", "line_no", "s.*")


@query
def report_lines(spark, sf_dir):
    return report.report_lines(stage(enriched(spark, sf_dir)))


@query
def summary_lines(spark, sf_dir):
    return report.summary_lines(stage(enriched(spark, sf_dir)))


@query
def generated_ledger(spark, sf_dir):
    """One generated expense per order, and the error cases."""
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return generate.generate_ledger(ids)


@query
def shuffled_order(spark, sf_dir):
    """Every row has one place after the shuffle, far from its old one and the same each time."""
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))

    def places(rows: DataFrame, out: str) -> DataFrame:
        path = exported(spark)
        generate.shuffle_rows(rows).write.parquet(path)
        line = F.struct("_metadata.file_name", "_metadata.row_index").alias("line")
        return with_position(spark.read.parquet(path).select("id", line), "line", out).select("id", out)

    both = places(ids, "place").join(places(ids.repartition(7), "again"), "id")
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("place").alias("n_places"),
        F.max("place").alias("last_place"),
        (F.abs(F.corr("id", "place")) < 0.1).alias("mixed"),
        F.count_if(F.col("place") == F.col("again")).alias("n_same_again"),
    )


@query
def generated_category_share(spark, sf_dir):
    """Generated expenses, cleaned and put in categories by the table of known merchants."""
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    ledger = cleaning.clean(generate.generate_rows(ids).unionByName(generate.error_rows(spark)), BATCH)
    known = F.broadcast(generate.merchant_table(spark))  # 22 rows
    return report.category_share(enrich.enrich_by_lookup(ledger, known), INTERACTIVE)


def exported(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/export-{uuid.uuid4().hex}"


def ledger_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = exported(spark)
    files.write_csv(raw_ledger(spark, sf_dir).withColumnRenamed("row_index", "transaction_id"), path)
    return files.read_ledger(spark, path)


@query
def csv_round_trip(spark, sf_dir):
    ledger = cleaning.clean(ledger_from_csv(spark, sf_dir), BATCH).drop("row_index")
    return ledger.withColumn("date_parsed", F.col("date_parsed").cast("date"))


@query
def quoted_csv_round_trip(spark, sf_dir):
    """Every third description goes on over lines, with quotes and commas, in splits of 16 kB."""
    ledger = raw_ledger(spark, sf_dir).withColumnRenamed("row_index", "transaction_id")
    broken = F.concat(F.lit('one, "two"\n\n",\n'), F.col("description"), F.lit('\n"'))
    path = exported(spark)
    files.write_csv(ledger.withColumn("description", F.when(F.col("transaction_id") % 3 == 0, broken).otherwise(F.col("description"))), path)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        lines = records.csv_lines(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    return files.ledger_of_lines(spark, path, lines).drop("row_index", "date", "merchant")


@query
def numbered_rows(spark, sf_dir):
    r = F.col("row_index")
    return ledger_from_csv(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(r).alias("first_row"),
        F.max(r).alias("last_row"),
        F.count_distinct(r).alias("n_distinct"),
    )


@query
def file_order(spark, sf_dir):
    """Rows are numbered in the order of the files and of the lines in them."""
    path = exported(spark)
    files.write_csv(raw_ledger(spark, sf_dir).withColumnRenamed("row_index", "transaction_id").orderBy("transaction_id"), path)
    return files.read_ledger(spark, path).select("row_index", F.col("transaction_id").cast("bigint").alias("transaction_id"))


@query
def enriched_export(spark, sf_dir):
    path = exported(spark)
    files.write_enriched(enriched(spark, sf_dir), path, INTERACTIVE)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(
        "date", "merchant", "description", "category", F.col("amount").cast("double").alias("amount"),
        F.col("date_parsed").cast("date").alias("date_parsed"), rules.REASONS, F.col(rules.FLAG).cast("boolean").alias(rules.FLAG),
        F.coalesce("category_llm", F.lit("")).alias("category_llm"), F.col("suspicious_llm").cast("boolean").alias("suspicious_llm"),
        "suspicious_reason_llm", F.col("confidence_llm").cast("double").alias("confidence_llm"), "month",
    )


@query
def review_export(spark, sf_dir):
    path = exported(spark)
    files.write_review(enriched(spark, sf_dir), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(
        F.coalesce(rules.REASONS, F.lit("")).alias(rules.REASONS),
        "date",
        F.col("amount").cast("double").alias("amount"),
        "merchant",
        "description",
        F.coalesce("category_llm", F.lit("")).alias("category_llm"),
        F.col("suspicious_llm").cast("boolean").alias("suspicious_llm"),
        F.col("confidence_llm").cast("double").alias("confidence_llm"),
    )


@query
def parquet_export(spark, sf_dir):
    """Written twice, the second time a part of the months: one copy of each row is left."""
    path, ledger = exported(spark), stage(enriched(spark, sf_dir))
    files.write_enriched_parquet(ledger, path, BATCH)
    files.write_enriched_parquet(ledger.where(F.month("date_parsed") < 4), path, BATCH)
    back = files.read_enriched_parquet(spark, path, ledger)
    return back.withColumn("date_parsed", F.col("date_parsed").cast("date"))


@query
def pending_review_export(spark, sf_dir):
    """Edits that are not applied yet: the edited cells beside the reasons from before."""
    path, ledger = exported(spark), stage(enriched(spark, sf_dir))
    pending = Analysis(ledger, BATCH).propose(edits_by_arithmetic(ledger))
    files.write_csv(pending.review(), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(
        F.col("row_index").cast("bigint").alias("row_index"),
        "date",
        F.col("amount").cast("double").alias("amount"),
        "merchant",
        "description",
        F.coalesce("category_llm", F.lit("")).alias("category_llm"),
        F.coalesce(rules.REASONS, F.lit("")).alias(rules.REASONS),
        F.col("suspicious_llm").cast("boolean").alias("suspicious_llm"),
        F.col("confidence_llm").cast("double").alias("confidence_llm"),
    )


@query
def optional_columns_absent(spark, sf_dir):
    """A ledger of the required columns only: keys are shorter, every category is ``Other``."""
    ledger = stage(cleaning.clean(raw_ledger(spark, sf_dir).drop("merchant", "category"), BATCH))
    found = enrich.enrich_by_lookup(rules.detect_anomalies(ledger, BATCH), generate.merchant_table(spark), BATCH)
    return report.anomaly_report(found).drop("analysis_source", "confidence_display")


@query
def report_export(spark, sf_dir):
    path = exported(spark)
    files.write_report(report.report_lines(stage(enriched(spark, sf_dir))), path)
    return spark.read.text(path).withColumnRenamed("value", "line")

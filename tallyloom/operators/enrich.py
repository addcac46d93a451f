"""Batches for a classifier, its answers, and their merge into the ledger."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.config import BATCH, LedgerConfig
from tallyloom.functions.values import finite, named
from tallyloom.operators.clean import ROW_KEY
from tallyloom.operators.position import with_position
from tallyloom.sources.staging import stage

# A classifier takes the JSON text of one batch and returns the JSON text of its answer:
# {"results": [{"row_index", "category", "suspicious", "suspicious_reason", "confidence"}]}.
Classifier = Callable[[str], str]

PREDICTION = ("category_llm", "suspicious_llm", "suspicious_reason_llm", "confidence_llm")
PAYLOAD_TEXT = ("date", "merchant", "description", "currency")
# Answers are read as text; these spellings of "suspicious" mean no, as does a missing value.
FALSE_TEXTS = ("", "false", "0", "0.0", "no", "none", "null", "[]", "{}")
LOGGED = "payload_hash string, response string"
# Characters of answers that a task holds before it passes them on.
HELD_ANSWERS = 1 << 20


def assign_batches(df: DataFrame, cfg: LedgerConfig = BATCH, dense: bool = False) -> DataFrame:
    """Add ``batch_id``: consecutive rows in key order, ``batch_size`` each.

    ``dense`` states that the row keys are 0 to n - 1, as ``read_ledger`` makes them: the batch is
    then a division and no row moves.
    """
    if dense:
        return df.withColumn("batch_id", F.expr(f"{ROW_KEY} div {int(cfg.batch_size)}"))
    numbered = with_position(df, ROW_KEY, "_position")
    return numbered.withColumn("batch_id", F.expr(f"_position div {int(cfg.batch_size)}")).drop("_position")


def batch_payloads(df: DataFrame, cfg: LedgerConfig = BATCH, dense: bool = False) -> DataFrame:
    """One row per batch: its key range and the JSON list of its records.

    A group has ``batch_size`` rows. Absent columns are sent as empty text, missing values as
    the configured text, a missing amount as null.
    """
    wanted = [c for c in (ROW_KEY, "amount", *PAYLOAD_TEXT) if c in df.columns]
    missing = F.lit(cfg.missing_text or "")

    def text(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("string"), missing) if name in wanted else F.lit("")
        return value.alias(name)

    record = F.struct(
        ROW_KEY,
        text("date"),
        F.col("amount").cast("double").alias("amount"),
        text("merchant"),
        text("description"),
        text("currency"),
    )
    return (
        assign_batches(df.select(*wanted), cfg, dense)
        .groupBy("batch_id")
        .agg(F.sort_array(F.collect_list(record)).alias("records"))
        .select(
            "batch_id",
            F.col("records")[0][ROW_KEY].alias("first_row"),
            F.element_at("records", -1)[ROW_KEY].alias("last_row"),
            F.to_json("records", {"ignoreNullFields": "false"}).alias("payload"),
        )
    )


def classify(payloads: DataFrame, classifier: Classifier, cfg: LedgerConfig = BATCH) -> DataFrame:
    """Call the classifier for each batch and keep its answer text as ``response``.

    A failed call is tried again, up to ``classifier_tries`` calls in all, after waits that grow by
    ``classifier_wait`` seconds each. What a batch failed with stays in ``error``, or ends the job,
    by profile. ``classifier_tasks`` bounds how many calls run at a time. A task that is retried
    calls again, so write the result (see ``stage``) before reading it more than once. Other columns
    pass through. A task takes one payload at a time and passes its answers on when they are about
    a megabyte.
    """
    skip, tries, wait = cfg.on_classifier_error == "skip", cfg.classifier_tries, cfg.classifier_wait
    room = HELD_ANSWERS

    def ask(payload: str) -> tuple[str | None, str | None]:
        for call in range(1, tries + 1):
            try:
                return classifier(payload), None
            except Exception as error:
                if call < tries:
                    time.sleep(wait * call)
                elif skip:
                    return None, f"{type(error).__name__}: {error}"
                else:
                    raise

    def answer(batches):
        for batch in batches:
            first, held, answers = 0, 0, []
            for last, payload in enumerate(batch.columns[-1], 1):
                answers.append(ask(payload.as_py()))
                held += sum(len(text) for text in answers[-1] if text)
                if held >= room or last == len(batch):
                    texts = [pa.array(column, pa.string(), from_pandas=True) for column in zip(*answers)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(answers)).columns[:-1], *texts], names)
                    first, held, answers = last, 0, []

    if cfg.classifier_tasks:
        payloads = payloads.repartition(cfg.classifier_tasks, "batch_id")
    others = [c for c in payloads.columns if c != "payload"]
    schema = T.StructType([payloads.schema[c] for c in others]).add("response", "string").add("error", "string")
    names = schema.names
    return payloads.select(*others, "payload").mapInArrow(answer, schema)


def logged_responses(payloads: DataFrame, classifier: Classifier, log: str, cfg: LedgerConfig = BATCH) -> DataFrame:
    """The answers of all batches, of which only those that ``log`` does not hold are asked for.

    The log is a folder of answer texts by the SHA-256 of the payload, so a batch is asked for again
    when any of its records has changed. Each run adds a folder of its own, which runs at the same
    time do not touch; where two have answered the same payload the smaller text counts, for all
    later runs alike. Failed batches are not logged. A job that ends with an error logs nothing.
    """
    spark = payloads.sparkSession
    asked = stage(payloads.withColumn("payload_hash", F.sha2("payload", 256)))
    spark.createDataFrame([], LOGGED).write.mode("ignore").parquet(log)
    known = spark.read.schema(LOGGED).parquet(log).groupBy("payload_hash").agg(F.min("response").alias("response"))
    # Written before the log grows: a later read of the log would answer fresh batches twice.
    old = stage(asked.drop("payload").join(known, "payload_hash").withColumn("error", F.lit(None).cast("string")))
    fresh = stage(classify(asked.join(old, "payload_hash", "left_anti"), classifier, cfg))
    answered = fresh.where(F.col("response").isNotNull()).select("payload_hash", "response")
    answered.write.parquet(f"{log}/run={uuid.uuid4().hex}")
    return old.unionByName(fresh).drop("payload_hash")


def parse_responses(responses: DataFrame, cfg: LedgerConfig = BATCH) -> DataFrame:
    """One prediction per row key from the answers; the last result for a key wins.

    Values are read as text, so ``"0.9"`` and ``"false"`` count. An absent key gets its default,
    a category of null stays null. Results without a usable row key, or outside the key range of
    their batch, are left out. An answer that is not JSON raises or is skipped, by profile.
    """
    mode = "PERMISSIVE" if cfg.on_classifier_error == "skip" else "FAILFAST"
    parsed = F.from_json("response", "results array<map<string,string>>", {"mode": mode})
    item = F.col("item")

    def value(name: str, default: str) -> Column:
        return F.when(F.map_contains_key(item, name), item[name]).otherwise(default)

    number = item["row_index"]
    row = F.coalesce(number.try_cast("bigint"), number.try_cast("double").try_cast("bigint"))
    suspicious = ~F.lower(F.trim(F.coalesce(item["suspicious"], F.lit("")))).isin(*FALSE_TEXTS)
    confidence = item["confidence"].try_cast("double")
    category = value("category", "Other")
    if cfg.strict_labels:
        category = F.when(category.isin(*cfg.labels), category).otherwise("Other")
    prediction = F.struct(
        category.alias("category_llm"),
        suspicious.alias("suspicious_llm"),
        value("suspicious_reason", "").alias("suspicious_reason_llm"),
        F.when(confidence.isNull(), 0.0).otherwise(finite(confidence)).alias("confidence_llm"),
    )
    return (
        responses.select("batch_id", "first_row", "last_row", parsed.alias("parsed"))
        .select("first_row", "last_row", F.posexplode("parsed.results").alias("place", "item"))
        .select(row.alias(ROW_KEY), "first_row", "last_row", "place", prediction.alias("p"))
        .where(F.col(ROW_KEY).between(F.col("first_row"), F.col("last_row")))
        .groupBy(ROW_KEY)
        .agg(F.max_by("p", "place").alias("p"))
        .select(ROW_KEY, "p.*")
    )


def lookup_categories(
    df: DataFrame, merchants: DataFrame, out: str = "category_llm", cfg: LedgerConfig = BATCH
) -> DataFrame:
    """Add the category of the merchant from a (merchant, category) table, else ``Other``.

    The join carries no hint: a small table is broadcast by its size; beyond that it is a shuffle
    join, in which adaptive execution splits the rows of a very frequent merchant. The merchant
    table must name each merchant once. In a ledger without merchants every row is ``Other``.
    """
    if "merchant" not in df.columns:
        return df.withColumn(out, F.lit("Other"))
    table = merchants.select(
        F.col("merchant").alias("_merchant"), F.col("category").alias("_category")
    )
    category = F.coalesce(F.col("_category"), F.lit("Other"))
    if cfg.strict_labels:
        category = F.when(category.isin(*cfg.labels), category).otherwise("Other")
    columns = [c for c in df.columns if c != out]
    return df.join(table, df["merchant"] == table["_merchant"], "left").select(
        *named(columns), category.alias(out)
    )


def merge_predictions(df: DataFrame, predictions: DataFrame) -> DataFrame:
    """Left join one prediction per row key; rows without one get blank defaults.

    Predictions for unknown keys are ignored. A category that was answered as null stays null.
    """
    hidden = {c: f"_{c}" for c in PREDICTION}
    found = predictions.select(
        F.col(ROW_KEY).alias("_row"), *[F.col(c).alias(n) for c, n in hidden.items()]
    )
    hit = F.col("_row").isNotNull()
    defaults = {
        "category_llm": F.lit(""),
        "suspicious_llm": F.lit(False),
        "suspicious_reason_llm": F.lit(""),
        "confidence_llm": F.lit(None).cast("double"),
    }
    base = df.drop(*PREDICTION)
    return base.join(found, base[ROW_KEY] == found["_row"], "left").select(
        *named(base.columns),
        *[F.when(hit, F.col(n)).otherwise(defaults[c]).alias(c) for c, n in hidden.items()],
    )


def failed_batches(responses: DataFrame) -> DataFrame:
    """The batches that no call answered, with their key range and error."""
    return responses.where(F.col("error").isNotNull()).select("batch_id", "first_row", "last_row", "error")


def classifier_responses(
    df: DataFrame, classifier: Classifier, cfg: LedgerConfig = BATCH, dense: bool = False
) -> DataFrame:
    """The answers of all batches, written once; taken from the log as far as it has them, if there is one."""
    payloads = batch_payloads(df, cfg, dense)
    if cfg.answer_log:
        return logged_responses(payloads, classifier, cfg.answer_log, cfg)
    return stage(classify(payloads, classifier, cfg))


def classifier_predictions(df: DataFrame, classifier: Classifier, cfg: LedgerConfig = BATCH) -> DataFrame:
    """Batch, classify and parse. The answers are written once, then read."""
    return parse_responses(classifier_responses(df, classifier, cfg), cfg)


def enrich_by_lookup(df: DataFrame, merchants: DataFrame, cfg: LedgerConfig = BATCH) -> DataFrame:
    """The ledger with predictions from a merchant table instead of a classifier.

    A known merchant has confidence 1, any other is ``Other`` with 0; nothing is suspicious. The
    columns are attached in place, and no row is shuffled by key.
    """
    return (
        lookup_categories(df, merchants, cfg=cfg)
        .withColumn("suspicious_llm", F.lit(False))
        .withColumn("suspicious_reason_llm", F.lit(""))
        .withColumn("confidence_llm", F.when(F.col("category_llm") == "Other", 0.0).otherwise(1.0))
    )


def enrich(df: DataFrame, classifier: Classifier, cfg: LedgerConfig = BATCH) -> DataFrame:
    """The ledger with the classifier's predictions merged in."""
    return merge_predictions(df, classifier_predictions(df, classifier, cfg))

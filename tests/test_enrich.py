import datetime as dt
import json
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyloom.config import BATCH, INTERACTIVE, LedgerConfig
from tallyloom.operators.clean import clean
from tallyloom.operators.enrich import (
    assign_batches,
    batch_payloads,
    classify,
    enrich,
    failed_batches,
    logged_responses,
    lookup_categories,
    merge_predictions,
    parse_responses,
)
from tallyloom.sources.generate import merchant_table

SKIP = LedgerConfig(on_classifier_error="skip")
ANSWER = "batch_id bigint, first_row bigint, last_row bigint, response string"


def ledger(spark, n, step=1):
    rows = [(i * step, f"2025-01-{i % 28 + 1:02}", float(i), "Uber", f"row {i}") for i in range(n)]
    return clean(spark.createDataFrame(rows, "row_index bigint, date string, amount double, merchant string, description string"))


def parsed(spark, text, cfg=SKIP, last=99):
    answers = spark.createDataFrame([(0, 0, last, text)], ANSWER)
    return {r.row_index: tuple(r)[1:] for r in parse_responses(answers, cfg).collect()}


def test_batches_are_consecutive(spark):
    got = assign_batches(ledger(spark, 45, step=1000).repartition(4)).collect()
    assert {r.row_index: r.batch_id for r in got} == {i * 1000: i // 20 for i in range(45)}


def test_dense_keys_need_no_exchange(spark):
    got = assign_batches(ledger(spark, 45), dense=True)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.row_index: r.batch_id for r in got.collect()} == {i: i // 20 for i in range(45)}


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None,), (3,), (5,)], "row_index bigint")
    assert assign_batches(df).count() == 3


def test_payload_records(spark):
    rows = [(3, None, None, "é", None), (4, "2025-01-02", 2.5, "Uber", "d")]
    df = clean(spark.createDataFrame(rows, "row_index bigint, date string, amount double, merchant string, description string"))
    row = batch_payloads(df).first()
    assert (row.batch_id, row.first_row, row.last_row) == (0, 3, 4) and "é" in row.payload
    assert json.loads(row.payload) == [
        {"row_index": 3, "date": "nan", "amount": None, "merchant": "é", "description": "nan", "currency": ""},
        {"row_index": 4, "date": "2025-01-02", "amount": 2.5, "merchant": "Uber", "description": "d", "currency": ""},
    ]


def test_answer_defaults(spark):
    got = parsed(spark, '{"results": [{"row_index": 1}, {"row_index": 2, "category": null, "confidence": null, "suspicious": null}]}')
    assert got == {1: ("Other", False, "", 0.0), 2: (None, False, "", 0.0)}


def test_answer_values_as_text(spark):
    got = parsed(
        spark,
        '{"results": [{"row_index": "1", "category": "Meals", "suspicious": "false", "suspicious_reason": "r", "confidence": "0.9"},'
        ' {"row_index": 2.0, "suspicious": "true", "confidence": 1}, {"row_index": 3, "suspicious": 1, "confidence": "high"},'
        ' {"row_index": 4, "confidence": "nan"}]}',
    )
    assert got == {1: ("Meals", False, "r", 0.9), 2: ("Other", True, "", 1.0), 3: ("Other", True, "", 0.0), 4: ("Other", False, "", None)}


def test_last_result_of_a_row_wins_and_strangers_are_left_out(spark):
    got = parsed(
        spark,
        '{"results": [{"row_index": 5, "category": "A"}, {"row_index": 5, "category": "B"}, {"category": "C"},'
        ' {"row_index": "x"}, {"row_index": 100, "category": "D"}, {"row_index": -1}]}',
    )
    assert got == {5: ("B", False, "", 0.0)}


def test_strict_labels(spark):
    text = '{"results": [{"row_index": 1, "category": "Meals"}, {"row_index": 2, "category": "Food"}, {"row_index": 3, "category": null}]}'
    got = parsed(spark, text, LedgerConfig(strict_labels=True))
    assert [got[i][0] for i in (1, 2, 3)] == ["Meals", "Other", "Other"]


@pytest.mark.parametrize("text", ["not json", '{"results": 5}', '{"results": [1]}', None, "{}"])
def test_unusable_answers(spark, text):
    assert parsed(spark, text) == {}
    if text in ("not json", '{"results": [1]}'):
        with pytest.raises(Exception):
            parsed(spark, text, BATCH)


def test_classifier_failure_by_profile(spark):
    def fails_on_second(payload):
        rows = json.loads(payload)
        if rows[0]["row_index"] == 10:
            raise RuntimeError("rate limit")
        return json.dumps({"results": [{"row_index": r["row_index"], "category": "Meals", "confidence": 0.5} for r in rows]})

    df = ledger(spark, 25)
    skip = LedgerConfig(batch_size=10, on_classifier_error="skip", classifier_tasks=2)
    got = {r.row_index: r for r in enrich(df, fails_on_second, skip).collect()}
    assert len(got) == 25
    assert {i for i, r in got.items() if r.category_llm == "Meals"} == set(range(10)) | set(range(20, 25))
    assert (got[12].category_llm, got[12].suspicious_llm, got[12].confidence_llm) == ("", False, None)
    with pytest.raises(PySparkException, match="rate limit"):
        classify(batch_payloads(df, LedgerConfig(batch_size=10)), fails_on_second).collect()


def test_interactive_profile_classifies_every_row(spark):
    def meals(payload):
        return json.dumps({"results": [{"row_index": r["row_index"], "category": "Meals"} for r in json.loads(payload)]})

    got = [r.category_llm for r in enrich(ledger(spark, 103), meals, INTERACTIVE).collect()]
    assert got == ["Meals"] * 103


def test_failed_calls_are_tried_again_and_kept(spark):
    def flaky():
        seen = {}

        def ask(payload):
            first = json.loads(payload)[0]["row_index"]
            seen[first] = seen.get(first, 0) + 1
            if first == 10 or (first == 20 and seen[first] < 3):
                raise TimeoutError("busy")
            return '{"results": []}'

        return ask

    cfg = LedgerConfig(batch_size=10, on_classifier_error="skip")
    answers = classify(batch_payloads(ledger(spark, 30), cfg), flaky(), cfg)
    assert [tuple(r) for r in failed_batches(answers).collect()] == [(1, 10, 19, "TimeoutError: busy")]


def test_waits_grow(spark, tmp_path):
    def late(payload):
        with open(tmp_path / "calls", "a") as calls:
            calls.write(f"{time.monotonic()}\n")
        raise TimeoutError("busy")

    cfg = LedgerConfig(on_classifier_error="skip", classifier_tries=4, classifier_wait=0.2)
    classify(batch_payloads(ledger(spark, 3), cfg), late, cfg).collect()
    at = [float(line) for line in (tmp_path / "calls").read_text().split()]
    waits = [b - a for a, b in zip(at, at[1:])]
    assert len(at) == 4 and all(w >= 0.2 * (i + 1) for i, w in enumerate(waits))


def test_the_log_leaves_only_missing_batches_to_ask_for(spark, tmp_path):
    calls = tmp_path / "calls"

    def asked():
        return sorted(int(line) for line in calls.read_text().split())

    def classifier(fails):
        def answer(payload):
            rows = json.loads(payload)
            with open(calls, "a") as out:
                out.write(f"{rows[0]['row_index']}\n")
            if rows[0]["row_index"] in fails:
                raise TimeoutError("busy")
            return json.dumps({"results": [{"row_index": r["row_index"], "category": r["description"]} for r in rows]})

        return answer

    def predicted(df, fails=()):
        calls.write_text("")
        return {r.row_index: r.category_llm for r in enrich(df, classifier(fails), cfg).collect()}

    cfg = LedgerConfig(batch_size=10, on_classifier_error="skip", classifier_tries=1, answer_log=str(tmp_path / "log"))
    df, every = ledger(spark, 45), {i: f"row {i}" for i in range(45)}
    first = predicted(df, fails=[20])
    assert asked() == [0, 10, 20, 30, 40]
    assert first == every | {i: "" for i in range(20, 30)}
    assert predicted(df.repartition(3)) == every and asked() == [20]
    assert predicted(df) == every and asked() == []
    changed = df.withColumn("description", F.when(F.col("row_index") == 33, "new").otherwise(F.col("description")))
    assert predicted(changed) == every | {33: "new"} and asked() == [30]
    assert predicted(df.limit(0)) == {} and asked() == []


def test_a_task_holds_few_answers_at_a_time(spark):
    def answer(payload):
        with open("/proc/self/statm") as f:
            return f"{int(f.read().split()[1]) * 4096 >> 20} ".ljust(100_000, "x")

    batches = spark.range(0, 3000, 1, 1).select(F.col("id").alias("batch_id"), F.lit("[]").alias("payload"))
    mb = classify(batches, answer).select("batch_id", F.split("response", " ")[0].cast("int").alias("mb"))
    first, last, n, ids = mb.agg(F.min("mb"), F.max("mb"), F.count("mb"), F.count_distinct("batch_id")).first()
    assert (n, ids) == (3000, 3000) and last - first < 150


def test_classify_passes_other_columns_on(spark):
    rows = [(1, None, None, [1.5, None], "p"), (None, "b", dt.date(2025, 1, 2), None, None)]
    df = spark.createDataFrame(rows, "k bigint, t string, d date, a array<double>, payload string")
    got = classify(df, lambda payload: None if payload is None else payload * 2)
    assert got.columns == ["k", "t", "d", "a", "response", "error"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, None, None, [1.5, None], "pp", None), (None, "b", dt.date(2025, 1, 2), None, None, None)]


def test_a_payload_that_two_runs_answered_has_one_answer(spark, tmp_path):
    log = str(tmp_path / "log")
    batches = batch_payloads(ledger(spark, 20), LedgerConfig(batch_size=10))
    hashes = batches.select(F.sha2("payload", 256).alias("payload_hash"))
    for run, text in enumerate(["b", "a"]):
        hashes.withColumn("response", F.lit(text)).write.parquet(f"{log}/run={run}")
    got = logged_responses(batches, lambda payload: "c", log)
    assert sorted((r.batch_id, r.response, r.error) for r in got.collect()) == [(0, "a", None), (1, "a", None)]


def test_merge_keeps_rows_and_null_categories(spark):
    schema = "row_index bigint, category_llm string, suspicious_llm boolean, suspicious_reason_llm string, confidence_llm double"
    predictions = spark.createDataFrame([(0, None, True, "odd", 0.5), (77, "Meals", False, "", 1.0)], schema)
    got = {r.row_index: (r.category_llm, r.suspicious_llm, r.confidence_llm) for r in merge_predictions(ledger(spark, 2), predictions).collect()}
    assert got == {0: (None, True, 0.5), 1: ("", False, None)}


def test_lookup(spark):
    rows = [(0, "d", 1.0, "Staples", "x"), (1, "d", 1.0, "McDonald's", "x"), (2, "d", 1.0, "Corner Shop", "x")]
    df = clean(spark.createDataFrame(rows, "row_index bigint, date string, amount double, merchant string, description string"))
    got = lookup_categories(df, merchant_table(spark)).orderBy("row_index").collect()
    assert [r.category_llm for r in got] == ["Office Supplies", "Meals", "Other"]

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.config import BATCH, INTERACTIVE, LedgerConfig
from tallyloom.plans import report
from tallyloom.plans.analysis import Analysis
from tallyloom.operators.clean import clean
from tallyloom.operators.review import apply_edits, reanalyse, review_view
from tallyloom.operators.rules import NEGATIVE, detect_anomalies
from tallyloom.sources.staging import stage

ENRICHED = (
    "row_index bigint, date string, amount double, merchant string, description string, "
    "anomaly_reasons_rule string, is_anomaly_rule boolean, category_llm string, suspicious_llm boolean, "
    "suspicious_reason_llm string, confidence_llm double"
)


def enriched(spark, rows):
    return clean(spark.createDataFrame(rows, ENRICHED))


def sample(spark):
    return enriched(
        spark,
        [
            (0, "2025-01-01", 10.0, "a", "x", "", False, "Meals", False, "Looks normal", 0.9),
            (1, "2025-01-02", 0.1, "b", "x", "Rule", True, "Meals", False, " ", 0.125),
            (2, "bad", 0.2, "c", "x", "Rule", True, "Travel", True, " Odd ", 0.0),
            (3, "2025-02-01", None, "d", "x", "", False, "", True, "Odd", None),
            (4, "2025-02-01", 5.0, "e", "x", "", False, None, None, None, None),
        ],
    )


def test_kpis(spark):
    row = report.kpis(sample(spark)).first()
    assert tuple(row) == (5, 4, 15.3, 2, 2, 3)
    empty = report.kpis(enriched(spark, [])).first()
    assert tuple(empty) == (0, 0, 0.0, 0, 0, 0)


def test_category_totals_drop_null_but_keep_blank(spark):
    got = [tuple(r) for r in report.category_totals(sample(spark)).collect()]
    assert got == [("Meals", 10.1), ("Travel", 0.2), ("", 0.0)]


def test_shares_are_of_every_row_and_round_half_even(spark):
    got = {r.category_llm: r.Percent for r in report.category_share(sample(spark), INTERACTIVE).collect()}
    assert got == {"Meals": 66.0, "Travel": 1.3, "": 0.0}
    rows = [(i, "2025-01-01", a, "m", "x", "", False, c, False, "", 1.0) for i, (a, c) in enumerate([(0.25, "A"), (99.75, "B")])]
    ties = {r.category_llm: r.Percent for r in report.category_share(enriched(spark, rows), INTERACTIVE).collect()}
    assert ties == {"A": 0.2, "B": 99.8}


def test_zero_total_gives_zero_percent(spark):
    rows = [(i, "2025-01-01", a, "m", "x", "", False, "A", False, "", 1.0) for i, a in enumerate([5.0, -5.0])]
    assert report.category_share(enriched(spark, rows)).first().Percent == 0.0


def test_totals_do_not_depend_on_order_and_hold_any_amount(spark):
    amounts = [0.1] * 10 + [1e15, -1e15, 0.12345, 1e300, -1e300]
    rows = [(i, "2025-01-01", a, "m", "x", "", False, "A", False, "", 1.0) for i, a in enumerate(amounts[:12])]
    assert report.kpis(enriched(spark, rows).repartition(5)).first().total_amount == 1.0
    fine = [(i, "2025-01-01", a, "m", "x", "", False, "A", False, "", 1.0) for i, a in enumerate([0.12345, 1e18])]
    assert report.kpis(enriched(spark, fine[:1])).first().total_amount == pytest.approx(0.12345, abs=1e-12)
    assert report.kpis(enriched(spark, fine)).first().total_amount == pytest.approx(1e18)


def test_monthly_trend(spark):
    got = [tuple(r) for r in report.monthly_trend(sample(spark)).collect()]
    assert got == [("2025-01", "Meals", 10.1), ("2025-02", "", 0.0), ("NaT", "Travel", 0.2)]


def test_reports_of_cells_equal_those_of_the_ledger(spark):
    for df in (sample(spark), sample(spark).limit(0), sample(spark).drop("is_anomaly_rule", "suspicious_llm")):
        cells = report.measure_cells(df, INTERACTIVE)
        pairs = [(report.kpis(df), report.kpis(df, cells)), (report.category_totals(df), report.category_totals(df, cells))]
        makers = [report.category_share, report.monthly_trend, report.summary_lines]
        makers += [report.summary_json, report.report_lines] if "is_anomaly_rule" in df.columns else []
        pairs += [(make(df, INTERACTIVE), make(df, INTERACTIVE, cells)) for make in makers]
        for plain, of_cells in pairs:
            assert plain.dtypes == of_cells.dtypes
            assert sorted(map(str, plain.collect())) == sorted(map(str, of_cells.collect()))


def test_totals_read_the_cells_and_not_the_ledger(spark):
    made = Analysis(stage(sample(spark)), BATCH)
    ledger = made.ledger.inputFiles()[0].rsplit("/", 1)[0]
    for totals in (made.kpis(), made.category_share(), made.monthly_trend(), made.summary_lines()):
        assert totals.inputFiles() and not any(path.startswith(ledger) for path in totals.inputFiles())


def test_anomaly_report(spark):
    got = [tuple(r)[-4:] for r in report.anomaly_report(sample(spark)).orderBy("row_index").collect()]
    assert got == [
        ("Rule-based only", "Rule", "Meals", "0.12"),
        ("Rule-based + AI", "Rule | AI: Odd", "Travel", "—"),
        ("AI only", "AI: Odd", "—", "—"),
    ]


def test_reports_without_classifier_columns(spark):
    rows = [(0, "2025-01-01", -1.0, "a", "x")]
    df = detect_anomalies(clean(spark.createDataFrame(rows, "row_index bigint, date string, amount double, merchant string, description string")))
    row = report.anomaly_report(df).first()
    assert row.analysis_source == "Rule-based only" and row.combined_reason == NEGATIVE
    assert "category_display" not in row


def test_summary_json(spark):
    lines = report.summary_json(sample(spark)).orderBy("section", "line_no").collect()
    assert [json.loads(r.summary) for r in lines] == [
        {"total_transactions": 5, "total_amount": 15.3, "num_anomalies": 3},
        {"category_llm": "Meals", "amount": 10.1},
        {"category_llm": "Travel", "amount": 0.2},
        {"category_llm": "", "amount": 0.0},
        {"date": "2025-01-02", "amount": 0.1, "merchant": "b", "description": "x", "anomaly_reasons_rule": "Rule", "suspicious_reason_llm": " "},
        {"date": "bad", "amount": 0.2, "merchant": "c", "description": "x", "anomaly_reasons_rule": "Rule", "suspicious_reason_llm": " Odd "},
        {"date": "2025-02-01", "amount": None, "merchant": "d", "description": "x", "anomaly_reasons_rule": "", "suspicious_reason_llm": "Odd"},
    ]


def test_documents_of_an_empty_ledger(spark):
    (line,) = report.summary_json(enriched(spark, [])).collect()
    assert json.loads(line.summary) == {"total_transactions": 0, "total_amount": 0.0, "num_anomalies": 0}
    lines = [r.line for r in report.report_lines(enriched(spark, [])).collect()]
    assert lines == ["Total transactions: 0", "Total amount: 0.00", "Total anomalies: 0"]
    assert [r.line for r in report.summary_lines(enriched(spark, [])).where("section = '1 basic'").collect()] == ["Total transactions: 0"]


def test_every_category_has_a_line(spark):
    columns = enriched(spark, []).schema
    row = {"row_index": F.col("id"), "amount": F.col("id").cast("double"), "category_llm": F.concat(F.lit("c"), "id")}
    many = spark.range(20_000).select(*[row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in columns])
    for make in (report.summary_json, report.report_lines, report.summary_lines):
        numbers = make(many).where("section = '2 categories'").agg(F.count("*"), F.max("line_no"), F.count_distinct("line_no")).first()
        assert tuple(numbers) == (20_000, 20_000, 20_000)


def test_edited_amounts_are_read_like_any_other(spark):
    ledger = sample(spark)
    edits = spark.createDataFrame([(0, "NaN"), (1, "Infinity"), (2, "abc"), (3, "7.5")], "row_index bigint, amount string")
    got = {r.row_index: r.amount for r in apply_edits(ledger, edits).collect()}
    assert [got[i] for i in range(4)] == [None, None, None, 7.5]
    numbers = spark.createDataFrame([(0, float("nan")), (1, float("inf"))], "row_index bigint, amount double")
    again = reanalyse(ledger, numbers)
    assert abs(report.kpis(again).first().total_amount) < 1e9


def test_report_lines(spark):
    got = [r.line for r in report.report_lines(sample(spark)).orderBy("section", "line_no").collect()]
    assert got == [
        "Total transactions: 5", "Total amount: 15.30", "Total anomalies: 3",
        "- Meals: 10.10", "- Travel: 0.20", "- : 0.00",
        "2025-01-02 | 0.10 | b | Rule", "bad | 0.20 | c | Rule", "2025-02-01 | nan | d | ",
    ]


def test_summary_lines(spark):
    got = [r.line for r in report.summary_lines(sample(spark)).orderBy("section", "line_no").collect()]
    assert got == [
        "Total transactions: 5", "Total amount: 15.30",
        "- Meals: 10.10 (66.0%)", "- Travel: 0.20 (1.3%)", "- : 0.00 (0.0%)",
        "Rule-based anomalies flagged: 2", "LLM-suspicious transactions: 2",
    ]


def test_summary_lines_follow_the_columns(spark):
    rows = [(0, "2025-01-01", -1.0, "x")]
    df = clean(spark.createDataFrame(rows, "row_index bigint, date string, amount double, description string"))
    assert [r.line for r in report.summary_lines(df).collect()] == ["Total transactions: 1", "Total amount: -1.00"]
    flagged = report.summary_lines(detect_anomalies(df)).collect()
    assert flagged[-1].line == "Rule-based anomalies flagged: 1" and len(flagged) == 3


def test_first_rows_follow_the_row_key(spark):
    rows = [(i, "2025-01-01", 1.0, "m", "x", "R", True, "A", False, "", 1.0) for i in range(30)]
    df = enriched(spark, rows).orderBy(F.desc("row_index")).repartition(4)
    assert [r.row_index for r in report.first_anomalies(df).collect()] == list(range(10))
    assert [r.row_index for r in report.preview(df, BATCH).collect()] == list(range(5))
    assert report.preview(df, INTERACTIVE).count() == 20


# --- edits --------------------------------------------------------------------------------


def test_no_edits_change_nothing(spark):
    df = sample(spark)
    none = review_view(df).limit(0)
    assert sorted(map(tuple, apply_edits(df, none).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_edits_replace_values_and_null_counts(spark):
    edits = spark.createDataFrame(
        [(0, "2025-03-09", None, "Travel"), (2, "2025-02-03", 7.0, None), (999, "x", 1.0, "x")],
        "row_index bigint, date string, amount double, category_llm string",
    )
    got = {r.row_index: r for r in apply_edits(sample(spark), edits).collect()}
    assert len(got) == 5
    assert (got[0].amount, got[0].category_llm, got[0].date_parsed) == (None, "Travel", dt.datetime(2025, 3, 9))
    assert (got[2].amount, got[2].category_llm, got[2].date_parsed) == (7.0, None, dt.datetime(2025, 2, 3))
    assert (got[1].amount, got[1].merchant) == (0.1, "b")


def test_a_row_edited_twice_is_an_error(spark):
    edits = spark.createDataFrame([(0, 1.0), (0, 2.0)], "row_index bigint, amount double")
    with pytest.raises(Exception, match="edited more than once"):
        apply_edits(sample(spark), edits).collect()
    with pytest.raises(ValueError, match="nothere"):
        apply_edits(sample(spark), edits.withColumnRenamed("amount", "nothere"))


def test_reanalysis_recomputes_rules_and_keeps_predictions(spark):
    rows = [(i, f"2025-01-{i + 1:02}", 10.0 + i, "m", "x", "", False, "Meals", False, "", 0.5) for i in range(20)]
    df = detect_anomalies(enriched(spark, rows))
    assert [r.row_index for r in df.where("is_anomaly_rule").collect()] == [19]
    edits = spark.createDataFrame([(19, 1.0), (3, 900.0), (4, -2.0)], "row_index bigint, amount double")
    again = {r.row_index: r for r in reanalyse(df, edits).collect()}
    assert {i for i, r in again.items() if r.is_anomaly_rule} == {3, 4}
    assert all(r.category_llm == "Meals" for r in again.values()) and len(again) == 20


# --- hashes first, touched keys only --------------------------------------------------------


def test_duplicates_with_forced_hash_collisions(spark):
    from pyspark.sql import functions as F

    from tallyloom.operators.duplicates import repeated_keys

    rows = [(None, "x"), (None, "x"), ("a", None), ("a", "b"), ("a", "b"), ("b", "a"), (None, None), ("c", "c")]
    frame = spark.createDataFrame(rows, "p string, q string")
    expected = {(None, "x", 2), ("a", "b", 2)}
    for mark in (None, F.lit(1), F.length("p")):
        assert {tuple(r) for r in repeated_keys(frame, ["p", "q"], mark).collect()} == expected
    plan = repeated_keys(frame, ["p", "q"])._jdf.queryExecution().toString()
    assert "LeftSemi" in plan


def test_reanalysis_of_touched_keys_equals_a_full_run(spark):
    import random

    from tallyloom.operators.review import apply_edits, reanalyse
    from tallyloom.operators.rules import detect_anomalies
    from tallyloom.sources.staging import stage

    draw = random.Random(3)
    rows = [(i, f"2025-01-0{draw.randint(1, 2)}", float(draw.randint(-1, 3)), draw.choice("mn"), draw.choice(["x", "y", None])) for i in range(120)]
    kinds = "row_index bigint, date string, amount double, merchant string, description string"
    judged = stage(detect_anomalies(stage(spark.createDataFrame(rows, kinds))))
    for n in (1, 40):
        edits = [(i, draw.choice([1.0, 2.0, 500.0, None]), draw.choice(["x", "z", None])) for i in draw.sample(range(125), n)]
        edits = spark.createDataFrame(edits, "row_index bigint, amount double, description string")
        for some in (edits, edits.select("row_index", "amount"), edits.select("row_index")):
            full = detect_anomalies(stage(apply_edits(judged, some)))
            assert sorted(map(str, reanalyse(judged, some).collect())) == sorted(map(str, full.select(*judged.columns).collect()))


def test_pending_edits_and_owned_staging(spark, tmp_path):
    from pathlib import Path

    from tallyloom.plans.analysis import run
    from tallyloom.sources.staging import owned_staging, shared_folder, stage

    (tmp_path / "l.csv").write_text("date,amount,description\n" + "".join(f"2025-01-{i:02},{i},d{i}\n" for i in range(1, 29)))
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("staged-*"))
    for _ in range(2):
        analysis = run(spark, str(tmp_path / "l.csv"), str(tmp_path / "out"))
    assert set(folder.glob("staged-*")) == before and analysis.ledger.count() == 28
    edits = spark.createDataFrame([(0, -5.0)], "row_index bigint, amount double")
    pending = analysis.propose(edits)
    first = pending.review().where("row_index = 0").first()
    assert first.amount == -5.0 and first.anomaly_reasons_rule == "" and analysis.review().where("amount < 0").count() == 0
    assert pending.kpis().first() == analysis.kpis().first()
    assert pending.apply().ledger.where("amount < 0").first().is_anomaly_rule
    with owned_staging(spark):
        outer = stage(spark.range(3))
        with owned_staging(spark):
            inner = stage(spark.range(3)).inputFiles()[0]
        assert outer.count() == 3 and not Path(inner.removeprefix("file://")).exists()

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.config import BATCH, LedgerConfig
from tallyloom.functions.values import fixed, strip_text, thousands
from tallyloom.operators.clean import clean, drop_blank_rows, null_tokens, require_columns, with_month

SCHEMA = "row_index bigint, date string, amount string, description string, merchant string"


def ledger(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_required_columns_are_named(spark):
    df = spark.createDataFrame([("x",)], "date string")
    with pytest.raises(ValueError, match=r"\['amount', 'description'\]"):
        require_columns(df)


def test_null_tokens_match_whole_text_only(spark):
    texts = ["N/A", "null", "None", "<NA>", "nan", "", "-", "none", "NaN ", "x"]
    df = null_tokens(spark.createDataFrame([(t,) for t in texts], "t string"))
    assert [r.t for r in df.collect()] == [None] * 6 + ["-", "none", "NaN ", "x"]


def test_blank_rows_ignore_the_row_key(spark):
    df = ledger(spark, [(0, None, None, None, None), (1, None, "1", None, None)])
    assert [r.row_index for r in drop_blank_rows(df).collect()] == [1]


def test_blank_rows_count_nan_as_missing(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, 1.0), ("x", float("nan"))], "a string, v double")
    assert drop_blank_rows(df).count() == 2


@pytest.mark.parametrize(
    "text, value",
    [
        (" 7.5 ", 7.5), ("1e3", 1000.0), ("+5.", 5.0), (".5", 0.5), ("-12", -12.0), ("007", 7.0),
        ("1,200.50", None), ("$5", None), ("(5.00)", None), ("3d", None), ("5f", None), ("0x1p3", None),
        ("NaN", None), ("inf", None), ("-Infinity", None), ("1e999", None), ("", None), ("abc", None), (None, None),
    ],
)
def test_amount_text(spark, text, value):
    assert clean(ledger(spark, [(0, "2025-01-01", text, "d", "m")])).first().amount == value


def test_amount_columns_that_are_numbers(spark):
    df = spark.createDataFrame(
        [("d", 1.5, "x"), ("d", float("nan"), "x"), ("d", float("inf"), "x")],
        "date string, amount double, description string",
    )
    assert [r.amount for r in clean(df).collect()] == [1.5, None, None]


def test_dates(spark):
    texts = ["2025-01-31", "2025-02-30", "2025-03-04 10:00:00", "15-Feb-2025", None]
    df = clean(ledger(spark, [(i, t, "1", "d", "m") for i, t in enumerate(texts)]))
    rows = with_month(df).orderBy("row_index").collect()
    assert [r.date_parsed for r in rows] == [dt.datetime(2025, 1, 31), None, None, None, None]
    assert [r.date for r in rows] == texts
    assert [r.month for r in rows] == ["2025-01", "NaT", "NaT", "NaT", "NaT"]
    wider = LedgerConfig(date_formats=("yyyy-MM-dd", "dd-MMM-yyyy"))
    again = clean(ledger(spark, [(0, "15-Feb-2025", "1", "d", "m")]), wider)
    assert again.first().date_parsed == dt.datetime(2025, 2, 15)


def test_text_is_trimmed_and_missing_text_spelled(spark):
    rows = clean(ledger(spark, [(0, None, "1", " \t a b \x1f　", None)])).collect()
    assert (rows[0].description, rows[0].merchant) == ("a b", "nan")
    kept = clean(ledger(spark, [(0, None, "1", None, None)]), LedgerConfig(missing_text=None)).first()
    assert kept.description is None


def test_trim_equals_python(spark):
    texts = [chr(c) + "x" + chr(c) for c in range(0x3001) if not 0xD800 <= c < 0xE000 and c]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip_text(F.col("t")).alias("s"))
    assert [r.t for r in df.collect() if r.s != r.t.strip()] == []


def test_other_columns_pass_through_and_merchant_is_optional(spark):
    df = spark.createDataFrame([("2025-01-01", "1", "d", "Rome")], "date string, amount string, description string, location string")
    assert clean(df).columns == ["date", "amount", "description", "location", "date_parsed"]
    assert BATCH.missing_text == "nan"


@pytest.mark.parametrize("value", [0.125, 1.005, 0.25, 12.45, 2.675, -0.125, 1234567.885, 0.0, 1e15])
def test_number_formats_equal_python(spark, value):
    v = F.lit(value)
    row = spark.range(1).select(fixed(v, 2).alias("f2"), fixed(v, 1).alias("f1"), thousands(v).alias("t")).first()
    assert (row.f2, row.f1, row.t) == (f"{value:.2f}", f"{value:.1f}", f"{value:,.2f}")

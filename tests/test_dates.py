from datetime import datetime

import pytest

from tallyloom.config import DATE_SHAPES, LedgerConfig
from tallyloom.operators.clean import clean, with_month
from tallyloom.operators.dates import vote_format
from tallyloom.plans.analysis import run

KINDS = "date string, amount string, description string"


def ledger(spark, dates):
    return spark.createDataFrame([(d, "1", "x") for d in dates], KINDS)


def read(spark, dates, **kw):
    return [r.date_parsed for r in clean(ledger(spark, dates), LedgerConfig(**kw)).collect()]


def test_every_listed_format_wins_among_its_own_dates(spark):
    dates = [datetime(2024, 1 + i % 12, 1 + i, 13, 5, 9) for i in range(28)]
    frame = spark.createDataFrame([(d,) for d in dates], "d timestamp")
    for fmt in DATE_SHAPES:
        text = frame.selectExpr(f"date_format(d, \"{fmt}\") AS date")
        assert vote_format(text) == fmt


def test_one_day_above_12_settles_which_comes_first(spark):
    days = [f"{m:02}/05/2024" for m in range(1, 13)]
    got = read(spark, [*days, "02/13/2024"])
    assert got == [datetime(2024, m, 5) for m in range(1, 13)] + [datetime(2024, 2, 13)]
    assert read(spark, [*days, "13/02/2024"])[0] == datetime(2024, 5, 1)


def test_ties_are_refused_and_a_given_list_wins(spark):
    unclear = ["01/02/2024", "03/04/2024"]
    with pytest.raises(ValueError, match="equally well"):
        read(spark, unclear)
    assert read(spark, unclear, date_formats=("dd/MM/yyyy",)) == [datetime(2024, 2, 1), datetime(2024, 4, 3)]
    with pytest.raises(ValueError, match="equally well"):
        read(spark, ["2024-01-02", "1.2.2024"])
    # No tie where both orders read the same dates.
    assert read(spark, ["01/01/2024", "02/02/2024"]) == [datetime(2024, 1, 1), datetime(2024, 2, 2)]


def test_the_shape_of_more_values_settles_a_tie(spark):
    assert read(spark, ["1.2.2024", "2024-02-30", "2024-01-02"]) == [None, None, datetime(2024, 1, 2)]
    with pytest.raises(ValueError, match="equally well"):
        read(spark, ["1.2.2024", "31.2.2024", "2024-02-30", "2024-01-02"])


def test_dates_that_nothing_reads(spark):
    assert read(spark, ["soon", None, ""]) == [None] * 3
    assert clean(ledger(spark, [])).count() == 0
    assert with_month(ledger(spark, ["2/14/2024"])).first().month == "2024-02"


def test_a_file_of_other_dates_is_read(spark, tmp_path):
    rows = "".join(f"{i % 12 + 1:02}/{i % 28 + 1:02}/2025,{i},row {i}\n" for i in range(40))
    (tmp_path / "l.csv").write_text("date,amount,description\n" + rows)
    analysis = run(spark, str(tmp_path / "l.csv"), str(tmp_path / "out"))
    assert analysis.cfg.date_formats == ("M/d/yyyy",)
    assert {r.date_parsed for r in analysis.ledger.collect()} == {datetime(2025, i % 12 + 1, i % 28 + 1) for i in range(40)}

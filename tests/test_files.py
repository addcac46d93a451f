import csv
import json
from pathlib import Path

import pytest

from tallyloom.config import INTERACTIVE, LedgerConfig
from tallyloom.operators.clean import clean
from tallyloom.plans.analysis import analyse, run
from tallyloom.sources.files import ledger_of_lines, read_clean_ledger, read_ledger, write_csv, write_enriched
from tallyloom.sources.generate import COLUMNS, generate_ledger, generate_rows, merchant_table
from tallyloom.sources.records import TASKS_PER_CORE, csv_lines
from tallyloom.sources.staging import shared_folder, stage


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_numbers_rows_in_order_and_drops_blanks(spark, tmp_path):
    path = write(
        tmp_path / "l.csv",
        'date,amount,description,location\n2025-01-01,1,"say ""hi""","Rome, IT"\n,,,\n\n2025-01-02,N/A,x\nn/a,null,NaN,\n2025-01-03,3, y ,"",\n'.replace('"",\n', '""\n'),
    )
    rows = read_ledger(spark, path).orderBy("row_index").collect()
    assert [tuple(r) for r in rows] == [
        (0, "2025-01-01", "1", 'say "hi"', "Rome, IT"),
        (1, "2025-01-02", None, "x", None),
        (2, "2025-01-03", "3", " y ", None),
    ]


def test_reading_and_cleaning_in_one_pass_is_the_same(spark, tmp_path):
    path = write(tmp_path / "l.csv", "date,amount,description\n2025-01-01, 7 , x \n,,\nbad,N/A,\n")
    one_pass = read_clean_ledger(spark, path)
    two_passes = clean(read_ledger(spark, path))
    assert one_pass.columns == two_passes.columns
    assert sorted(map(str, one_pass.collect())) == sorted(map(str, two_passes.collect()))
    assert one_pass.count() == 2


def test_missing_columns_and_bad_records(spark, tmp_path):
    with pytest.raises(ValueError, match="description"):
        read_ledger(spark, write(tmp_path / "a.csv", "date,amount\n2025-01-01,1\n"))
    with pytest.raises(Exception, match="more than 3 fields"):
        read_ledger(spark, write(tmp_path / "b.csv", "date,amount,description\n2025-01-01,1,x,too many\n"))


def test_line_breaks_in_fields_are_read(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'date,amount,description\n2025-01-01,1,"two\nlines"\n2025-01-02,2,b\n')
    sly = write(tmp_path / "s.csv", 'date,amount,description\n2025-01-01,1,"two\nx,y,lines"\n')
    assert read_ledger(spark, sly).first().description == "two\nx,y,lines"
    rows = read_ledger(spark, path).orderBy("row_index").collect()
    assert [(r.row_index, r.description) for r in rows] == [(0, "two\nlines"), (1, "b")]
    with pytest.raises(ValueError, match="open quote"):
        read_ledger(spark, write(tmp_path / "o.csv", 'date,amount,description\n2025-01-01,1,"two\nlines\n'))


@pytest.mark.parametrize("size", ["97", "1000000"])
def test_line_breaks_across_splits(spark, tmp_path, size):
    """Fields of many lines, quotes and commas, in files cut into splits anywhere."""
    pieces = ["plain", 'a "quoted" word', "one\ntwo", 'x\n\n"y",\n",\n,"\nz', "", '"\n"', "tail,\n" * 12, ',"', '",', "5\" pipe"]
    rows = [[f"2025-01-{i % 28 + 1:02}", str(i), pieces[i % len(pieces)] + f" {i}", pieces[i * 7 % len(pieces)]] for i in range(30)]
    for part in range(2):
        with open(tmp_path / f"p{part}.csv", "w", newline="") as file:
            out = csv.writer(file, lineterminator="\n")
            out.writerow(["date", "amount", "description", "notes"])
            out.writerows(rows[part * 15 : part * 15 + 15])
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = read_ledger(spark, str(tmp_path)).orderBy("row_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert [(r.row_index, [r.date, r.amount, r.description, r.notes or ""]) for r in got] == list(enumerate(rows))


def test_small_splits_share_tasks(spark, tmp_path):
    rows = [f'2025-01-{i % 28 + 1:02},{i},"row\n{i}"' for i in range(800)]
    for part in range(2):
        write(tmp_path / f"p{part}.csv", "\n".join(["date,amount,description", *rows[part * 400 : part * 400 + 400]]) + "\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        lines = csv_lines(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert lines.select("_file", "_split").distinct().count() > 150
    assert len(lines.inputFiles()) <= TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    got = ledger_of_lines(spark, str(tmp_path), lines).orderBy("row_index").collect()
    assert [(r.row_index, r.amount, r.description) for r in got] == [(i, str(i), f"row\n{i}") for i in range(800)]


def test_quotes_inside_fields_are_text(spark, tmp_path):
    text = 'date,amount,description\n2025-01-01,5,5" pipe\n2025-01-02,6,"a ""b"", c"\n'
    rows = read_ledger(spark, write(tmp_path / "q.csv", text)).orderBy("row_index").collect()
    assert [r.description for r in rows] == ['5" pipe', 'a "b", c']


def test_numbers_across_many_files_and_splits(spark, tmp_path):
    expected = []
    for part in range(3):
        lines = [f"2025-01-01,{i},file {part} row {i}" for i in range((part + 1) * 400)]
        write(tmp_path / f"part-{part}.csv", "date,amount,description\n" + "\n".join(lines) + "\n")
        expected += [f"file {part} row {i}" for i in range((part + 1) * 400)]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_ledger(spark, str(tmp_path))
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert [r.description for r in sorted(rows, key=lambda r: r.row_index)] == expected
    assert sorted(r.row_index for r in rows) == list(range(2400))


def test_files_with_other_headers_are_refused(spark, tmp_path):
    write(tmp_path / "a.csv", "date,amount,description\n2025-01-01,1,x\n")
    write(tmp_path / "b.csv", "amount,date,description\n1,2025-01-01,x\n")
    with pytest.raises(Exception):
        read_ledger(spark, str(tmp_path)).collect()


def test_csv_out_and_in(spark, tmp_path):
    rows = [("2025-01-01", "1", ' "quoted", text '), ("2025-01-02", None, "b\\c")]
    write_csv(spark.createDataFrame(rows, "date string, amount string, description string"), str(tmp_path / "o"))
    back = read_ledger(spark, str(tmp_path / "o")).drop("row_index").collect()
    assert sorted(map(tuple, back), key=str) == sorted(rows, key=str)


def test_stage_uses_the_shared_folder(spark):
    folder = shared_folder(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or folder == configured
    staged = stage(spark.range(5))
    assert staged.count() == 5 and folder.split(":")[-1] in staged.inputFiles()[0]


# --- generator ----------------------------------------------------------------------------


def test_generator_is_deterministic_and_plausible(spark):
    ids = spark.range(4000)
    rows = generate_rows(ids).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, generate_rows(ids.repartition(3)).collect()))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, generate_rows(ids, seed=7).collect()))
    known = {r.merchant: r.category for r in merchant_table(spark).collect()}
    assert len(known) == 22
    share = {c: sum(known[r.merchant] == c for r in rows) / 4000 for c in set(known.values())}
    expected = {"Travel": 0.2, "Meals": 0.25, "Software": 0.15, "Utilities": 0.1, "Office Supplies": 0.15, "Salary": 0.05, "Miscellaneous": 0.1}
    assert all(abs(share[c] - p) < 0.03 for c, p in expected.items())
    limits = {"Travel": (25, 400), "Software": (15, 150), "Salary": (3000, 5000)}
    for r in rows:
        low, high = limits.get(known[r.merchant], (10, 120))
        assert low <= r.amount <= high and round(r.amount, 2) == r.amount
        assert "2025-01-01" <= r.date <= "2025-03-31" and r.description == r.merchant
    assert abs(sum(r.notes != "" for r in rows) / 4000 - 0.3) < 0.03


# --- the whole run ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ledger_csv(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in") / "ledger"
    write_csv(generate_ledger(spark.range(95)).coalesce(1), str(folder))
    return str(folder)


def test_error_cases(spark, ledger_csv):
    """The labelled rows: which rule they meet, and which they do not."""
    analysis = analyse(read_ledger(spark, ledger_csv))
    rows = {r.transaction_id: r for r in analysis.ledger.collect()}
    assert len(rows) == 101 and sorted(r.row_index for r in rows.values()) == list(range(101))
    assert rows["TXN2001"].description == "nan" and not rows["TXN2001"].is_anomaly_rule
    assert rows["TXN2002"].date_parsed is None and not rows["TXN2002"].is_anomaly_rule
    assert rows["TXN2003"].anomaly_reasons_rule.startswith("Unusually high amount (> ")
    assert rows["TXN2004"].anomaly_reasons_rule == rows["TXN2005"].anomaly_reasons_rule == "Possible duplicate transaction"
    assert rows["TXN2006"].anomaly_reasons_rule == "Negative amount (possible refund or data issue)"
    assert rows["TXN2003"].category_llm == "Other" and rows["TXN2004"].category_llm == "Meals"


def test_run_writes_every_output(spark, ledger_csv, tmp_path):
    out = tmp_path / "out"
    cfg = LedgerConfig(export_month=True, ordered_export=True)
    analysis = run(spark, ledger_csv, str(out), cfg=cfg)
    written = {p.name for p in Path(out).iterdir()}
    assert written == {"enriched", "review", "category_share", "monthly_trend", "anomalies", "summary_json", "summary", "report", "ledger"}
    lines = [row for part in sorted((out / "enriched").glob("*.csv")) for row in list(csv.DictReader(part.open(encoding="utf-8")))]
    assert len(lines) == 101 and set(COLUMNS) <= set(lines[0]) and "month" in lines[0] and "row_index" not in lines[0]
    assert [r["transaction_id"] for r in lines] == [r.transaction_id for r in analysis.ledger.orderBy("row_index").collect()]
    texts = sorted((out / "summary_json").glob("*.txt"))
    first, *rest = [json.loads(line) for p in texts for line in p.read_text().splitlines()]
    assert first["total_transactions"] == 101
    assert abs(sum(c["amount"] for c in rest if "category_llm" in c) - first["total_amount"]) < 1e-6
    report = "".join(p.read_text() for p in sorted((out / "report").glob("*.txt")))
    assert report.startswith("Total transactions: 101\n")


def test_interactive_profile_reaches_every_row(spark, ledger_csv):
    analysis = analyse(read_ledger(spark, ledger_csv), cfg=INTERACTIVE)
    assert analysis.ledger.where("category_llm = ''").count() == 0


def test_results_ignore_partitioning(spark, ledger_csv):
    ledger = read_ledger(spark, ledger_csv)
    one, many = analyse(ledger.coalesce(1)), analyse(ledger.repartition(9))
    assert sorted(one.summary_json().collect()) == sorted(many.summary_json().collect())
    assert sorted(map(str, one.ledger.collect())) == sorted(map(str, many.ledger.collect()))


def test_enriched_export_keeps_all_columns(spark, tmp_path):
    df = clean(spark.createDataFrame([(0, "2025-01-01", "1", "d", "z")], "row_index bigint, date string, amount string, description string, extra string")).coalesce(1)
    write_enriched(df, str(tmp_path / "e"))
    (part,) = list((tmp_path / "e").glob("*.csv"))
    header, row = csv.reader(part.open())
    assert header == ["date", "amount", "description", "extra", "date_parsed"]
    assert row == ["2025-01-01", "1.0", "d", "z", "2025-01-01"]


def test_headers_with_dots_and_spaces_pass_through(spark, tmp_path):
    path = write(tmp_path / "d.csv", "date,amount,description,Acct. No,merchant\n2025-01-01,1,x,7,Uber\n2025-01-01,1,x,8,Uber\n")
    analysis = analyse(read_ledger(spark, path))
    rows = analysis.ledger.orderBy("row_index").collect()
    assert [r["Acct. No"] for r in rows] == ["7", "8"] and all(r.is_anomaly_rule for r in rows)
    edits = spark.createDataFrame([(0, "9")], "row_index bigint, `Acct. No` string")
    assert analysis.edited(edits).ledger.orderBy("row_index").first()["Acct. No"] == "9"
    with pytest.raises(ValueError, match="row_index"):
        read_ledger(spark, write(tmp_path / "r.csv", "date,amount,description,row_index\na,1,x,7\n"))

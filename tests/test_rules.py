import random

import pytest
from pyspark.sql import functions as F

from tallyloom.config import BATCH, LedgerConfig
from tallyloom.operators.clean import clean
from tallyloom.operators.duplicates import flag_duplicates
from tallyloom.operators.position import with_position
from tallyloom.operators.quantile import approximate_quantile, exact_quantile
from tallyloom.operators.rules import DUPLICATE, NEGATIVE, detect_anomalies

SCHEMA = "row_index bigint, date string, amount double, merchant string, description string"


def ledger(spark, rows):
    return clean(spark.createDataFrame(rows, SCHEMA))


def brute_quantile(values, q):
    """Order statistics, written independently of the bucket passes."""
    values = sorted(values)
    position = (len(values) - 1) * q
    below = int(position)
    part = position - below
    if part == 0:
        return values[below]
    a, b = values[below], values[below + 1]
    return b - (b - a) * (1 - part) if part >= 0.5 else a + (b - a) * part


def money(n, seed):
    draw = random.Random(seed)
    return [round(draw.uniform(-500, 5000), 2) for _ in range(n)]


CASES = {
    "one": [5.0],
    "two": [1.0, 2.0],
    "equal": [7.25] * 40,
    "money": money(997, 1),
    "hot value": [3.5] * 400 + money(600, 2),
    "tiny gaps": [1.0 + i * 2**-50 for i in range(60)],
    "wide": [(-1) ** i * 10.0 ** (i - 60) for i in range(121)],
    "negative": [-float(i) for i in range(50)],
    "zeros": [0.0, -0.0, 0.0, 1e-300, -1e-300],
    "edge of buckets": [float(i) for i in range(20)] + [1e15],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("q", [0.95, 0.5])
def test_quantile_equals_brute_force(spark, name, q):
    values = CASES[name]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert exact_quantile(df, "v", q) == brute_quantile(values, q)


@pytest.mark.parametrize("error", [0.05, 0.002])
def test_approximate_quantile_keeps_its_rank_error(spark, error):
    rng = random.Random(3)
    values = [rng.choice([rng.lognormvariate(4, 2), 7.0, -rng.random()]) for _ in range(20000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "amount double").repartition(16)
    for q in (0.05, 0.5, 0.95):
        found = approximate_quantile(df, "amount", q, error)
        below, upto = sum(v < found for v in values), sum(v <= found for v in values)
        assert found in values and below - error * 20000 - 1 <= q * 20000 <= upto + error * 20000 + 1
    assert approximate_quantile(df.limit(0), "amount", 0.5, error) is None
    with pytest.raises(ValueError):
        approximate_quantile(df, "amount", 0.5, 0.0)


def test_quantile_of_nothing(spark):
    assert exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.95) is None
    assert exact_quantile(spark.createDataFrame([], "v double"), "v", 0.95) is None


def test_quantile_ignores_partitioning(spark):
    values = money(500, 3)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert exact_quantile(df.repartition(7), "v", 0.95) == exact_quantile(df.coalesce(1), "v", 0.95)


def test_reasons_in_order(spark):
    rows = [(i, "2025-01-01", 10.0 + i, "m", "d") for i in range(40)]
    rows += [(100, "2025-01-02", -5.0, "m", "d"), (101, "2025-01-02", -5.0, " m ", "d")]
    rows += [(102, "2025-01-03", 500.0, "m", "d"), (103, "2025-01-03", 500.0, "m", "d"), (104, None, None, "m", "d")]
    found = {r.row_index: r for r in detect_anomalies(ledger(spark, rows)).collect()}
    threshold = brute_quantile([r[2] for r in rows if r[2] is not None], 0.95)
    high = f"Unusually high amount (> {threshold:.2f})"
    assert found[100].anomaly_reasons_rule == found[101].anomaly_reasons_rule == f"{NEGATIVE}, {DUPLICATE}"
    assert found[102].anomaly_reasons_rule == f"{high}, {DUPLICATE}"
    assert found[104].anomaly_reasons_rule == "" and found[104].is_anomaly_rule is False
    assert all(r.is_anomaly_rule == (r.anomaly_reasons_rule != "") for r in found.values())
    assert len(found) == len(rows)


def test_threshold_itself_is_not_high(spark):
    rows = [(i, f"2025-01-{i + 1:02}", float(i), "m", "d") for i in range(21)]
    flagged = detect_anomalies(ledger(spark, rows)).where("is_anomaly_rule").collect()
    assert [r.row_index for r in flagged] == [20]


def test_missing_values_equal_in_duplicate_keys(spark):
    rows = [(0, None, None, None, "d"), (1, None, None, None, "d"), (2, "2025-01-01", None, None, "d")]
    flagged = detect_anomalies(ledger(spark, rows)).where("is_anomaly_rule").collect()
    assert sorted(r.row_index for r in flagged) == [0, 1]


def test_rules_without_amounts_or_rows_or_merchant(spark):
    rows = [(0, "a", None, "m", "d"), (1, "b", None, "m", "d")]
    assert detect_anomalies(ledger(spark, rows)).where("is_anomaly_rule").count() == 0
    assert detect_anomalies(ledger(spark, [])).count() == 0
    no_merchant = ledger(spark, [(0, "a", 1.0, "m", "d"), (1, "a", 1.0, "n", "d")]).drop("merchant")
    assert detect_anomalies(no_merchant).where("is_anomaly_rule").count() == 2


def test_rules_twice_replace_columns(spark):
    rows = [(0, "a", 1.0, "m", "d"), (1, "a", 1.0, "m", "d")]
    once = detect_anomalies(ledger(spark, rows))
    twice = detect_anomalies(once)
    assert sorted(twice.columns) == sorted(once.columns)
    assert twice.where("is_anomaly_rule").count() == 2


@pytest.mark.parametrize("broadcast_bytes", ["10485760", "-1"])
def test_duplicates_by_every_join(spark, broadcast_bytes):
    """One key holds a third of the rows; broadcast and shuffle joins must agree with counting."""
    draw = random.Random(4)
    keys = [None] * 400 + [str(draw.randrange(500)) for _ in range(800)]
    rows = [(i, k, None if k is None else float(len(k))) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "row_index bigint, k string, v double").repartition(5)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast_bytes)
    try:
        flagged = flag_duplicates(df, ["k", "v"], "dup").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(flagged) == len(rows)
    assert {r.row_index for r in flagged if r.dup} == {i for i, k in enumerate(keys) if keys.count(k) > 1}


def test_hot_rows_are_spread(spark):
    """Adaptive execution splits the rows of 1,500 frequent keys and of one with a third of all."""
    key = F.when(F.col("id") % 3 == 0, "same").otherwise((F.col("id") % 1500).cast("string"))
    df = spark.range(60_000).select(F.col("id").alias("row_index"), key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.shuffle.partitions": "16",
    }
    kept = {n: spark.conf.get(n) for n in low}
    try:
        for name, value in low.items():
            spark.conf.set(name, value)
        out = flag_duplicates(df, ["k"], "dup")
        sizes = [r["count"] for r in out.groupBy("text", F.spark_partition_id().alias("p")).count().groupBy("p").count().collect()]
        assert out.where("dup").count() == 60_000
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 60_000 and max(sizes) < 20_000


def test_quantile_and_rules_ignore_nan(spark):
    rows = [(i, float(i)) for i in range(1, 101)] + [(101, float("nan")), (102, float("inf")), (103, None)]
    df = spark.createDataFrame(rows, "row_index bigint, amount double")
    assert exact_quantile(df, "amount", 0.5) == 50.5
    flagged = {r.row_index for r in detect_anomalies(df).collect() if "high" in r.anomaly_reasons_rule}
    assert flagged == {96, 97, 98, 99, 100}


def test_positions_of_sparse_keys(spark):
    draw = random.Random(5)
    keys = {draw.randrange(-(2**62), 2**62) for _ in range(300)}
    keys |= set(range(50)) | {2**16 * i + 3 for i in range(-20, 20)} | {-(2**63), 2**63 - 1}
    df = spark.createDataFrame([(k,) for k in keys], "row_index bigint").repartition(6)
    got = {r.row_index: r.p for r in with_position(df, "row_index", "p").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_config_profiles():
    assert BATCH == LedgerConfig()

"""Lines that many documents share, found with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from tallyloom.functions.values import named
from tallyloom.llm.words import BLANKS, LOWER, fresh, lean_slices
from tallyloom.sources.staging import shared_folder, stage

FANOUT = 3
BATCHES = 4
ASCII_LOWER = bytes(LOWER.tolist())


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the stripped, ASCII-lower-cased line; None for fewer code points."""
    line = line.strip(BLANKS)
    if len(line) < min_chars:
        return None
    if not line.isascii() and len(line.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line.translate(ASCII_LOWER))


class LineRuns:
    """Levelled runs of ``key, n, keeper, brings``: line hash, documents, the one that keeps it.

    Every run is a table bucketed and sorted by the key. A new batch is aggregated, merge-joined
    with the runs, whose buckets are not shuffled again, and added as a run of its own: keys that
    no run has (the anti-join) bring their keeper, known keys only their count. ``FANOUT`` runs
    of one level are merged into one of the next, so there are few runs at any time and a key is
    rewritten once per level. Batches must come in descending order of document.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{shared_folder(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, "key")
            .write.bucketBy(self.buckets, "key")
            .sortBy("key")
            .option("path", f"{self.folder}/{name}")
            .saveAsTable(name)
        )
        self.tables.append(name)
        return name

    def _all(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Add a batch of ``key, n, keeper`` with one row per key."""
        fresh = F.lit(True)
        for i, name in enumerate(self._all()):
            run = self.spark.table(name).where("brings").select(F.col("key").alias(f"_k{i}"))
            batch = batch.join(run, F.col("key") == F.col(f"_k{i}"), "left")
            fresh = fresh & F.col(f"_k{i}").isNull()
        keeper = F.when(fresh, F.col("keeper")).alias("keeper")
        batch = batch.select("key", "n", keeper, fresh.alias("brings"))
        self._put(0, self._write(batch))

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            merged = self._write(self._merge(self.levels[level]))
            self.levels[level] = []
            self._put(level + 1, merged)

    def _merge(self, names: list[str]) -> DataFrame:
        """The runs as one, by outer merge joins of their buckets: no run is shuffled."""

        def both(left: DataFrame, right: DataFrame) -> DataFrame:
            right = right.select("key", *[F.col(c).alias(f"_{c}") for c in ("n", "keeper", "brings")])
            return left.join(right, "key", "full_outer").select(
                "key",
                (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"),
                F.coalesce("keeper", "_keeper").alias("keeper"),
                (F.coalesce("brings", F.lit(False)) | F.coalesce("_brings", F.lit(False))).alias("brings"),
            )

        return reduce(both, [self.spark.table(n).select("key", "n", "keeper", "brings") for n in names])

    def keys(self) -> DataFrame:
        """All runs merged: ``key, n, keeper``."""
        return self._merge(self._all()).select("key", "n", "keeper")

    def close(self) -> None:
        """Forget the run tables; their files stay in the shared folder until it is cleaned."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _line_rows(min_chars: int, kind: str):
    def run(batches):
        for batch in lean_slices(batches, "_text"):
            ids, keys = [], []
            for i, text in enumerate(batch["_text"].to_pylist()):
                found = {line_key(line, min_chars) for line in (text or "").encode().split(b"\n")} - {None}
                ids += [i] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([batch["_doc"].take(pa.array(ids, pa.int64())), pa.array(keys, pa.binary())], ["_doc", "key"])

    return run, f"_doc {kind}, key binary"


def _document(key: str, text: str) -> Column:
    """What tells documents apart and orders them: the key, or the text's hash where there is none."""
    own = F.col(key)
    return F.struct(own.alias("key"), F.when(own.isNull(), F.xxhash64(F.coalesce(F.col(text), F.lit("")))).alias("hash"))


def shared_lines(
    docs: DataFrame, key: str, text: str, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES
) -> DataFrame:
    """``_doc, _drop``: for every document that loses lines, the hashes of those lines.

    A line of at least ``min_chars`` code points in at least ``min_docs`` documents stays only in
    the largest document that holds it. Documents enter in ``batches`` ranges of their key, of any
    type that can be ordered, largest first; the lines are written by range, so a batch reads its own.
    Lines are counted once per document and combined before the shuffle, so a line that every
    document has is one row per task.
    """
    spark = docs.sparkSession
    rows = docs.select(_document(key, text).alias("_doc"), F.col(text).cast("string").alias("_text"))
    run, schema = _line_rows(min_chars, rows.schema["_doc"].dataType.simpleString())
    # One line per document and key, even where a document's row is repeated.
    lines = rows.mapInArrow(run, schema).distinct()
    ranges = batches * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // batches)
    dealt = lines.repartitionByRange(ranges, F.desc("_doc"))
    path = f"{shared_folder(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    dealt.withColumn("_batch", F.expr(f"spark_partition_id() * {batches} div {ranges}").cast("int")).write.partitionBy("_batch").parquet(path)
    lines = spark.read.schema(dealt.schema.add("_batch", IntegerType())).parquet(path)
    runs = LineRuns(spark)
    for number in range(batches):
        own = lines.where(F.col("_batch") == number).groupBy("key")
        runs.add(own.agg(F.count(F.lit(1)).alias("n"), F.max("_doc").alias("keeper")))
    popular = stage(runs.keys().where(F.col("n") >= min_docs).select(F.col("key").alias("_key"), "keeper"))
    runs.close()
    going = lines.join(popular, F.col("key") == F.col("_key")).where(~F.col("_doc").eqNullSafe(F.col("keeper")))
    return going.groupBy("_doc").agg(F.collect_list("key").alias("_drop"))


def _drop_rows(text: str, drop: str, counts: tuple[str, str], min_chars: int):
    def run(batches):
        for batch in lean_slices(batches, text):
            kept, total, dropped = [], [], []
            for value, gone in zip(batch[text].to_pylist(), batch[drop].to_pylist()):
                lines = (value or "").encode().split(b"\n")
                total.append(len(lines))
                if gone:
                    gone = set(gone)
                    stay = [line for line in lines if line_key(line, min_chars) not in gone]
                    dropped.append(len(lines) - len(stay))
                    value = b"\n".join(stay).decode()
                else:
                    dropped.append(0)
                kept.append(value)
            columns = {n: batch[n] for n in batch.schema.names if n != drop}
            columns[text] = pa.array(kept, batch.schema.field(text).type)
            columns |= {counts[0]: pa.array(total, pa.int64()), counts[1]: pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def drop_shared_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    counts: tuple[str, str] = ("_n_lines", "_n_dropped"),
) -> DataFrame:
    """``docs`` without the lines that many documents share, plus the number of lines and of dropped ones.

    A null text stays null and counts as one empty line; a text whose lines all go becomes empty. Rows
    with a null key are a document for each text, smaller than any with a key. A repeated row loses
    the same lines each time. Other columns pass through whatever their names; a column named like
    one of ``counts`` is replaced by it.
    """
    docs = docs.drop(*counts)
    gone = shared_lines(docs, key, text, min_chars, min_docs)
    doc, drop = fresh("doc"), fresh("drop")
    gone = gone.withColumnsRenamed({"_doc": doc, "_drop": drop})
    # The other columns travel in one struct, so no name of theirs is met on the way.
    body, rest = fresh("body"), fresh("rest")
    others = [f for f in docs.schema if f.name != text]
    joined = docs.join(gone, _document(key, text).eqNullSafe(F.col(doc)), "left").select(
        F.col(text).cast("string").alias(body), F.struct(*named(f.name for f in others)).alias(rest), drop
    )
    schema = joined.drop(drop).schema
    for name in counts:
        schema = schema.add(name, LongType())
    out = joined.mapInArrow(_drop_rows(body, drop, counts, min_chars), schema)
    columns = [F.col(body).alias(f.name) if f.name == text else F.col(rest).getField(f.name).alias(f.name) for f in docs.schema]
    return out.select(*columns, *counts)

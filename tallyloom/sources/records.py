"""CSV records from text lines: quoted fields may go on over lines and over input splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.values import named
from tallyloom.sources.staging import stage

SPLIT = ("_file", "_split")
# Whole quoted fields of a line, and what ends a field that was open before the line.
QUOTED = r'(^|,)"[^"]*+(?:""[^"]*+)*+"(?=,|$)'
CLOSING = r'^[^"]*+(?:""[^"]*+)*+"(?=,|$)'
# Input splits smaller than this share a task, as far as every core still has some tasks.
TASK_BYTES, TASKS_PER_CORE = 64 << 20, 4


def _left_open(text: Column) -> Column:
    """Whether a line that starts outside of quotes ends inside; a quote in mid-field is text."""
    return F.regexp_replace(text, QUOTED, "$1").rlike('(^|,)"')


def _shared_tasks(lines: DataFrame, path: str) -> DataFrame:
    """``lines`` of the text at ``path``, where small input splits are read several to a task.

    A task per split, and a written file per task, cost more than a small split itself. The number of
    tasks still grows with the bytes.
    """
    spark = lines.sparkSession
    n, least = lines.rdd.getNumPartitions(), TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    if n <= least:
        return lines
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("size")).first()["size"]
    tasks = max(least, -(-size // TASK_BYTES))
    return lines.coalesce(tasks) if tasks < n else lines


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """``_file, _split, _id, value, _opens, _closes``: the lines, written, from one scan of the text.

    What a line does to the quote state, inside or outside of a field, is one of four functions: a
    line that only opens ends inside, one that only closes ends outside, one that would do either
    turns the state over, and any other leaves it. ``_id`` is in file order within a split.
    """
    value = F.col("value")
    rest = F.regexp_replace(value, CLOSING, "")
    quotes = value.contains('"')
    flags = {"_opens": quotes & _left_open(value), "_closes": quotes & value.rlike(CLOSING) & ~_left_open(rest)}
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split")]
    lines = _shared_tasks(spark.read.text(path).select("value", *place), path).withColumn("_id", F.monotonically_increasing_id())
    return stage(lines.withColumns(flags))


def _before(rows: DataFrame, by: list[str], order: str, settles: Column, turns: Column, start: Column) -> Column:
    """The quote state before each row of an ordered group, given the one before the group.

    Rows either settle the state (a boolean, else NULL) or may turn it over: the state is that of
    the last row that settled it, turned over as often as rows after it do.
    """
    along = Window.partitionBy(*by).orderBy(order)
    turned = F.sum(turns.cast("bigint")).over(along)
    known = F.when(settles.isNotNull(), F.struct(settles.alias("state"), F.col("_turned").alias("turned")))
    earlier = F.last("_known", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    base = F.coalesce(F.col("_earlier.state"), start)
    odd = (F.col("_turned") - turns.cast("bigint") - F.coalesce(F.col("_earlier.turned"), F.lit(0))) % 2 == 1
    staged = rows.withColumn("_turned", turned).withColumn("_known", known).withColumn("_earlier", earlier)
    return staged.withColumn("_inside", base != odd).drop("_turned", "_known", "_earlier")


def _split_states(lines: DataFrame) -> DataFrame:
    """``_file, _split, _inside, _ends, _opening``: the state at both ends of each split, a row per split.

    A prefix scan: a split acts on the state as its last settling line and the turning ones after it.
    """
    opens, closes = F.col("_opens"), F.col("_closes")
    last = lines.where(opens != closes).groupBy(*SPLIT).agg(F.max(F.struct("_id", "_opens")).alias("_last"))
    turning = lines.where(opens & closes).join(last, list(SPLIT), "left").where("_last is null or _id > _last._id")
    turns = turning.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("_n"))
    splits = lines.groupBy(*SPLIT).agg(F.count_if("_opens").alias("_opening"))
    splits = splits.join(last, list(SPLIT), "left").join(turns, list(SPLIT), "left")
    odd = F.coalesce(F.col("_n"), F.lit(0)) % 2 == 1
    splits = splits.select(*SPLIT, "_opening", (F.col("_last._opens") != odd).alias("_settles"), odd.alias("_odd"))
    turned = F.col("_settles").isNull() & F.col("_odd")
    states = _before(splits, ["_file"], "_split", F.col("_settles"), turned, F.lit(False))
    return states.withColumn("_ends", F.coalesce("_settles", F.col("_inside") != F.col("_odd"))).drop("_settles", "_odd")


def csv_records(lines: DataFrame) -> DataFrame | None:
    """``_file, _split, _id, value``: a row per record, or None if every line is a record.

    Splits that start outside of quotes and have no line that opens any are left as they are. In
    the others, lines are numbered by the record they belong to, a window over one split. A record
    that goes on over splits belongs to the last split before that has a record's start. The lines of
    a record are put together with line feeds between them. An open quote at the end of a file is
    an error, so that it never takes the rest of a ledger into one field unseen.
    """
    if not lines.where("_opens").limit(1).count():
        return None
    splits = stage(_split_states(lines))
    last = splits.groupBy("_file").agg(F.max_by("_ends", "_split").alias("_ends")).where("_ends").first()
    if last is not None:
        raise ValueError(f"open quote at the end of {last['_file']}")
    noisy = splits.where((F.col("_opening") > 0) | F.col("_inside"))
    plain = lines.join(noisy, list(SPLIT), "left_anti").select(*SPLIT, "_id", "value")
    start = noisy.select(*SPLIT, F.col("_inside").alias("_start"))
    settles = F.when(F.col("_opens") != F.col("_closes"), F.col("_opens"))
    inner = _before(lines.join(start, list(SPLIT)), list(SPLIT), "_id", settles, F.col("_opens") & F.col("_closes"), F.col("_start"))
    number = F.sum(F.when(F.col("_inside"), 0).otherwise(1)).over(Window.partitionBy(*SPLIT).orderBy("_id"))
    inner = stage(inner.select(*SPLIT, "_id", "value", number.alias("_record")))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    began = F.last(F.when(F.col("_n") > 0, F.struct(F.col("_split").alias("split"), F.col("_n").alias("record"))), ignorenulls=True)
    owners = inner.groupBy(*SPLIT).agg(F.max("_record").alias("_n")).select(*SPLIT, began.over(before).alias("_owner"))
    goes_on = F.col("_record") == 0
    owned = inner.join(owners, list(SPLIT)).withColumns(
        {
            "_in": F.when(goes_on, F.col("_owner.split")).otherwise(F.col("_split")),
            "_record": F.when(goes_on, F.col("_owner.record")).otherwise(F.col("_record")),
        }
    )
    parts = F.sort_array(F.collect_list(F.struct("_split", "_id", "value")))
    whole = owned.groupBy("_file", "_in", "_record").agg(parts.alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda p: p["value"]), "\n")
    put = whole.select("_file", F.col("_parts")[0]["_split"].alias("_split"), F.col("_parts")[0]["_id"].alias("_id"), text.alias("value"))
    return plain.unionByName(put)


def parse_records(records: DataFrame, header, broken: str) -> DataFrame:
    """``records`` with their fields by the header's names, the text of misfits, and ``_is_header``."""
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}
    kinds = ", ".join(f"{n} string" for n in [*(f"_{i}" for i in range(len(header.names))), broken])
    fields = F.from_csv("value", kinds, options)
    parsed = records.where("trim(value) <> ''").withColumn("_fields", fields)
    columns = [F.col(f"_fields._{i}").alias(name) for i, name in enumerate(header.names)]
    same = F.lit(True)
    for i, name in enumerate(header.names):
        same = same & F.coalesce(F.col(f"_fields._{i}"), F.lit("")).eqNullSafe(F.lit(name))
    return parsed.select(*SPLIT, "_id", *columns, F.col(f"_fields.{broken}").alias(broken), same.alias("_is_header"))


def number_records(rows: DataFrame, columns: list[str], out: str, in_scan_order: bool) -> DataFrame:
    """``columns`` with the 0-based number of each row, over files by name; first rows of files are headers.

    Rows that are still in scan order need no sort: they are written with their place in the
    partition, and a count per split and partition gives where each begins. Rows of assembled
    records are written, so that they are not put together again to find ranges, and dealt by ranges
    of file, split and line.
    """
    if not in_scan_order:
        rows = stage(rows).repartitionByRange("_file", "_split", "_id").sortWithinPartitions("_file", "_split", "_id")
    rows = stage(rows.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    by = [*SPLIT, "_part"]
    in_order = Window.orderBy("_file", "_split", "_least")
    in_file = Window.partitionBy("_file").orderBy("_split", "_least")
    pieces = rows.groupBy(*by).agg(F.min("_id").alias("_least"), F.min("_place").alias("_from"), F.count(F.lit(1)).alias("_n"))
    pieces = pieces.select(
        *[F.col(c).alias(f"{c}_of") for c in by],
        (F.sum("_n").over(in_order) - F.col("_n") - F.col("_from")).alias("_shift"),
        (F.sum("_n").over(in_file) - F.col("_n") - F.col("_from")).alias("_in_file"),
        F.dense_rank().over(Window.orderBy("_file")).alias("_files"),
    )
    # Written, so that the optimizer knows its bytes and broadcasts it only if they are few.
    same = [F.col(c) == F.col(f"{c}_of") for c in by]
    placed = rows.join(stage(pieces), same)
    first = F.col("_place") + F.col("_in_file") == 0
    refused = F.raise_error(F.concat(F.lit("another header than the first file's in "), F.col("_file"))).cast("boolean")
    kept = placed.where(F.when(first & ~F.col("_is_header"), refused).otherwise(~first))
    return kept.select((F.col("_place") + F.col("_shift") - F.col("_files")).alias(out), *named(columns))

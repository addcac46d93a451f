"""Phrase collocations, mined by partitioning: shards first, then one exact count of all candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.bitmaps import Bits, bitmap
from tallyloom.llm.words import BASE, LOWER, mix, slices, words
from tallyloom.sources.staging import stage

BREAKS = b".,;:!?\n\x0b\x0c\r"
INSIDE = np.array([b not in BREAKS + b"\x20\x09" for b in range(256)])
IS_BREAK = np.array([b in BREAKS for b in range(256)])
# Bytes of text that a task reads into words at a time.
SLICE = 1 << 18
SHARDS = 10
# Words that a task holds at a time to mine, to count words, to spell phrases with their bytes, and to
# hash, look up or count in a span: whatever takes more than the words themselves is made for a span.
RUN_WORDS, COUNTED_WORDS, SPELLED_WORDS, RANGE_WORDS = 3_000_000, 1_500_000, 600_000, 1 << 18
# Bits of the filters sent to the tasks: a fixed size, whatever the number of words or phrases.
WORD_BITS, PHRASE_BITS = 1 << 24, 1 << 26
# Numbers that tell apart the texts a phrase may be spelled from; they must fit in 16 bits.
PLACES = 1 << 16
# Where a place meets the bits of a hash, and which bits of the hash the bitmaps of its owners take.
PLACE_SHIFT, OWNER_SHIFTS = 10, (0, 26)


# --- runs of words ------------------------------------------------------------------------


@dataclass
class Words:
    """The words of some texts end to end.

    ``hashes`` tell words of different languages apart; ``joined`` says whether a word and the
    one before it stand in the same piece; ``lang`` numbers the entries of ``langs``. ``place`` is a
    number below ``PLACES`` taken from the bytes of the text a word stands in, so equal texts have equal
    places in every pass, however the table is split. The bytes are kept only where phrases are to be
    spelled.
    """

    langs: list[str]
    lang: np.ndarray
    hashes: np.ndarray
    joined: np.ndarray
    place: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def lang_names(self, at: np.ndarray) -> pa.Array:
        return pa.array(self.langs, pa.string()).take(pa.array(self.lang[at]))

    def texts(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of ``k`` words that start at ``at``, lower-cased and joined by spaces."""
        words_at = (at[:, None] + np.arange(k)).ravel()
        size = self.ends[words_at] - self.starts[words_at] + 1
        size[k - 1 :: k] -= 1
        to = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(to[-1]) - np.repeat(to[:-1] - self.starts[words_at], size)
        data = self.data[np.minimum(place, len(self.data) - 1)]
        spaces = to[1:] - 1
        data[np.delete(spaces, np.s_[k - 1 :: k])] = 0x20
        offsets = np.ascontiguousarray(to[::k]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _pieces(body: bytes) -> Iterator[bytes]:
    """A text in runs of about ``SLICE`` bytes, cut only where a piece ends.

    A text without any such place is one run.
    """
    at = 0
    while len(body) - at > SLICE:
        cut = max(body.rfind(bytes([b]), at, at + SLICE) for b in BREAKS)
        if cut < 0:
            later = [p for b in BREAKS if (p := body.find(bytes([b]), at + SLICE)) >= 0]
            cut = min(later, default=len(body) - 1)
        yield body[at : cut + 1]
        at = cut + 1
    yield body[at:]


def _read_words(runs: list[bytes]):
    raw = np.frombuffer(b"".join(runs), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    starts, ends, rows, hashes = words(raw, offsets, INSIDE, 2 * SLICE)
    breaks = np.concatenate([[0], np.cumsum(IS_BREAK[raw])])[starts]
    joined = np.zeros(len(starts), dtype=bool)
    joined[1:] = (breaks[1:] == breaks[:-1]) & (rows[1:] == rows[:-1])
    return LOWER[raw], starts, ends, rows, hashes, joined


def word_runs(batches: Iterator[pa.RecordBatch], size: int, spelled: bool = False) -> Iterator[Words]:
    """Arrow batches of ``_lang, _text`` in runs of about ``size`` words, with their bytes if ``spelled``."""
    langs: dict[str, int] = {}
    seeds, parts, at, n = [], [], 0, 0

    def read(runs, owners):
        nonlocal at, n
        data, starts, ends, rows, hashes, joined = _read_words(runs)
        lang = np.array(owners, dtype=np.int32)[rows]
        hashes = hashes ^ np.array(seeds, dtype=np.uint64)[lang] if len(lang) else hashes
        place = np.array([xxhash.xxh64_intdigest(r) % PLACES for r in runs], dtype=np.uint16)[rows]
        if not spelled:
            data, starts, ends = (np.zeros(0, dtype=x.dtype) for x in (data, starts, ends))
        parts.append((lang, hashes, joined, place, data, starts + at, ends + at))
        at, n = at + len(data), n + len(hashes)

    def close():
        nonlocal parts, at, n
        columns = list(zip(*parts))
        parts, at, n = [], 0, 0
        return Words(list(langs), *[np.concatenate(columns.pop(0)) for _ in range(7)])

    runs, owners, held = [], [], 0
    for batch in (part for whole in batches for part in slices(whole, "_text")):
        for lang, text in zip(batch["_lang"].to_pylist(), batch["_text"].to_pylist()):
            if lang not in langs:
                langs[lang] = len(langs)
                seeds.append(xxhash.xxh64_intdigest(lang.encode()))
            for run in _pieces((text or "").encode()):
                if runs and held + len(run) > SLICE:
                    read(runs, owners)
                    runs, owners, held = [], [], 0
                    if n >= size:
                        yield close()
                runs.append(run)
                owners.append(langs[lang])
                held += len(run)
    if runs:
        read(runs, owners)
    if parts:
        yield close()


# --- phrases of a run -----------------------------------------------------------------------

Keep = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def _spans(n: int) -> Iterator[slice]:
    for a in range(0, n, RANGE_WORDS):
        yield slice(a, a + RANGE_WORDS)


def levels(held: Words, most: int, keep: Keep) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For ``k`` = 1 to ``most``, the places and hashes of the phrases that ``keep`` keeps.

    ``keep(k, places, hashes)`` is a mask, asked for a span of the places at a time. A phrase is looked
    at only if both phrases one word shorter inside it were kept, which holds for every phrase as
    frequent as they have to be. Let go of what is yielded before the next: it is as large as the words.
    """
    at, value = np.arange(len(held.hashes), dtype=np.int32), held.hashes
    for k in range(1, most + 1):
        mask = np.zeros(len(at), dtype=bool)
        for some in _spans(len(at)):
            mask[some] = keep(k, at[some], value[some])
        at = at[mask]
        value = value[mask]
        if not len(at):
            return
        yield k, at, value
        kept = np.zeros(len(held.hashes) + 1, dtype=bool)
        kept[at] = True
        if k == 1:
            kept[:-1] &= held.joined
        more = kept[1:][at]
        at = at[more]
        value = value[more]
        for some in _spans(len(at)):
            value[some] = mix(value[some] * np.uint64(BASE) + held.hashes[at[some] + k])


def _ranges(values: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the values, in ranges of the values' low bits, so that a range is counted in little memory."""
    n = min(max(1, -(-len(values) // RANGE_WORDS)), 1 << 16)
    part = np.zeros(len(values), dtype=np.uint16)
    for some in _spans(len(values)):
        part[some] = (values[some] & np.uint64(0xFFFF)) * np.uint64(n) >> np.uint64(16)
    for i in range(n):
        yield np.flatnonzero(part == i)


def counted(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In ranges: a place of each distinct value, and how often it occurs."""
    for some in _ranges(values):
        codes, distinct = pd.factorize(values[some])
        place = np.zeros(len(distinct), dtype=np.int64)
        place[codes] = some
        yield place, np.bincount(codes, minlength=len(distinct))


def local_support(support: int, shards: int) -> int:
    """How often a phrase must occur in a shard to count as frequent there: its share of the support.

    A phrase that reaches the support overall has its share in some shard, whatever their sizes:
    less everywhere would add up to less than the support.
    """
    return -(-support // shards)


# --- passes over the table ------------------------------------------------------------------


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"), F.col(text).cast("string").alias("_text"))


def _word_counts(texts: DataFrame, size: int) -> DataFrame:
    """``lang, h, f, place``: the words of every run with their counts and a place there."""

    def run(batches):
        for held in word_runs(batches, size):
            for some, n in counted(held.hashes):
                langs = held.lang_names(some)
                columns = [langs, pa.array(held.hashes[some].view(np.int64)), pa.array(n), pa.array(held.place[some].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "h", "f", "place"])
            del held

    return texts.mapInArrow(run, "lang string, h bigint, f bigint, place int")


def _locally_frequent(texts: DataFrame, filters: list[Bits], most: int, support: int, shards: int, size: int) -> DataFrame:
    """``h, f, place``: the phrases that reach the support, among those that reach their share in some shard.

    The shards have counted all their phrases, so the sum over all shards is the exact count of a
    phrase of their union. ``place`` is that of a text that holds the phrase.

    A shard is every ``shards``-th partition of ``texts``. A task counts its part of the shard in the
    runs of words that it holds at a time, and the counts are added up by shard and hash. ``filters``
    keep phrases of one word, two words and so on; the phrases mined are longer, up to ``most`` words.
    """
    known = len(filters)

    def run(batches):
        shard_number = TaskContext.get().partitionId() % shards % PLACES << 16

        def keep(k, at, value):
            return filters[k - 1].has(value) if k <= known else np.ones(len(at), dtype=bool)

        for held in word_runs(batches, size):
            for k, at, value in levels(held, most, keep):
                for some, n in counted(value) if k > known else ():
                    mark = n << 32 | shard_number | held.place[at[some]]
                    yield pa.RecordBatch.from_arrays([pa.array(value[some].view(np.int64)), pa.array(mark)], ["h", "mark"])
                del at, value
            del held

    # Counts are combined in the task already, so they are not combined again before the shuffle. A
    # count, its shard and its place travel as one number, which makes the shuffle smaller.
    marks = texts.mapInArrow(run, "h bigint, mark bigint").repartition("h")
    shard, place = F.shiftright("mark", 16).bitwiseAND(F.lit(0xFFFF)), F.col("mark").bitwiseAND(F.lit(PLACES - 1))
    found = marks.select("h", shard.alias("shard"), F.shiftright("mark", 32).alias("c"), place.cast("int").alias("place"))
    found = found.groupBy("shard", "h").agg(F.sum("c").alias("c"), F.min("place").alias("place"))
    united = found.groupBy("h").agg(F.max("c").alias("most"), F.sum("c").alias("f"), F.min("place").alias("place"))
    reached = (F.col("most") >= local_support(support, shards)) & (F.col("f") >= support)
    return united.where(reached).select("h", "f", "place")


def _owners(phrases: DataFrame) -> list[Bits]:
    """The pairs of a phrase's hash and its place, as two bitmaps of different bits of the hash."""
    place = F.shiftleft(F.col("place").cast("bigint"), PLACE_SHIFT)
    return [bitmap(phrases.select(F.shiftright("h", by).bitwiseXOR(place).alias("h")), "h", PHRASE_BITS) for by in OWNER_SHIFTS]


def _owned(owners: list[Bits], value: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each phrase is to be spelled from the text it stands in; a few more than its own may pass."""
    some, moved = np.arange(len(value)), place.astype(np.uint64) << np.uint64(PLACE_SHIFT)
    for by, bits in zip(OWNER_SHIFTS, owners):
        some = some[bits.has(value[some] >> np.uint64(by) ^ moved[some])]
    return some


def _spelled(texts: DataFrame, candidates: Bits, owners: list[Bits], most: int, size: int) -> DataFrame:
    """``h, lang, k, phrase``: the candidates, each read from the texts at its place.

    A phrase is in many runs, but only those runs spell it that have a text of its place, so the rows
    are about as many as the phrases, whatever the number of runs.
    """

    def run(batches):
        for held in word_runs(batches, size, spelled=True):
            for k, at, value in levels(held, most, lambda k, at, value: candidates.has(value)):
                own = np.concatenate([_owned(owners, value[some], held.place[at[some]]) + some.start for some in _spans(len(at))])
                own = own[np.unique(value[own], return_index=True)[1]]
                for cut in range(0, len(own), 1 << 16):
                    some = own[cut : cut + (1 << 16)]
                    langs, texts_of = held.lang_names(at[some]), held.texts(at[some], k)
                    columns = [pa.array(value[some].view(np.int64)), langs, pa.array(np.full(len(some), k, dtype=np.int32)), texts_of]
                    yield pa.RecordBatch.from_arrays(columns, ["h", "lang", "k", "phrase"])
                del at, value
            del held

    return texts.mapInArrow(run, "h bigint, lang string, k int, phrase string")


def frequent_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    most: int = 5,
    support: int = 100,
    shards: int = SHARDS,
    run_words: int = RUN_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, f`` of all phrases of 1 to ``most`` words that occur ``support`` times, and ``lang, n``.

    Words are counted first, which gives ``n`` of each language. The texts are partitioned in ``shards``
    shards, and each is mined completely at its share of the support: first pairs of frequent words,
    then longer phrases of such pairs. A shard may be larger than a task: tasks hold ``run_words``
    words at a time, and their counts meet by shard and phrase. The number of shards is fixed, so that
    the local support, and the part of all phrases that reach it, do not change with the size of the
    table. The union of what is frequent in some shard holds every phrase that is frequent
    overall; its exact counts are the sums over all shards, each of which has counted all its phrases.
    A last pass spells every phrase that reaches the support, from one of the texts that hold it.

    Words, pairs, candidates and the texts to spell them from reach the tasks as bitmaps of fixed size,
    which can only let in more. Words and phrases are told apart by 64-bit hashes.
    """
    texts = _texts(docs, text, lang)
    once = _word_counts(texts, min(run_words, COUNTED_WORDS)).groupBy("lang", "h").agg(F.sum("f").alias("f"), F.min("place").alias("place"))
    once = stage(once)
    totals = stage(once.groupBy("lang").agg(F.sum("f").alias("n")))
    counts = once.where(F.col("f") >= support).select("h", "f", "place")
    filters = [bitmap(counts, "h", WORD_BITS)]
    for longest in sorted({min(2, most), most} - {1}):
        mined = stage(_locally_frequent(texts, filters, longest, support, shards, run_words))
        filters.append(bitmap(mined, "h", PHRASE_BITS))
        counts = counts.union(mined)
    spelled = _spelled(texts, bitmap(counts, "h", PHRASE_BITS), _owners(counts), most, min(run_words, SPELLED_WORDS))
    # Texts of one place, such as copies, may spell a phrase in several runs.
    spelled = spelled.groupBy("h").agg(F.min(F.struct("lang", "k", "phrase")).alias("_own"))
    found = spelled.join(counts.select("h", "f"), "h").select("_own.lang", "_own.phrase", "_own.k", "f")
    return stage(found), totals


# --- scores ---------------------------------------------------------------------------------


def _run(first: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def _inside(frequent: DataFrame, shortest: int) -> DataFrame:
    """``_lang, _phrase, _longer``: the phrases inside longer ones, with the largest count of such a longer one."""
    rows = frequent.where(F.col("k") > shortest).withColumn("words", F.split("phrase", " "))
    sizes = F.explode(F.sequence(F.lit(shortest), F.col("k") - 1))
    spans = rows.select("lang", "words", "k", "f", sizes.alias("size"))
    spans = spans.select("lang", "words", "size", "f", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    inner = spans.select(F.col("lang").alias("_lang"), _run(F.col("at"), F.col("size")).alias("_phrase"), "f")
    return inner.groupBy("_lang", "_phrase").agg(F.max("f").alias("_longer"))


def mine_collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 5, support: int = 100, top: int = 2000, shards: int = SHARDS, run_words: int = RUN_WORDS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` collocations of 2 to ``most`` words.

    ``a`` is the count of the phrase, ``l`` and ``r`` of the two parts of its lowest-scoring cut, ``n``
    the words of the language. The score is ``floor(1000 a n / (l r))``, computed in decimals. A phrase
    goes if a longer one that holds it occurs as often. Parts of a frequent phrase are at least as
    frequent, so all counts are in the table of frequent phrases; parts are looked up by joins.

    A null text has no words, a null language is ``und``. Repeated rows count each time; other
    columns are ignored whatever their names. An empty table has an empty result.
    """
    frequent, totals = frequent_phrases(docs, text, lang, most, support, shards, run_words)
    own = frequent.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = own.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", _run(F.lit(1), F.col("cut")).alias("left"), _run(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right")
    )
    for part, name in (("left", "l"), ("right", "r")):
        counts = frequent.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(name))
        cuts = cuts.join(counts, (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_part"))).drop("_lang", "_part")
    cuts = cuts.join(totals.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang")).drop("_lang")
    # 19 digits each: the products stay exact in 38.
    big = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    over = (big["a"] * big["n"] * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")
    under = (big["l"] * big["r"]).cast("decimal(38,0)")
    cuts = cuts.withColumns({"_over": over, "_under": under}).withColumn("score", F.expr("_over div _under"))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("low")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest)
    held = _inside(frequent.where("k > 1"), 2)
    alone = scored.join(held, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left").where(
        "_longer is null or _longer < a"
    )
    rows = alone.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    # A language may hold most phrases: the first of each salted part go on, then the first of all.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).where(F.col("_place") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

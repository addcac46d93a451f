"""Fingerprints by a randomised embedding of edit distance into Hamming distance."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bitmaps import bitmap
from tallyloom.llm.components import components
from tallyloom.llm.gaps import SHORT, bytes_apart, cut, together, uncut
from tallyloom.llm.near_dedup import SHARD, search_shards
from tallyloom.llm.words import mix, slices
from tallyloom.sources.staging import stage

BITS, LETTERS, PERIOD = 256, 64, 1024
RADIUS = 26
BLOCK = 128
MISSED, SPARE_BITS = 0.001, 4
KEY_BITS = 1 << 27
KEYS_A_PART, KEYS_AT_ONCE = 1 << 20, 1 << 22
NAMES = ["n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]


@lru_cache(maxsize=1)
def _walk() -> list[list[int]]:
    """For each letter class and step, the step after the walk next leaves a letter of the class.

    The walk stays on a letter or moves on by a shared random bit per step and letter class; the
    bits repeat after ``PERIOD`` steps.
    """
    bits = np.random.default_rng(42).integers(0, 2, (LETTERS, PERIOD))
    bits[:, 0] = 1
    out = []
    for row in bits:
        at, nxt = PERIOD, [0] * PERIOD
        for step in range(PERIOD - 1, -1, -1):
            at = step if row[step] else at
            nxt[step] = (at + 1) % PERIOD
        out.append(nxt)
    return out


class Walk:
    """The random walk over a text: where each letter is met, and the fingerprint's counters.

    Two texts that differ by few edits meet their common letters at the same steps soon after
    each edit, so few counters change.
    """

    def __init__(self):
        self.at, self.total, self.counters = 0, 0, np.zeros(BITS, dtype=np.int64)

    def copy(self) -> Walk:
        new = Walk()
        new.at, new.total, new.counters = self.at, self.total, self.counters.copy()
        return new

    def read(self, text: str) -> Walk:
        """Go on over ``text``, a part at a time so that a huge text is never in memory as numbers."""
        rows = _walk()
        for start in range(0, len(text), 1 << 18):
            points = np.frombuffer(text[start : start + (1 << 18)].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            letters = (mix(points.astype(np.uint64)) % np.uint64(LETTERS)).astype(np.int64)
            at, met = self.at, []
            for row in map(rows.__getitem__, letters.tolist()):
                met.append(at)
                at = row[at]
            steps = np.array([*met, at])
            stay = np.diff(steps) % PERIOD
            stay[stay == 0] = PERIOD
            step = self.total + np.concatenate([[0], np.cumsum(stay)])
            voted = mix((step[:-1] * LETTERS + letters).astype(np.uint64)) & np.uint64(2 * BITS - 1)
            votes = np.bincount(voted.astype(np.int64), minlength=2 * BITS)
            self.counters += votes[:BITS] - votes[BITS:]
            self.at, self.total = at, int(step[-1])
        return self

    def print(self) -> bytes:
        return np.packbits(self.counters > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: the share of the walk two fingerprints have in common, from their equal bits."""
    differing = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return max(0.0, math.cos(math.pi * differing / BITS))


def edit_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp`` of every document; equal texts have equal fingerprints, a null text is empty."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            prints = [Walk().read(t or "").print() for t in batch["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["_key"], pa.array(prints, pa.binary())], ["_key", "fp"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, fp binary").withColumnRenamed("_key", key)


class Neighbours:
    """The members of a shard as arrays, with the component of each.

    A block of rows is compared with all members at once; a row is linked to one near member of
    every component, so a dense group costs a link per row, not one per pair.
    """

    def __init__(self, radius: int):
        self.radius, self.n = radius, 0
        self.words, self.label = np.zeros((BITS // 64, BLOCK), dtype=np.uint64), np.zeros(BLOCK, dtype=np.int64)

    def _append(self, rows: np.ndarray) -> None:
        end = self.n + len(rows)
        if end > len(self.label):
            more = max(end, 2 * len(self.label)) - len(self.label)
            self.words, self.label = np.pad(self.words, ((0, 0), (0, more))), np.pad(self.label, (0, more))
        self.words[:, self.n : end], self.label[self.n : end] = rows.T, np.arange(self.n, end)
        self.n = end

    def meet(self, rows: np.ndarray, members: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of members and of ``rows`` that are linked; the first ``members`` rows become members."""
        first = self.n
        self._append(rows[:members])
        apart = np.zeros((len(rows), self.n), dtype=np.uint16)
        for word, column in zip(self.words[:, : self.n], rows.T):
            apart += np.bitwise_count(column[:, None] ^ word)
        row, near = np.nonzero(apart <= self.radius)
        earlier = (row >= members) | (near < first + row)
        row, near = row[earlier], near[earlier]
        left, right = [], []
        edges = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            labels, some = np.unique(self.label[near[a:b]], return_index=True)
            left += near[a:b][some].tolist()
            right += [row[a]] * len(some)
            if row[a] < members:
                self.label[first + row[a]] = labels[0]
                if len(labels) > 1:
                    known = self.label[: self.n]
                    known[np.isin(known, labels)] = labels[0]
        return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _near_links(radius: int):
    """Rows sorted by shard, members before visitors, to the links found in each shard."""

    def run(batches):
        current, group = None, Neighbours(radius)
        for batch in batches:
            shard, part = (batch[c].to_numpy() for c in ("shard", "part"))
            visits = batch["visits"].to_numpy(zero_copy_only=False)
            rows = np.frombuffer(b"".join(batch["fp"].to_pylist()), dtype=np.uint64).reshape(len(batch), -1)
            n = len(batch)
            change = np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1
            left, right = [], []
            edges = [0, *change.tolist(), n]
            for a, b in zip(edges, edges[1:]):
                # A row alone in its shard has nothing to meet; the first and last may go on.
                if b - a == 1 and 0 < a and b < n:
                    continue
                if (shard[a], part[a]) != current:
                    current, group = (shard[a], part[a]), Neighbours(radius)
                for at in range(a, b, BLOCK):
                    some = rows[at : min(at + BLOCK, b)]
                    members = int(np.count_nonzero(~visits[at : at + len(some)]))
                    one, other = group.meet(some, members)
                    if len(one):
                        left += [w.tobytes() for w in group.words[:, one].T]
                        right += [w.tobytes() for w in some[other]]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return run


def sampled_bands(prints: int, radius: int = RADIUS) -> list[np.ndarray]:
    """Places of the bits of each band, for a number of fingerprints.

    A band has ``SPARE_BITS`` bits more than are needed to number the fingerprints, so that few meet by
    chance at any size. There are as many bands as make all of them differ for at most ``MISSED`` of
    the pairs at the radius, and for fewer of nearer ones.
    """
    width = min(max(prints, 2).bit_length() + SPARE_BITS, 48)
    meet = math.prod((BITS - radius - i) / (BITS - i) for i in range(width))
    bands = math.ceil(math.log(MISSED) / math.log1p(-meet))
    rng = np.random.default_rng(7)
    return [rng.choice(BITS, width, replace=False) for _ in range(bands)]


def _band_keys(prints: pa.Array, bands: list[np.ndarray]) -> np.ndarray:
    """The key of every fingerprint in every band, a number of ``SHORT`` bits."""
    raw = np.frombuffer(b"".join(prints.to_pylist()), dtype=np.uint8).reshape(len(prints), -1)
    bits = np.unpackbits(raw, axis=1).astype(np.uint64)
    keys = np.empty((len(prints), len(bands)), dtype=np.int64)
    for i, band in enumerate(bands):
        value = (bits[:, band] << np.arange(len(band), dtype=np.uint64)).sum(axis=1)
        keys[:, i] = mix(value * np.uint64(len(bands)) + np.uint64(i)) >> np.uint64(64 - SHORT)
    return keys


def _key_counts(bands: list[np.ndarray], parts: int):
    """Prints to ``part, keys, counts``: the distinct band keys of many prints, as gaps in ascending order."""

    def packed(found: list[np.ndarray]):
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        rows = [(part, gaps, bytes_apart(counts[at])) for part, at, gaps in cut(keys, parts)]
        kinds = zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in kinds], ["part", "keys", "counts"])

    def run(batches):
        found, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), 4096):
                found.append(_band_keys(batch["fp"].slice(at, 4096), bands).ravel())
                n += len(found[-1])
                if n >= KEYS_AT_ONCE:
                    yield packed(found)
                    found, n = [], 0
        if n:
            yield packed(found)

    return run


def _repeated(parts: int):
    """Rows of ``_key_counts`` sorted by part to ``shard, n`` of the keys that occur more than once."""

    def summed(keys: list[np.ndarray], counts: list[np.ndarray]):
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[n > 1]), pa.array(n[n > 1])], ["shard", "n"])

    def run(batches):
        current, keys, counts = None, [], []
        for batch in batches:
            for part, gaps, times in zip(*(batch[c].to_pylist() for c in ("part", "keys", "counts"))):
                if part != current and keys:
                    yield summed(keys, counts)
                    keys, counts = [], []
                current = part
                keys.append(uncut(gaps, part, parts))
                counts.append(together(times))
        if keys:
            yield summed(keys, counts)

    return run


def repeated_keys(prints: DataFrame, bands: list[np.ndarray], count: int) -> DataFrame:
    """``shard, n``: the band keys that occur in two or more of ``count`` fingerprints.

    Keys are counted where they are made, then travel in order as the gaps between them, three to
    four bytes each where a row of a key and its count takes three times as many. Parts are ranges of
    keys, as many as make about ``KEYS_A_PART`` keys each; a key of any frequency is one entry.
    """
    parts = max(1, count * len(bands) // KEYS_A_PART)
    sent = prints.select("fp").mapInArrow(_key_counts(bands, parts), "part bigint, keys binary, counts binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(_repeated(parts), "shard bigint, n bigint")


def edit_links(prints: DataFrame, radius: int = RADIUS, shard_size: int = SHARD) -> DataFrame:
    """Links ``a, b`` between fingerprints of a written table with distinct ``fp``, one row each.

    Fingerprints meet where one of a number of bands of sampled bits is equal, and are verified by all
    their bits (see ``sampled_bands`` for what that misses). Band keys are counted first, without
    fingerprints; only keys that occur twice, as a bitmap of fixed size, take fingerprints along. See
    ``near_dedup.link`` for what a large band does.
    """
    count = prints.count()
    bands = sampled_bands(count, radius)
    counted = stage(repeated_keys(prints, bands, count))
    large = stage(counted.where(F.col("n") > shard_size))
    shared = bitmap(counted, "shard", KEY_BITS)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = batch.slice(at, 4096)
                found = _band_keys(some["fp"], bands)
                row, band = np.nonzero(shared.has(found.ravel().view(np.uint64)).reshape(found.shape))
                yield pa.RecordBatch.from_arrays([some["fp"].take(pa.array(row)), pa.array(found[row, band])], ["fp", "shard"])

    rows = prints.select("fp").mapInArrow(run, "fp binary, shard bigint")
    return search_shards(rows, large, radius, shard_size, _near_links).where("a <> b")


def _compressed(batches):
    """Rows with their text as zstd: all texts are shuffled, and this halves what the codec of shuffles leaves."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for some in slices(batch, "_text"):
            texts = pa.array([packer.compress(t.encode()) for t in some["_text"].to_pylist()], pa.binary())
            yield some.set_column(some.schema.get_field_index("_text"), "_text", texts)


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Every document against an edited copy and against the next document by ascending key.

    The copy has the last half of its characters replaced by as many of the next document's first
    ones. Documents are dealt by ranges of key and text hash with about as many rows each, found by
    dealing the keys alone, whatever their type and spread; ``parts`` is twice the session's shuffle
    partitions. They are read in order, so the next one is the following row; each range also gets
    the first document of the next range, and the last one the first of all. Texts are
    shuffled once; a task holds two of them. Null keys come first, equal keys are in the order of
    their texts' hashes; a null text is empty.
    """
    kind = docs.schema[key].dataType.simpleString()
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), value.alias("_text"), F.xxhash64(value).alias("_hash"))
    parts = parts or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One row per range: where each begins. At most `parts` rows.
    place = F.struct(F.col("_key").isNotNull().alias("k"), F.col("_key").alias("v"), F.col("_hash").alias("h"))
    ranges = rows.select("_key", "_hash").repartitionByRange(parts, F.asc_nulls_first("_key"), "_hash")
    found = ranges.groupBy(F.spark_partition_id().alias("part")).agg(F.min(place).alias("f"))
    firsts = [r["f"] for r in found.orderBy("f").collect()]
    bounds = [F.struct(F.lit(f["k"]).alias("k"), F.lit(f["v"]).cast(kind).alias("v"), F.lit(f["h"]).cast("bigint").alias("h")) for f in firsts]
    part = F.size(F.filter(F.array(*bounds), lambda b: b <= place)) - 1 if bounds else F.lit(0)
    rows = rows.withColumn("_part", part)
    before = [((i - 1) % len(firsts), f["k"], f["v"], f["h"]) for i, f in enumerate(firsts)]
    ends = docs.sparkSession.createDataFrame(before, f"_to int, _k boolean, _v {kind}, _h bigint")
    same = F.col("_key").eqNullSafe(F.col("_v")) & (F.col("_hash") == F.col("_h"))
    extra = rows.join(F.broadcast(ends), same).select("_key", "_text", "_hash", F.col("_to").alias("_part"), F.lit(True).alias("_end"))
    extra = extra.dropDuplicates(["_part"])
    dealt = rows.withColumn("_end", F.lit(False)).unionByName(extra)
    kinds = f"_key {kind}, _text binary, _hash bigint, _part int, _end boolean"
    dealt = dealt.select("_key", "_text", "_hash", F.col("_part").cast("int"), "_end").mapInArrow(_compressed, kinds)
    dealt = dealt.repartition("_part").sortWithinPartitions("_part", "_end", F.asc_nulls_first("_key"), "_hash")

    def run(batches):
        unpacker, previous = zstandard.ZstdDecompressor(), None
        for batch in batches:
            ids, out = [], []
            columns = [batch[c].to_pylist() for c in ("_key", "_text", "_part", "_end")]
            for one, raw, part, end in zip(*columns):
                document = Halved(unpacker.decompress(raw).decode())
                if previous and previous[1] == part:
                    out.append(previous[2].compared(document))
                    ids.append(previous[0])
                previous = None if end else (one, part, document)
            if ids:
                fields = list(zip(*out))
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
                arrays = [pa.array(f, t) for f, t in zip(fields, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("_key").type), *arrays], ["_key", *NAMES])

    kinds = "n_chars bigint, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"
    return dealt.mapInArrow(run, f"_key {kind}, {kinds}").withColumnRenamed("_key", key)


class Halved:
    """A text with its fingerprint and the walk at the start of its last half, where an edit goes on."""

    def __init__(self, text: str):
        self.text, self.half = text, len(text) // 2
        self.walk = Walk().read(text[: len(text) - self.half])
        self.print = self.walk.copy().read(text[len(text) - self.half :]).print()

    def compared(self, following: Halved) -> tuple:
        new = following.text[: self.half]
        edited = self.walk.copy().read(new).print()
        kept = self.text[: len(self.text) - self.half]
        digest = hashlib.sha256((kept + new).encode()).hexdigest()
        return len(self.text), digest, self.print, edited, likeness(self.print, edited), likeness(self.print, following.print)


def edit_classes(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """``prints`` with ``class_id``: the smallest key linked through any chain of near fingerprints."""
    vertices = stage(prints.groupBy("fp").agg(F.min(key).alias("_least")))
    nodes = components(edit_links(vertices))
    owned = vertices.join(nodes, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), "_least", F.coalesce("component", "fp").alias("_group")
    )
    least = owned.groupBy("_group").agg(F.min("_least").alias("class_id"))
    labels = owned.join(least, "_group").select("_fp", "class_id")
    return prints.join(labels, F.col("fp") == F.col("_fp")).drop("_fp")

"""Near duplicates by SimHash: BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.values import named
from tallyloom.llm.components import components
from tallyloom.llm.words import LOWER, block_choices, fresh, lean_slices, mix
from tallyloom.sources.staging import stage

SHARD = 4096
SHINGLES_AT_ONCE = 1 << 12
BANDS, ROWS = 8, 3
WIDE = 256
DEVIATIONS = 5
SET_BYTES = 1 << 25
ASCII_LOWER = bytes(LOWER.tolist())


# --- fingerprints ---------------------------------------------------------------------------


def _hash_blocks(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle, in blocks, so that a long text stays small in memory."""
    parts = text.translate(ASCII_LOWER).split()
    if not parts:
        return
    ends = list(accumulate(len(w) + 1 for w in parts))
    starts = [0, *ends]
    joined = b" ".join(parts) + b" "
    digest = xxhash.xxh64_digest
    stops = ends[size - 1 :] or ends[-1:]
    for at in range(0, len(stops), SHINGLES_AT_ONCE):
        spans = zip(starts[at : at + SHINGLES_AT_ONCE], stops[at : at + SHINGLES_AT_ONCE])
        yield np.frombuffer(b"".join([digest(joined[a : b - 1], 42) for a, b in spans]), dtype=">u8")


def _bit_counts(values: np.ndarray) -> np.ndarray:
    """How many rows of big-endian words have each bit set.

    Runs of 255 rows are added in single bytes, which is the fast part; a few sums are left.
    """
    spread = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1), axis=1)
    edges = np.arange(0, len(spread), 255)
    return np.add.reduceat(spread, edges, axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, size: int, bits: int, bands: int = 0) -> tuple[bytes, list[int]]:
    """SimHash of ``bits`` bits, big-endian, and the keys of ``bands`` min-hash bands.

    A bit is set if it is set in over half of the shingle hashes. Wider fingerprints take their
    bits from re-mixed hashes.
    """
    lanes = np.arange(bits // 64, dtype=np.uint64)
    ones, n = np.zeros(bits, dtype=np.int64), 0
    least = np.full(bands * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for hashes in _hash_blocks(text, size):
        n += len(hashes)
        plain = hashes.astype(np.uint64)
        wide = hashes if bits == 64 else mix(plain[:, None] + lanes).astype(">u8")
        ones += _bit_counts(wide)
        for i in range(len(least)):
            salt = np.uint64(0x5851F42D4C957F2D * (i + 1) % 2**64)
            least[i] = min(least[i], ((plain ^ salt) * np.uint64(0x9E3779B97F4A7C15)).min())
    value = np.packbits(2 * ones > n).tobytes()
    keys = [xxhash.xxh64_intdigest(bytes([b]) + least[b * ROWS : (b + 1) * ROWS].tobytes()) for b in range(bands)]
    return value, keys


def fingerprints(
    docs: DataFrame, key: str, text: str, shingle: int = 4, bits: int = 64, bands: int = 0
) -> DataFrame:
    """``key, fp`` and, with ``bands``, ``shards``: one row per row of ``docs``.

    Null and blank texts have the fingerprint zero. A text of fewer words than a shingle is one
    shingle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in lean_slices(batches, "_text"):
            found = [fingerprint((t or "").encode(), shingle, bits, bands) for t in batch["_text"].to_pylist()]
            columns = [batch["_key"], pa.array([f for f, _ in found], pa.binary())]
            if bands:
                keys = np.array([k for _, k in found], dtype=np.uint64).view(np.int64)
                columns.append(pa.array(keys.reshape(len(found), bands).tolist(), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["_key", "fp", "shards"][: len(columns)])

    schema = f"_key {kind}, fp binary" + ", shards array<bigint>" * bool(bands)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("_key", key)


# --- search ---------------------------------------------------------------------------------


class BKTree:
    """Fingerprints as a BK-tree whose nodes know their component.

    The children of a node are keyed by their Hamming distance to it. By the triangle
    inequality, a search at distance ``d`` from a node follows only edges ``d - radius`` to
    ``d + radius``. Since callers want components rather than pairs, a search ends once it has
    met every component of the tree: a dense group costs one hit per search, not one per pair.
    """

    def __init__(self, radius: int):
        self.radius, self.values, self.children, self.parent, self.parts = radius, [], [], [], 0

    def _top(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def search(self, value: int, check: Callable[[int], bool] | None = None) -> list[int]:
        """One node within the radius, and for which ``check`` holds, for every component that has any."""
        hits: dict[int, int] = {}
        stack, radius = [0] if self.values else [], self.radius
        while stack:
            node = stack.pop()
            d = (value ^ self.values[node]).bit_count()
            if d <= radius and (top := self._top(node)) not in hits and (check is None or check(node)):
                hits[top] = node
                if len(hits) == self.parts:
                    break
            for edge, child in self.children[node].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return list(hits.values())

    def add(self, value: int, check: Callable[[int], bool] | None = None) -> list[int]:
        """Insert a new value; returns what ``search`` finds and joins those components."""
        hits, new = self.search(value, check), len(self.values)
        node = 0
        while new:
            d = (value ^ self.values[node]).bit_count()
            child = self.children[node].get(d)
            if child is None:
                self.children[node][d] = new
                break
            node = child
        self.values.append(value)
        self.children.append({})
        self.parent.append(new)
        for hit in hits:
            self.parent[self._top(hit)] = new
        self.parts += 1 - len(hits)
        return hits


def _links(radius: int):
    """Rows sorted by shard, members before visitors, to the links found in each shard's tree."""

    def run(batches):
        current, tree = None, BKTree(radius)
        for batch in batches:
            shard, part = (batch[c].to_numpy() for c in ("shard", "part"))
            n = len(batch)
            change = np.ones(n + 1, dtype=bool)
            change[1:-1] = (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])
            # A row alone in its shard has nothing to meet; the first and last may go on.
            alone = change[:-1] & change[1:]
            alone[[0, -1]] = False
            fps, visits = batch["fp"], batch["visits"]
            left, right = [], []
            for i in np.flatnonzero(~alone).tolist():
                if (shard[i], part[i]) != current:
                    current, tree = (shard[i], part[i]), BKTree(radius)
                raw = fps[i].as_py()
                value = int.from_bytes(raw, "big")
                hits = tree.search(value) if visits[i].as_py() else tree.add(value)
                for hit in hits:
                    left.append(tree.values[hit].to_bytes(len(raw), "big"))
                    right.append(raw)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return run


def block_shards(radius: int = 4, blocks: int = 7) -> Column:
    """Keys under which any two 64-bit fingerprints within the radius meet at least once.

    Of ``blocks`` blocks of bits at most ``radius`` can differ, so two such fingerprints agree on
    some choice of ``blocks - radius``: 35 keys of 27 or 28 bits for 7 and 4.
    """
    half = [F.conv(F.substring(F.hex("fp"), at, 8), 16, 10).cast("bigint") for at in (1, 9)]
    signed = F.shiftleft(half[0], 32).bitwiseOR(half[1])
    edges = [64 * i // blocks for i in range(blocks + 1)]
    piece = [
        F.shiftrightunsigned(signed, a).bitwiseAND(F.lit((1 << b - a) - 1)) for a, b in zip(edges, edges[1:])
    ]
    keys = []
    for i, chosen in enumerate(block_choices(blocks, blocks - radius)):
        key = F.lit(i).cast("bigint")
        for c in chosen:
            key = F.shiftleft(key, edges[c + 1] - edges[c]).bitwiseOR(piece[c])
        keys.append(key)
    return F.array(*keys)


def link(fps: DataFrame, radius: int, shard_size: int = SHARD, search=_links) -> DataFrame:
    """Links ``a, b`` between the distinct ``fp`` of a table with ``shards``, an array of keys.

    ``search`` makes, of a radius, the function that reads the sorted shards.

    Every linked pair that shares a shard ends up connected. A shard's tree is built in the task
    that holds the shard: sending trees to all tasks would put every fingerprint through the
    driver, and fingerprints without a common shard need not meet. A shard of more than
    ``shard_size`` fingerprints is split into parts with a tree each; its fingerprints are
    members of one part and visit the others, so neither rows nor links are dropped and no tree
    grows with the data.
    """
    rows = fps.select("fp", F.explode("shards").alias("shard")).distinct()
    large = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_size)
    return search_shards(rows, large, radius, shard_size, search)


def search_shards(rows: DataFrame, large: DataFrame, radius: int, shard_size: int, search=_links) -> DataFrame:
    """Links of ``fp, shard`` rows, where ``large`` has ``shard, n`` of the shards to split; see ``link``."""
    parts = F.coalesce(F.ceil(F.col("n") / shard_size), F.lit(1)).cast("int")
    home = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    placed = (
        rows.join(large, "shard", "left")
        .select("fp", "shard", parts.alias("parts"))
        .select("fp", "shard", home.alias("home"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        .select("shard", "part", (F.col("part") != F.col("home")).alias("visits"), "fp")
    )
    together = placed.repartition("shard", "part").sortWithinPartitions("shard", "part", "visits", "fp")
    return together.mapInArrow(search(radius), "a binary, b binary").distinct()


def near_duplicates(
    docs: DataFrame,
    key: str,
    text: str,
    shingle: int = 4,
    radius: int = 4,
    bits: int = 64,
    shard_size: int = SHARD,
) -> DataFrame:
    """``key, fp, component``: the component is the smallest key linked through any chain.

    Fingerprints of 64 bits at a radius of 4 are linked exactly (see ``block_shards``). Wider
    fingerprints, whose radius no choice of blocks can cover, meet where one of ``BANDS``
    min-hash bands of ``ROWS`` values is equal: 99.7 % of the pairs at a similarity of 0.8, more
    above. Equal fingerprints are one vertex from the start, so a group of copies of any size
    is one row.

    Null and blank texts are alike. Rows with a null key take part; a component of such rows
    only is null. Repeated rows are repeated in the result. Columns of other names are ignored.
    """
    exact = bits == 64
    marked = stage(fingerprints(docs, key, text, shingle, bits, 0 if exact else BANDS))
    vertices = stage(marked.groupBy("fp").agg(F.min(key).alias("_least")))
    sharded = vertices.withColumn("shards", block_shards(radius)) if exact else marked
    nodes = components(link(sharded, radius, shard_size))
    owned = vertices.join(nodes, F.col("fp") == F.col("node"), "left").select(
        "fp", "_least", F.coalesce("component", "fp").alias("_group")
    )
    least = owned.groupBy("_group").agg(F.min("_least").alias("component"))
    labels = owned.join(least, "_group").select(F.col("fp").alias("_fp"), "component")
    return marked.join(labels, F.col("fp") == F.col("_fp")).select(*named([key]), "fp", "component")


# --- shingle sets ---------------------------------------------------------------------------


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    blocks = [h.astype(np.uint64) for h in _hash_blocks(text, size)]
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, dtype=np.uint64)


def set_sketch(hashes: np.ndarray, bits: int = WIDE, bands: int = BANDS) -> tuple[bytes, list[int]]:
    """SimHash and keys of the min-hash bands of a shingle set, where ``fingerprint`` counts repeats."""
    lanes = np.arange(bits // 64, dtype=np.uint64)
    ones = np.zeros(bits, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        ones += _bit_counts(mix(hashes[at : at + SHINGLES_AT_ONCE, None] + lanes).astype(">u8"))
    least = np.full(bands * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(len(least) if len(hashes) else 0):
        salt = np.uint64(0x5851F42D4C957F2D * (i + 1) % 2**64)
        least[i] = ((hashes ^ salt) * np.uint64(0x9E3779B97F4A7C15)).min()
    keys = [xxhash.xxh64_intdigest(bytes([b]) + least[b * ROWS : (b + 1) * ROWS].tobytes()) for b in range(bands)]
    return np.packbits(2 * ones > len(hashes)).tobytes(), keys


def set_sketches(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``_key, _hash, id, fp, n, shards``: a row per row of ``docs``; ``id`` names the shingle set of ``n`` hashes."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, prints, sizes, shards = [], [], [], []
            for body in batch["_text"].to_pylist():
                found = shingle_set((body or "").encode(), shingle)
                fp, keys = set_sketch(found)
                ids.append(xxhash.xxh3_128_digest(found.tobytes()))
                prints.append(fp), sizes.append(len(found)), shards.append(keys)
            keys = np.array(shards, dtype=np.uint64).reshape(len(batch), BANDS).view(np.int64).tolist()
            columns = [batch["_key"], batch["_hash"], pa.array(ids, pa.binary()), pa.array(prints, pa.binary())]
            columns += [pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_hash", "id", "fp", "n", "shards"])

    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, _hash bigint, id binary, fp binary, n bigint, shards array<bigint>")


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``id, fp, hashes`` of a table ``id, fp, _text``; ``hashes`` are 64-bit numbers end to end."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.slice(at, 64)
                sets = [shingle_set((t or "").encode(), shingle).tobytes() for t in some["_text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([some["id"], some["fp"], pa.array(sets, pa.binary())], ["id", "fp", "hashes"])

    return texts.mapInArrow(run, "id binary, fp binary, hashes binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending arrays without repeats; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _set_links(similarity: float, radius: int):
    """As ``_links``, but a hit counts only if the sets' Jaccard similarity is reached."""

    def run(batches):
        current, tree, ids, sets = None, BKTree(radius), [], []
        for batch in batches:
            shard, part = (batch[c].to_numpy() for c in ("shard", "part"))
            left, right = [], []
            for i in range(len(batch)):
                if (shard[i], part[i]) != current:
                    current, tree, ids, sets = (shard[i], part[i]), BKTree(radius), [], []
                own, name = np.frombuffer(batch["hashes"][i].as_py(), dtype=np.uint64), batch["id"][i].as_py()
                value = int.from_bytes(batch["fp"][i].as_py(), "big")

                def near(node, own=own, sets=sets):
                    few, many = sorted((len(own), len(sets[node])))
                    return few >= similarity * many * (1 - 1e-9) and jaccard(own, sets[node]) >= similarity

                if batch["visits"][i].as_py():
                    hits = tree.search(value, near)
                else:
                    hits = tree.add(value, near)
                    ids.append(name), sets.append(own)
                left += [ids[hit] for hit in hits]
                right += [name] * len(hits)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return run


def similar_links(
    docs: DataFrame, marked: DataFrame, text: str, shingle: int, similarity: float, shard_size: int = SHARD, room: int = SET_BYTES
) -> DataFrame:
    """Links ``a, b`` between the ids of ``marked``, the written ``set_sketches`` of ``docs``.

    Sets meet where a band is equal; every set of a shard is compared, by its hashes, with a
    member of each component of the shard until the similarity is reached. Only sets that share
    a shard are made again from their texts, one of each, and of shards with the same sets one is
    looked at. A shard of more than ``shard_size`` sets or ``room`` bytes of hashes is split into
    parts; a set is a member of one part and visits the ones before it.
    """
    vertices = marked.groupBy("id").agg(
        F.min("_hash").alias("_hash"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("shards").alias("shards")
    )
    vertices = stage(vertices)
    rows = vertices.select("id", "n", F.explode("shards").alias("shard")).distinct()
    mark = F.xxhash64("id").cast("decimal(20,0)")
    shards = rows.groupBy("shard").agg(
        F.count(F.lit(1)).alias("sets"), F.sum("n").alias("size"), F.sum(mark).alias("mark"), F.min("id").alias("least")
    )
    shards = shards.where("sets > 1").groupBy("sets", "size", "mark", "least").agg(F.min("shard").alias("shard"))
    parts = F.greatest(F.ceil(F.col("sets") / shard_size), F.ceil(8 * F.col("size") / room)).cast("int")
    met = stage(rows.join(shards.select("shard", parts.alias("parts")), "shard").select("id", "shard", "parts"))
    wanted = vertices.join(met.select("id").distinct(), "id", "left_semi").select("id", "fp", "_hash")
    texts = docs.select(F.xxhash64(text).alias("_hash"), F.col(text).cast("string").alias("_text"))
    texts = texts.join(wanted.select("_hash"), "_hash", "left_semi").groupBy("_hash").agg(F.first("_text").alias("_text"))
    sets = stage(_shingle_sets(wanted.join(texts, "_hash").select("id", "fp", "_text"), shingle))
    home = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    placed = (
        met.select("id", "shard", home.alias("home"))
        .select("id", "shard", "home", F.explode(F.sequence(F.lit(0), F.col("home"))).alias("part"))
        .select("id", "shard", "part", (F.col("part") != F.col("home")).alias("visits"))
    )
    together = placed.join(sets, "id").repartition("shard", "part").sortWithinPartitions("shard", "part", "visits", "id")
    return together.mapInArrow(_set_links(similarity, radius_of(similarity)), "a binary, b binary").distinct()


def radius_of(similarity: float, bits: int = WIDE) -> int:
    """The differing bits that two shingle sets of a Jaccard similarity have at most.

    ``DEVIATIONS`` above the mean for the angle between sets of one size. Sets of a few shingles
    differ in more bits than the angle says, up to a quarter more: 4 and 5 shingles at 0.8 in 3 of 16.
    """
    p = min(0.5, 1.25 * float(np.arccos(2 * similarity / (1 + similarity)) / np.pi))
    return round(bits * p + DEVIATIONS * (bits * p * (1 - p)) ** 0.5)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """The documents without near duplicates: of each group the smallest key stays.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles, as
    64-bit hashes, is at least ``similarity``; a group is linked through any chain. Candidates
    are sets with an equal min-hash band: 99.7 % of the pairs at a similarity of 0.8, more above.
    A document is never removed for a pair below the similarity. Columns are those of ``docs``.

    Rows are told apart by key and text, so a repeated key removes no other text. Of the rows of
    a group that share the smallest key, or have no key in a group without any, the one of the
    smallest text hash stays; of equal ones, any.
    """
    marked = stage(set_sketches(docs, key, text, 5))
    nodes = components(similar_links(docs, marked, text, 5, similarity))
    return _first_of_groups(docs, key, text, marked.join(nodes, F.col("id") == F.col("node"), "left").withColumn("_group", F.coalesce("component", "id")))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The documents without SimHash near duplicates: of each component the smallest key stays.

    Components are those of ``near_duplicates`` for 64-bit fingerprints: equal fingerprints, and
    those linked through any chain of at most ``radius`` differing bits. Texts without words are
    one group, a null text among them. Columns are those of ``docs``, whatever their names.

    Rows are told apart by key and text, as in ``keep_one``.
    """
    who = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    rows = docs.select(who.alias("_who"), F.col(text).cast("string").alias("_body"))
    marked = stage(fingerprints(rows, "_who", "_body", shingle).select("fp", F.col("_who.key").alias("_key"), F.col("_who.hash").alias("_hash")))
    vertices = stage(marked.select("fp").distinct())
    nodes = components(link(vertices.withColumn("shards", block_shards(radius)), radius))
    grouped = marked.join(nodes, F.col("fp") == F.col("node"), "left").withColumn("_group", F.coalesce("component", "fp"))
    return _first_of_groups(docs, key, text, grouped)


def _first_of_groups(docs: DataFrame, key: str, text: str, grouped: DataFrame) -> DataFrame:
    """Of the rows of ``docs`` in each ``_group`` of ``_key, _hash`` one: least key, then least hash, then any."""
    owned = stage(grouped.groupBy("_group", "_key", "_hash").agg(F.count(F.lit(1)).alias("_rows")))
    first = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_hash").alias("hash"))
    # The first of a group, written: a table that the optimizer may broadcast if it is small.
    least = stage(owned.groupBy("_group").agg(F.min(first).alias("_first")))
    stays = F.col("_key").eqNullSafe(F.col("_first.key")) & (F.col("_hash") == F.col("_first.hash"))
    judged = owned.join(least, "_group").select("_key", "_hash", "_rows", stays.alias("_stays"))
    own, hash_ = fresh("key"), fresh("hash")
    judged = stage(judged.where("not _stays or _rows > 1").select(F.col("_key").alias(own), F.col("_hash").alias(hash_), F.col("_stays").alias(fresh("stays"))))
    stays = F.col(judged.columns[2])
    same = F.col(key).eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(hash_))
    kept = docs.join(judged, same, "left_anti")
    # Only rows of which several are equal: one of each, combined before the shuffle.
    repeated = docs.join(judged.where(stays), same, "left_semi").withColumn(hash_, F.xxhash64(text))
    return kept.unionByName(repeated.dropDuplicates([key, hash_]).select(*named(docs.columns)))

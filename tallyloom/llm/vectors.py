"""Exact search over vectors: dealt into cells and units, searched in two waves that share the k-th score.

The tree that a unit is searched by is a parameter: see ``ball_tree`` and ``hyperplane_tree``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources.staging import stage

SAMPLE, CELLS = 4096, 64  # rows that pivots are fitted on, and their number
UNIT_ROWS = 1 << 16
BLOCK = 1024
EXACT = 2.0**53
LOWEST, HIGHEST = -(2**63), 2**63 - 1
HUGE = 2.0**200


# --- numbers --------------------------------------------------------------------------------


def matrix(column: pa.Array, scale: int, width: int = 0) -> np.ndarray:
    """A row per vector: ``floor(scale * x)`` of each component, missing ones at the end as 0.

    Components are kept within 2**200, far beyond any score that fits in 64 bits.
    """
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(flat * scale), -HUGE, HUGE)
    out = np.zeros((len(size), max(int(size.max(initial=0)), width)))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def inner(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of two matrices of whole numbers.

    Floating point is exact while no partial sum can pass 2**53, as the lengths of the vectors
    tell. Other pairs are computed with Python's integers and kept within 64 bits.
    """
    scores = left @ right.T
    large = np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1) >= EXACT / 2
    if not large.any():
        return scores.astype(np.int64)
    out = np.where(large, 0, scores).astype(np.int64)
    for i, j in zip(*np.nonzero(large)):
        total = sum(int(a) * int(b) for a, b in zip(left[i], right[j]))
        out[i, j] = min(max(total, LOWEST), HIGHEST)
    return out


class Best:
    """The ``k`` best scores so far of every lane, a query with a window of scores; ties to smaller ids."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = np.full((len(low), k), LOWEST, dtype=np.int64)
        self.ids = np.full((len(low), k), HIGHEST, dtype=np.int64)
        self.found = np.zeros(len(low), dtype=np.int64)

    def floor(self, lanes: np.ndarray) -> np.ndarray:
        """The score that a new hit must reach: of the window, or the current k-th."""
        return np.maximum(self.low[lanes], np.where(self.found[lanes] == self.k, self.scores[lanes, -1], LOWEST))

    def beats(self, lanes: np.ndarray, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Whether a node with this upper bound and smallest id can hold a hit."""
        floor = self.floor(lanes)
        tied = (self.found[lanes] == self.k) & (bound == self.scores[lanes, -1]) & (least_id > self.ids[lanes, -1])
        return (bound >= floor) & ~tied

    def offer(self, lanes: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores of the same members, by ``ids``, for each of some lanes."""
        floor = self.floor(lanes)[:, None]
        row, column = np.nonzero(allowed & (scores >= floor) & (scores <= self.high[lanes][:, None]))
        if not len(row):
            return
        touched, row = np.unique(row, return_inverse=True)
        own = lanes[touched]
        place, slot = np.nonzero(np.arange(self.k) < self.found[own][:, None])
        lane = np.concatenate([place, row])
        score = np.concatenate([self.scores[own[place], slot], scores[touched[row], column]])
        who = np.concatenate([self.ids[own[place], slot], ids[column]])
        order = np.lexsort((who, -1 - score, lane))  # -1 - x keeps the smallest integer in range
        lane, score, who = lane[order], score[order], who[order]
        rank = np.arange(len(lane)) - np.searchsorted(lane, lane)
        keep = rank < self.k
        self.scores[own[lane[keep]], rank[keep]], self.ids[own[lane[keep]], rank[keep]] = score[keep], who[keep]
        self.found[own] = np.minimum(np.bincount(lane, minlength=len(own)), self.k)


@dataclass
class Members:
    """The vectors of a unit, ascending by id."""

    values: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray


@dataclass
class Lanes:
    """Queries of a unit: a lane per query and window."""

    values: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    same: bool | None  # labels of hits: as the query's, other, or any

    def allowed(self, lanes: np.ndarray, members: Members, at: np.ndarray) -> np.ndarray:
        out = self.rows[lanes][:, None] != members.rows[at]
        if self.same is not None:
            out &= (self.labels[lanes][:, None] == members.labels[at]) == self.same
        return out


Search = Callable[[Lanes, Best], None]


# --- cells ----------------------------------------------------------------------------------


def numeric_vectors(rows: DataFrame, key: str, vector: str, label: Column | None = None) -> DataFrame:
    """``_row, _id, _label, _v``, written: the rows whose key, label and all components are there and finite."""
    kind = rows.schema[vector].dataType.elementType
    value = F.col(vector) if isinstance(kind, T.FloatType) else F.col(vector).cast("array<double>")
    ok = F.forall("_v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    label = F.lit(0) if label is None else label
    taken = rows.select(F.col(key).cast("bigint").alias("_id"), label.cast("bigint").alias("_label"), value.alias("_v"))
    taken = taken.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_v").isNotNull() & ok)
    return stage(taken.withColumn("_row", F.monotonically_increasing_id()))


@dataclass
class Cells:
    """The pivots, and of the cell of each the radius, the first unit and the number of units."""

    pivots: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    units: np.ndarray

    def of(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = distances(values, padded(self.pivots, values.shape[1]))
        cell = apart.argmin(axis=1)
        return cell, apart[np.arange(len(cell)), cell]


def padded(values: np.ndarray, width: int) -> np.ndarray:
    return values if values.shape[1] >= width else np.pad(values, ((0, 0), (0, width - values.shape[1])))


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    square = (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1) - 2 * (left @ right.T)
    return np.sqrt(np.maximum(square, 0))


def _pivots(rows: DataFrame, scale: int) -> np.ndarray:
    """Centres fitted by a few rounds of k-means on ``SAMPLE`` rows; any centres give right results."""
    some = rows.orderBy(F.xxhash64("_row")).limit(SAMPLE).select("_v").toArrow()["_v"].combine_chunks()
    values = matrix(some, scale)
    centres = values[:CELLS]
    for _ in range(5 if len(values) else 0):
        own = distances(values, centres).argmin(axis=1)
        count = np.bincount(own, minlength=len(centres))[:, None]
        total = np.zeros_like(centres)
        np.add.at(total, own, values)
        centres = np.where(count, total / np.maximum(count, 1), centres)
    return centres


def deal(rows: DataFrame, scale: int, unit_rows: int = UNIT_ROWS) -> tuple[DataFrame, Cells]:
    """The rows with ``_cell`` and ``_unit``, and what a query must know to choose among them.

    A row belongs to the cell of its nearest pivot. A cell of more than ``unit_rows`` rows, such
    as a large group of copies, is dealt into several units by a hash of the row. The
    aggregate that comes to the driver has a row per cell, at most ``CELLS``.
    """
    cells = Cells(_pivots(rows, scale), *[np.zeros(0)] * 3)

    def run(batches):
        for batch in batches:
            cell, apart = cells.of(matrix(batch["_v"], scale, cells.pivots.shape[1]))
            added = [pa.array(cell.astype(np.int32)), pa.array(apart)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "_cell", "_apart"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = stage(rows.mapInArrow(run, f"{fields}, _cell int, _apart double"))
    found = dealt.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_apart").alias("r")).collect()
    n = len(cells.pivots)
    cells.radius, cells.units = np.zeros(n), np.zeros(n, dtype=np.int64)
    for r in found:
        cells.radius[r["_cell"]], cells.units[r["_cell"]] = r["r"], -(-r["n"] // unit_rows)
    cells.first = np.cumsum(cells.units) - cells.units
    if not n:
        return dealt.withColumn("_unit", F.lit(0)), cells
    first, units = (F.array(*[F.lit(int(x)) for x in column])[F.col("_cell")] for column in (cells.first, cells.units))
    unit = first + F.pmod(F.xxhash64("_row"), units)
    return dealt.withColumn("_unit", unit.cast("int")), cells


# --- search ---------------------------------------------------------------------------------


def _routed(asks: DataFrame, cells: Cells, scale: int, first: bool) -> DataFrame:
    """``asks`` once for each unit that they are to visit, as ``_unit``.

    First the one of their own cell; then every other unit whose cell, a ball around its
    pivot, can have a score within one of the windows.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asks.schema)

    def run(batches):
        for batch in batches:
            values = matrix(batch["_v"], scale, cells.pivots.shape[1])
            home, _ = cells.of(values)
            rows = batch["_row"].to_numpy()
            home = cells.first[home] + rows % np.maximum(cells.units[home], 1)
            if first:
                row, unit = np.arange(len(home)), home
            else:
                pivots = padded(cells.pivots, values.shape[1])
                middle, reach = values @ pivots.T, np.linalg.norm(values, axis=1)[:, None] * cells.radius
                slack = 1e-9 * (np.abs(middle) + reach) + 1
                least, most = (np.clip(x, LOWEST, HIGHEST) for x in (middle - reach - slack, middle + reach + slack))
                width = len(batch["_low"][0])
                low, high = (batch[c].flatten().to_numpy().astype(np.float64).reshape(-1, width) for c in ("_low", "_high"))
                alive = np.zeros(middle.shape, dtype=bool)
                for w in range(width):
                    alive |= (most >= low[:, w : w + 1]) & (least <= high[:, w : w + 1])
                row, cell = np.nonzero(alive)
                many = cells.units[cell]
                row, unit = np.repeat(row, many), np.repeat(cells.first[cell], many)
                unit = unit + np.arange(len(unit)) - np.repeat(np.cumsum(many) - many, many)
                other = unit != home[row]
                row, unit = row[other], unit[other]
            for at in range(0, len(row), 8192):
                took = batch.take(pa.array(row[at : at + 8192]))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(unit[at : at + 8192].astype(np.int32))], [*took.schema.names, "_unit"])

    return asks.mapInArrow(run, f"{fields}, _unit int")


def _hits(dealt: DataFrame, asks: DataFrame, scale: int, k: int, same: bool | None, tree: Callable[[Members], Search]) -> DataFrame:
    """``_ask, _window, _score, _id``: of every unit, the best hits of the queries that visit it.

    A task reads a unit's members, builds their tree, and then reads the visiting queries in
    blocks; it holds a unit and a block at a time.
    """
    none = F.lit(None).cast("array<bigint>")
    members = dealt.select("_unit", F.lit(0).alias("_kind"), "_row", "_id", "_label", "_v", none.alias("_low"), none.alias("_high"))
    visitors = asks.select("_unit", F.lit(1).alias("_kind"), "_row", "_id", "_label", "_v", "_low", "_high")
    together = members.unionByName(visitors).repartition("_unit").sortWithinPartitions("_unit", "_kind", "_id")

    def search(find, rows: pa.RecordBatch, width: int):
        windows = len(rows["_low"][0])
        low, high = (rows[c].flatten().to_numpy() for c in ("_low", "_high"))
        # Components that no member has cannot change a score.
        values = padded(matrix(rows["_v"], scale), width)[:, :width]
        columns = [np.repeat(c, windows, axis=0) for c in (values, rows["_row"].to_numpy(), rows["_label"].to_numpy())]
        best = Best(low, high, k)
        find(Lanes(*columns, same), best)
        lane, slot = np.nonzero(np.arange(k) < best.found[:, None])
        arrays = [columns[1][lane], (lane % windows).astype(np.int32), best.scores[lane, slot], best.ids[lane, slot]]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["_ask", "_window", "_score", "_id"])

    def run(batches):
        unit, held, find, width = None, [], None, 0
        for batch in batches:
            key = batch["_unit"].to_numpy().astype(np.int64) * 2 + batch["_kind"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if key[a] // 2 != unit:
                    unit, held, find = key[a] // 2, [], None
                if key[a] % 2 == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    blocks = [matrix(h["_v"], scale) for h in held]
                    width = max(m.shape[1] for m in blocks)
                    rest = [np.concatenate([h[c].to_numpy() for h in held]) for c in ("_id", "_row", "_label")]
                    find, held = tree(Members(np.concatenate([padded(m, width) for m in blocks]), *rest)), []
                if find is None:
                    continue
                for at in range(a, b, BLOCK):
                    rows = batch.slice(at, min(BLOCK, b - at))
                    out = search(find, rows, width)
                    if len(out):
                        yield out

    return together.mapInArrow(run, "_ask bigint, _window int, _score bigint, _id bigint")


def best_in_windows(
    dealt: DataFrame, cells: Cells, asks: DataFrame, scale: int, k: int, same: bool | None, tree: Callable[[Members], Search]
) -> DataFrame:
    """``_ask, _window, _rank, _score, _id``: per query and window the ``k`` highest scores, ties to smaller ids.

    ``asks`` is a table of rows of ``dealt`` with arrays ``_low`` and ``_high``, the windows. In the
    first wave a query searches one unit near to it. Its k-th score there is shared with all
    units: it raises the window's lower end in the second wave, which leaves out whole cells and
    is every search's first bound. Both waves return at most ``k`` rows per query, window and unit.
    """
    near = stage(_hits(dealt, _routed(asks, cells, scale, True), scale, k, same, tree))
    full = near.groupBy("_ask", "_window").agg(F.count(F.lit(1)).alias("n"), F.min("_score").alias("s")).where(F.col("n") == k)
    known = full.groupBy("_ask").agg(F.map_from_entries(F.collect_list(F.struct("_window", "s"))).alias("_kth"))
    raised = F.transform("_low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("_kth", i), x)))
    columns = [c for c in asks.columns if c != "_low"]
    again = asks.join(known, F.col("_row") == F.col("_ask"), "left").select(*columns, raised.alias("_low"))
    far = _hits(dealt, _routed(again, cells, scale, False), scale, k, same, tree)
    order = Window.partitionBy("_ask", "_window").orderBy(F.desc("_score"), "_id")
    return near.unionByName(far).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)


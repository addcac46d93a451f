"""Hard negatives: a multiway hyperplane tree per unit, searched by annuli of scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.vectors import (
    HIGHEST,
    LOWEST,
    UNIT_ROWS,
    Best,
    Lanes,
    Members,
    best_in_windows,
    deal,
    distances,
    inner,
    numeric_vectors,
)
from tallyloom.sources.staging import stage

LEAF, WAYS = 256, 8
ONE_SIDED = 0.95


@dataclass
class Leaf:
    """Members ascending by id, and whether their vectors are all the same."""

    at: np.ndarray
    copies: bool


class HyperplaneTree:
    """Split points, each with the members nearest to it, and their distance ranges to all siblings.

    A node has up to ``WAYS`` split points. Member ``x`` belongs to the nearest; for every pair the
    node stores the least and largest distance of split point ``i`` to the subtree of ``j``. A node
    whose members do not come apart, such as copies, is a leaf; leaves are scanned a piece at a time.
    """

    def __init__(self, members: Members, leaf: int = LEAF, ways: int = WAYS):
        self.members, self.leaf, self.ways = members, leaf, ways
        self.norm = np.linalg.norm(members.values, axis=1)
        self.root = self._build(np.arange(len(members.ids)))

    def _split_points(self, values: np.ndarray) -> np.ndarray:
        """Distinct members far from each other, found greedily among a spread of members."""
        some = values[np.linspace(0, len(values) - 1, min(len(values), 16 * self.ways)).astype(int)]
        chosen = [0]
        apart = distances(some, some[:1])[:, 0]
        while len(chosen) < self.ways and apart.max() > 0:
            chosen.append(int(apart.argmax()))
            apart = np.minimum(apart, distances(some, some[chosen[-1:]])[:, 0])
        return some[chosen]

    def _build(self, at: np.ndarray):
        root: list = [None]
        todo = [(at, root, 0)]
        while todo:
            at, holder, slot = todo.pop()
            points = self._split_points(self.members.values[at]) if len(at) > self.leaf else np.zeros((0, 0))
            if len(points) < 2:
                holder[slot] = self._leaf(at)
                continue
            apart = distances(self.members.values[at], points)
            own = apart.argmin(axis=1)
            if np.bincount(own).max() > ONE_SIDED * len(at):
                holder[slot] = self._leaf(at)
                continue
            n = len(points)
            low, high, norms, children = np.full((n, n), np.inf), np.full((n, n), -np.inf), np.zeros((2, n)), [None] * n
            for j in range(n):
                inside = own == j
                if not inside.any():
                    continue
                low[:, j], high[:, j] = apart[inside].min(axis=0), apart[inside].max(axis=0)
                norms[:, j] = self.norm[at[inside]].min(), self.norm[at[inside]].max()
                todo.append((at[inside], children, j))
            holder[slot] = (points, low, high, norms, children)
        return root[0]

    def search(self, lanes: Lanes, best: Best) -> None:
        """First the leaf that is nearest to each query, then depth first through all that can count."""
        square = (lanes.values**2).sum(axis=1)
        seen = self._nearest(lanes, best)
        todo = [(self.root, np.arange(len(square)))]
        while todo:
            node, who = todo.pop()
            if isinstance(node, Leaf):
                if id(node) in seen:
                    who = np.setdiff1d(who, seen[id(node)], assume_unique=True)
                self._scan(node, lanes, best, who)
            else:
                todo += self._enter(node, lanes, best, who, square[who])

    def _nearest(self, lanes: Lanes, best: Best) -> dict[int, np.ndarray]:
        """Scan the leaf that each query would belong to; which queries have seen which leaf."""
        seen, todo = {}, [(self.root, np.arange(len(lanes.rows)))]
        while todo:
            node, who = todo.pop()
            if isinstance(node, Leaf):
                seen[id(node)] = who
                self._scan(node, lanes, best, who)
                continue
            points, _, _, _, children = node
            there = np.array([child is not None for child in children])
            own = np.where(there, distances(lanes.values[who], points), np.inf).argmin(axis=1)
            todo += [(children[j], who[own == j]) for j in np.unique(own)]
        return seen

    def _enter(self, node, lanes: Lanes, best: Best, who: np.ndarray, square: np.ndarray) -> list:
        """The subtrees and the queries whose annulus meets their ranges, the nearest last.

        A window of scores is an annulus of distances: ``d^2 = |q|^2 + |x|^2 - 2 s``, with the norms of
        the subtree for ``|x|``. Its outer radius shrinks as the k-th score rises.
        """
        points, low, high, norms, children = node
        apart = distances(lanes.values[who], points)
        # Room for rounding: the square root doubles the digits lost to cancellation.
        room = 1e-6 * (1 + np.sqrt(square) + norms[1].max())
        floor, top = best.floor(who), best.high[who]
        enter = []
        for j, child in enumerate(children):
            if child is None:
                continue
            outer = np.where(floor == LOWEST, np.inf, square + norms[1, j] ** 2 - 2.0 * floor)
            inside = np.where(top == HIGHEST, 0, square + norms[0, j] ** 2 - 2.0 * top)
            outer, inside = np.sqrt(np.maximum(outer, 0)) + room, np.sqrt(np.maximum(inside, 0)) - room
            meets = (apart - outer[:, None] <= high[:, j]) & (apart + outer[:, None] >= low[:, j]) & (apart + high[:, j] >= inside[:, None])
            some = meets.all(axis=1)
            if some.any():
                enter.append((apart[:, j].mean(), j, who[some]))
        return [(children[j], some) for _, j, some in sorted(enter, key=lambda e: -e[0])]

    def _leaf(self, at: np.ndarray) -> Leaf:
        values = self.members.values[at]
        return Leaf(np.sort(at), bool((values == values[:1]).all()))

    def _scan(self, leaf: Leaf, lanes: Lanes, best: Best, who: np.ndarray) -> None:
        """All members of a leaf, a piece at a time; of copies, no more than can still count."""
        alike = inner(lanes.values[who], self.members.values[leaf.at[:1]])[:, 0] if leaf.copies else None
        for start in range(0, len(leaf.at), self.leaf):
            own = leaf.at[start : start + self.leaf]
            if alike is not None:
                open_ = best.beats(who, alike, self.members.ids[own[0]])
                who, alike = who[open_], alike[open_]
            if not len(who):
                return
            scores = inner(lanes.values[who], self.members.values[own])
            best.offer(who, scores, self.members.ids[own], lanes.allowed(who, self.members, own))


def mine_hard_negatives(
    rows: DataFrame,
    anchors: Column,
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
    unit_rows: int = UNIT_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    The scores are integer inner products of components ``floor(scale * x)``, ties go to the smaller
    key. The positives of an anchor are its best rows of the same label; the negatives of anchor
    and positive are the best rows of another label whose score is within ``window`` percent of
    the positive's: a window of scores, which for a negative score of the positive is empty.
    Both are searched by the same trees, the second time with a lane per positive (see
    ``vectors.best_in_windows``); all is exact.

    Rows with a null key, label or vector, or a null or non-finite component take no part. Vectors of
    different lengths are compared as if the shorter one went on with zeros. Repeated rows are
    rows: each is a candidate of the others, and an anchor. Scores beyond 64 bits count as the
    largest or smallest. Anchors without positives, and pairs without negatives, have no row.
    Other columns are ignored whatever their names.
    """
    label = F.col(label) if isinstance(label, str) else label
    marked = rows.select(
        F.col(key).alias("_key"), F.col(vector).alias("_vector"), label.alias("_class"), F.coalesce(anchors, F.lit(False)).alias("_asks")
    )
    # Labels of any type become numbers; the lowest bit says whether a row is an anchor.
    kind = F.col("_class").cast("string")
    number = F.when(kind.isNotNull(), F.shiftleft(F.xxhash64(kind), 1).bitwiseOR(F.col("_asks").cast("bigint")))
    taken = numeric_vectors(marked, "_key", "_vector", number)
    is_anchor = F.col("_label").bitwiseAND(F.lit(1)) == 1
    taken, plain = taken.where(is_anchor), taken.withColumn("_label", F.shiftright("_label", 1))
    dealt, cells = deal(plain, scale, unit_rows)
    anchors_ = taken.select("_row", "_id", F.shiftright("_label", 1).alias("_label"), "_v")

    def tree(members):
        return HyperplaneTree(members).search

    ends = [F.array(F.lit(end).cast("bigint")).alias(name) for end, name in ((LOWEST, "_low"), (HIGHEST, "_high"))]
    near = best_in_windows(dealt, cells, anchors_.select("*", *ends), scale, positives, True, tree)
    near = stage(near.select("_ask", (F.col("_rank") - 1).alias("_place"), F.col("_id").alias("positive_id"), F.col("_score").alias("positive_score")))
    # Whole scores between both ends; products are decimals, as they may pass 64 bits.
    least, most = (F.col("positive_score").cast("decimal(20,0)") * F.lit(p) / 100 for p in window)
    pair = F.struct("_place", F.ceil(least).cast("bigint").alias("low"), F.floor(most).cast("bigint").alias("high"))
    windows = near.groupBy("_ask").agg(F.sort_array(F.collect_list(pair)).alias("_pairs"))  # at most `positives`
    none = F.struct(F.lit(HIGHEST).cast("bigint").alias("low"), F.lit(LOWEST).cast("bigint").alias("high"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("_pairs", i).dropFields("_place"), none))
    asks = anchors_.join(windows, F.col("_row") == F.col("_ask")).withColumn("_ends", filled)
    asks = asks.select("_row", "_id", "_label", "_v", F.col("_ends.low").alias("_low"), F.col("_ends.high").alias("_high"))
    asks = stage(asks)
    found = best_in_windows(dealt, cells, asks, scale, negatives, False, tree)
    pairs = near.withColumnRenamed("_ask", "_of").join(asks.select(F.col("_row").alias("_anchor"), F.col("_id").alias("anchor_id")), F.col("_of") == F.col("_anchor"))
    return found.join(pairs, (F.col("_ask") == F.col("_of")) & (F.col("_window") == F.col("_place"))).select(
        "anchor_id", "positive_id", F.col("_rank").alias("rank"), F.col("_id").alias("negative_id"), "positive_score", F.col("_score").alias("negative_score")
    )

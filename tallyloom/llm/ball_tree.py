"""Exact top-k by inner product: a ball tree per unit, searched by branch and bound."""

from __future__ import annotations

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
    inner,
    numeric_vectors,
)

LEAF = 256


class BallTree:
    """Halves of halves of a unit's vectors, each in a ball around its mean.

    A node is split across its two most distant members, as found from any one, at the median
    of the projections. Equal vectors split as well, so every leaf is small.
    """

    def __init__(self, members: Members, leaf: int = LEAF):
        self.members = members
        self.centre, self.radius, self.least, self.parent, self.leaves = [], [], [], [], []
        stack = [(np.arange(len(members.ids)), -1)]
        while stack:
            at, parent = stack.pop()
            node, values = len(self.parent), members.values[at]
            centre = values.mean(axis=0)
            apart = np.linalg.norm(values - centre, axis=1)
            self.parent.append(parent)
            self.centre.append(centre)
            self.radius.append(apart.max())
            self.least.append(members.ids[at].min())
            if len(at) <= leaf:
                self.leaves.append((node, np.sort(at)))
                continue
            one = values[apart.argmax()]
            other = values[np.linalg.norm(values - one, axis=1).argmax()]
            order = np.argsort(values @ (other - one), kind="stable")
            half = len(at) // 2
            stack += [(at[order[:half]], node), (at[order[half:]], node)]
        self.centre, self.radius, self.least = np.array(self.centre), np.array(self.radius), np.array(self.least)

    def bounds(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest score that each query can have in each node: ``q c`` less and plus ``|q| r``.

        A node's bounds are no wider than its parent's. Scores are whole, so the upper bound is
        rounded down, after a little room for rounding errors.
        """
        middle = values @ self.centre.T
        reach = np.linalg.norm(values, axis=1)[:, None] * self.radius
        room = 1e-9 * (np.abs(middle) + reach) + 1e-6
        low, high = (np.clip(x, LOWEST, HIGHEST) for x in (np.ceil(middle - reach - room), np.floor(middle + reach + room)))
        for node, parent in enumerate(self.parent[1:], 1):
            np.minimum(high[:, node], high[:, parent], out=high[:, node])
            np.maximum(low[:, node], low[:, parent], out=low[:, node])
        return low, high

    def search(self, lanes: Lanes, best: Best) -> None:
        """Leaves in the order of their upper bound, until it is below the current k-th score.

        Every query takes its next best leaf, then the next two, four and so on; queries that
        are at the same leaf are scored together.
        """
        low, high = self.bounds(lanes.values)
        nodes = np.array([node for node, _ in self.leaves])
        low, high = low[:, nodes], high[:, nodes]
        order = np.argsort(-high, axis=1, kind="stable")
        active, at, width = np.arange(len(order)), 0, 1
        while len(active) and at < len(nodes):
            mine = order[active, at : at + width]
            for leaf in np.unique(mine):
                who = active[(mine == leaf).any(axis=1)]
                open_ = best.beats(who, high[who, leaf], self.least[nodes[leaf]]) & (low[who, leaf] <= best.high[who])
                who = who[open_]
                if len(who):
                    own = self.leaves[leaf][1]
                    scores = inner(lanes.values[who], self.members.values[own])
                    best.offer(who, scores, self.members.ids[own], lanes.allowed(who, self.members, own))
            at, width = at + width, 2 * width
            if at < len(nodes):
                active = active[high[active, order[active, at]] >= best.floor(active)]


def top_inner_products(
    rows: DataFrame,
    queries: Column,
    k: int = 10,
    scale: int = 1024,
    key: str = "vec_id",
    vector: str = "embedding",
    unit_rows: int = UNIT_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows where ``queries`` holds, the ``k`` best other rows.

    Components become ``floor(scale * x)``; the score is the integer inner product, ties go to
    the smaller key. Vectors are dealt into units by nearest pivot; a unit's ball tree is searched
    with the k-th score that the query has reached so far, there or in the first wave (see
    ``vectors.best_in_windows``). Nothing is approximate: a node is left out only if its upper
    bound is below that score.

    Rows with a null key, a null vector, or a null or non-finite component take no part. Vectors
    of different lengths are compared as if the shorter one went on with zeros; an empty one has
    the score 0 with all. Repeated rows are rows: each is a candidate of the others, and a query.
    Scores beyond 64 bits count as the largest or smallest. An empty table, or one without
    queries, has an empty result. Other columns are ignored whatever their names.
    """
    marked = rows.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"), F.coalesce(queries, F.lit(False)).cast("int").alias("_asks"))
    # The label column of the search carries whether a row is a query; hits have any label.
    taken = numeric_vectors(marked, "_key", "_vector", F.col("_asks"))
    dealt, cells = deal(taken, scale, unit_rows)
    open_ends = [F.array(F.lit(end).cast("bigint")).alias(name) for end, name in ((LOWEST, "_low"), (HIGHEST, "_high"))]
    asks = taken.where(F.col("_label") == 1).select("_row", "_id", "_label", "_v", *open_ends)
    found = best_in_windows(dealt, cells, asks, scale, k, None, lambda members: BallTree(members).search)
    names = asks.select(F.col("_row").alias("_of"), F.col("_id").alias("query_id"))
    return found.join(names, F.col("_ask") == F.col("_of")).select(
        "query_id", F.col("_rank").alias("rank"), F.col("_id").alias("vec_id"), F.col("_score").alias("score")
    )

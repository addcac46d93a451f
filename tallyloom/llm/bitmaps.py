"""Sets of hashes as bitmaps of a fixed size, to be sent to tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bits:
    """A set of hashes as a bitmap: never denies a member, may admit others."""

    def __init__(self, cells: np.ndarray, size: int):
        self.cells, self.size = cells, np.uint64(size)

    def has(self, values: np.ndarray) -> np.ndarray:
        bit = values % self.size
        return (self.cells[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(hashes: DataFrame, column: str, size: int) -> Bits:
    """The bitmap of a column of hashes; ``size``, a power of two, bounds what reaches the driver."""
    bit = F.col(column).bitwiseAND(F.lit(size - 1))
    cell = F.shiftright(bit, 6).cast("int")
    one = F.expr(f"shiftleft(1L, cast({column} & 63L AS int))")
    found = hashes.groupBy(cell.alias("cell")).agg(F.bit_or(one).alias("bits")).toArrow()
    cells = np.zeros(size // 64, dtype=np.uint64)
    cells[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Bits(cells, size)

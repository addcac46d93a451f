"""Words of whole Arrow batches as numpy arrays, used inside tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
# Bytes whose powers are kept between calls, at least.
ROOM = 1 << 22
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

# Byte classes of the two kinds of words: anything but blanks, and ASCII letters and digits
# together with every byte of a longer UTF-8 character.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
NOT_BLANK = np.array([b not in BLANKS for b in range(256)])
ALNUM = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, room: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``room`` bytes of text or items of a list, so arrays stay small."""
    if not len(batch):
        return
    column = batch.column(text)
    sizes = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(sizes) - sizes) // room
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def lean_slices(batches: Iterator[pa.RecordBatch], text: str, room: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``slices`` of every batch; what Arrow holds unused goes back to the system after each batch.

    A Python worker outlives its tasks, and what it keeps is missing in later stages.
    """
    for batch in batches:
        yield from slices(batch, text, room)
        pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, least: int = ROOM):
    """Starts, ends, row and 64-bit hash of every word of lower-cased texts laid end to end.

    The hash is a polynomial over the bytes taken from one running sum, so it costs a few vector
    operations per byte and no Python object per word. Its two tables of powers stay for later calls, 16
    bytes for each byte of the longest ``data``; ``least``, a power of two, keeps them at one size.
    """
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if not n:
        return none, none, none, np.zeros(0, dtype=np.uint64)
    data = LOWER[data]
    inside = wanted[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    room = max(least, 1 << (n + 1).bit_length())
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_letters()[data] * _powers(BASE, room)[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(INVERSE, room)[starts])
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows, hashes


def grams(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of ``k`` words inside one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    value = hashes[at].copy()
    for step in range(1, k):
        value = value * np.uint64(BASE) + hashes[at + step]
    return at, mix(value)


def block_choices(blocks: int, agree: int) -> list[tuple[int, ...]]:
    return list(combinations(range(blocks), agree))

"""Sorted numbers as gaps between them, in ranges that are shuffled whole: few bytes a number."""

from __future__ import annotations

import numpy as np

SHORT = 40


def bytes_apart(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all first bytes before all second ones and so on: small ones then compress well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def together(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def range_size(parts: int) -> int:
    """How many keys of ``SHORT`` bits each of ``parts`` ranges covers."""
    return -(-(1 << SHORT) // parts)


def cut(keys: np.ndarray, parts: int) -> list[tuple[int, slice, bytes]]:
    """The range, the place and the gaps of every run of ascending ``keys`` that lies in one range.

    Gaps are two halves of 32 bits; the upper ones are mostly zero.
    """
    room = range_size(parts)
    part = keys // room
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)]
    out = []
    for a, b in zip(edges, edges[1:]):
        if a < b:
            gaps = np.diff(keys[a:b], prepend=part[a] * room)
            out.append((int(part[a]), slice(a, b), bytes_apart(np.concatenate([gaps & 0xFFFFFFFF, gaps >> 32]))))
    return out


def uncut(raw: bytes, part: int, parts: int) -> np.ndarray:
    """The keys of a run."""
    low, high = together(raw).reshape(2, -1)
    return part * range_size(parts) + np.cumsum(low + (high << 32))

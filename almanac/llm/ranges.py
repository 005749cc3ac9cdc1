"""Ascending hashes, packed by difference and cut into ranges of the hash space.

Operators that ask "which of my hashes occur elsewhere" send each range of them to one place
and get an answer in the same order, so neither the hashes' owners nor their places travel.
"""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray) -> bytes:
    """Ascending numbers by their differences, each in as many bytes as the largest needs (told first)."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def cuts(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal parts of the space of ``bits`` bits begins among the ascending keys."""
    edges = [(r << bits) // ranges for r in range(ranges)]
    return np.append(np.searchsorted(keys, np.array(edges, np.uint64)), len(keys))

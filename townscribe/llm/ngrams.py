"""Hashed n-grams of batches of texts with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MULTIPLY = np.uint32(0x01000193)
SPREAD = np.uint32(0x9E3779B1)


def hashed(units: np.ndarray, lengths: range, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each n of ``lengths`` the bucket (under 2^bits) of the n-gram that starts at each place; units are numbers."""
    h = np.zeros(len(units), dtype=np.uint32)
    x = units.astype(np.uint32)
    for n in range(1, lengths.stop):
        if len(x) < n:
            return
        h = h[: len(x) - n + 1] * MULTIPLY ^ (x[n - 1 :] + np.uint32(n))
        if n in lengths:
            out = h * SPREAD
            yield n, ((out ^ (out >> np.uint32(15))) * SPREAD) >> np.uint32(32 - bits)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def code_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)

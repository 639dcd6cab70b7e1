"""Word and shingle hashes of whole batches of texts with numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
STEP = U(0xD1342543DE82EF95)
WIDTH = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    if n:
        out[0] = U(1)
    return np.cumprod(out, dtype=U)


class Hasher:
    """Hashes the words (runs of anything but ASCII white space) of batches of texts."""

    def __init__(self) -> None:
        self.inverse = U(pow(int(BASE), -1, 2**64))
        self.pow = self.inv = np.zeros(0, dtype=U)

    def words(self, texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and where each text's words begin (one entry more than texts)."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        if lower:
            raw = [x.lower() for x in raw]  # of bytes: A to Z only
        joined = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
        ends = np.cumsum([len(x) + 1 for x in raw]) if raw else np.zeros(0, dtype=np.int64)
        if len(joined) > len(self.pow):
            n = 2 * len(joined) + 1
            self.pow, self.inv = _powers(BASE, n), _powers(self.inverse, n)
        space = _SPACE[joined]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        first, past = edge[::2], edge[1::2]
        total = np.zeros(len(joined) + 1, dtype=U)
        np.cumsum((joined.astype(U) + U(1)) * self.pow[: len(joined)], out=total[1:])
        hashes = mix((total[past] - total[first]) * self.inv[first] + (past - first).astype(U))
        bounds = np.concatenate([[0], np.searchsorted(first, ends)]).astype(np.int64)
        return hashes, bounds


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one array (empty if it is shorter)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    # doubling: a run of 2k words is a run of k words followed by the next run of k words
    done, out, size, run = 0, None, 1, h
    while width:
        if width & 1:
            part = run[done : done + n]
            out = part if out is None else mix(out * STEP + part)
            done += size
        width >>= 1
        if width:
            run = mix(run[:-size] * STEP + run[size:])
            size *= 2
    return out


def shingle_set(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes; a shorter text is one shingle."""
    if not len(h):
        return np.zeros(0, dtype=U)
    s = windows(h, min(width, len(h)))
    s = np.sort(s)
    return s[np.concatenate([[True], s[1:] != s[:-1]])]

"""Vectorised work on batches of texts as UTF-8 bytes: words, hashes and shingles.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Everything
here costs a few numpy passes over the bytes, with no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that one numpy pass handles; a longer single text is handled alone.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the hash base and of its inverse, kept for the longest buffer so far."""

    def __init__(self) -> None:
        self.size = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            size = max(n, 2 * SLICE_BYTES)
            self.up = _powers(size, int(_BASE))
            self.down = _powers(size, pow(int(_BASE), -1, 2**64))
            self.size = size
        return self.up, self.down


_POWERS = _Powers()


class Batch:
    """Several texts laid end to end with a newline after each.

    data: the bytes; ends: each text's end in data (its newline);
    starts: each text's first byte.
    """

    def __init__(self, texts: list[str | None], lower: bool = False) -> None:
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
        self.data = _LOWER[data] if lower else data
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.n = len(texts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words in data, and for each text the index of its first word
        (one more entry than texts)."""
        space = _SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        begin, end = edge[::2], edge[1::2]
        first = np.searchsorted(begin, np.concatenate((self.starts, [len(self.data)])))
        return begin, end, first

    def word_hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands."""
        up, down = _POWERS.get(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[self.data] * up[: len(self.data)], out=total[1:], dtype=np.uint64)
        return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _ODD)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words inside each text, and each text's first run
    (one more entry than texts).  A text of fewer words, but one at least, has one run: all its words."""
    n_words = np.diff(first)
    n_runs = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    offset = np.concatenate(([0], np.cumsum(n_runs)))
    if not offset[-1]:
        return np.zeros(0, dtype=np.uint64), offset
    at = np.arange(offset[-1]) - np.repeat(offset[:-1] - first[:-1], n_runs)
    limit = np.repeat(first[1:], n_runs)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        here = at + k
        word = np.where(here < limit, hashes[np.minimum(here, len(hashes) - 1)], np.uint64(0))
        out = out * _BASE + word + np.uint64(k + 1)
    return mix(out), offset


def slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters each, so that numpy's temporaries stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def in_slices(column, limit: int = SLICE_BYTES, rows: int = 512) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of an Arrow column in slices of about `limit` characters, each with its first row's number.

    Only some rows at a time become Python strings, so that a batch of many long texts isn't held twice.
    """
    for a in range(0, len(column), rows):
        texts = column.slice(a, rows).to_pylist()
        for x, y in slices(texts, limit):
            yield a + x, texts[x:y]

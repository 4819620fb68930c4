"""Vectorised hashing of bytes, words and shingles over a batch of texts (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Two independent rolling hashes: odd bases, and a random 64-bit value for each byte, from fixed seeds.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BYTES = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) for seed in (1234567, 7654321)]
#: Lower case for A to Z, other bytes unchanged.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: White space between words: space and the controls 9 to 13.
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """base**i and base**-i modulo 2**64, as long as needed."""

    def __init__(self, base: int):
        self.base, self.back = _U(base), _U(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            one = np.ones(n, np.uint64)
            one[1:] = self.base
            self.up = np.multiply.accumulate(one)
            one[1:] = self.back
            self.down = np.multiply.accumulate(one)
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in _BASES]


class Rolling:
    """Hash of any byte range of a buffer in constant time, after one pass."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data) + 1
        up, self.down = _POWERS[which].get(n)
        self.down = self.down[:n]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTES[which][data] * up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the ranges [start, end), their lengths included."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all ranges of k bytes."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values: block-wise prefix and suffix minima."""
    n = len(x)
    if w == 1:
        return x.copy()
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    pre = np.minimum.accumulate(full, axis=1).ravel()
    suf = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def chunks(batch: pa.RecordBatch, column: str, limit: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``limit`` text bytes each: (slice, bytes, offsets); null is empty."""
    texts = batch.column(column)
    texts = (texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts).fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and len(texts) else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` text bytes each, one row at least."""
    for part, _, _ in chunks(batch, column, limit):
        yield part


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of a chunk, and for each text where its words begin (n + 1 offsets)."""
    space = _SPACE[data]
    joined = np.zeros(len(data) + 1, bool)  # a word also starts where a text starts
    joined[off] = True
    begin = ~space
    begin[1:] &= space[:-1] | joined[1:-1]
    starts = np.flatnonzero(begin)
    stop = np.flatnonzero(~space & np.append(space[1:] | joined[1:-1], True)) + 1 if len(data) else starts
    hashes = Rolling(LOWER[data] if lower else data).of(starts, stop)
    return hashes, np.searchsorted(starts, off)


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and their text; a text of fewer words is one shingle."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - first[text]
    size = n[text]
    out = np.zeros(len(words), np.uint64)
    for j in range(k):
        w = np.zeros(len(words), np.uint64)
        w[: max(0, len(words) - j)] = words[j:]
        ok = place + j < size
        out = np.where(ok, mix(out + w), out)
    keep = (place + k <= size) | (place == 0)
    return out[keep], text[keep]

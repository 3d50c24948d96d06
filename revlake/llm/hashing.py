"""64-bit hashes of stretches of byte arrays, and the sets of word shingles made from them."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@cache
def _random() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD1342543DE82EF95
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """64-bit hashes of any stretch of an array of bytes."""

    def __init__(self, b: np.ndarray):
        self.up, self.down = _powers(1 << max(20, (len(b) + 1).bit_length()))
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_random()[b] * self.up[: len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of `words` words (of all its words, if fewer). Words are runs of bytes
    other than 0x20 and 0x09-0x0D; A-Z count as a-z."""
    body = [(t or "").encode() for t in texts]
    b = np.frombuffer(b"\x20".join(body), np.uint8)
    if not len(b):
        return [np.zeros(0, np.uint64)] * len(texts)
    b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = (b != 0x20) & ((b < 0x09) | (b > 0x0D))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(x) + 1 for x in body])
    first = np.searchsorted(start, np.concatenate([[0], ends]))
    h = Hashes(b).of(start, end)
    run = np.zeros(len(h), np.uint64)
    n = len(h) - words + 1
    if n > 0:
        for k in range(words):
            run[:n] = mixed(run[:n] * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= words:
            out.append(np.unique(run[i : j - words + 1]))
        elif j > i:
            x = np.uint64(j - i)
            for y in h[i:j]:
                x = mixed(np.array([x], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + y)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(batch: pa.RecordBatch, column: int, most: int = 2_000_000):
    """The batch in parts of at most `most` bytes of text, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto

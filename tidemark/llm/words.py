"""Words and shingles of text batches as numpy arrays of 64-bit hashes.

A word is a run of bytes other than ASCII white space. Its hash is a polynomial
in its bytes modulo 2**64, read off two prefix sums, then mixed; so a batch is
hashed without a Python step per word. Texts go through in blocks of about
``BLOCK`` bytes, cut at white space, which bounds the working memory however
long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GAMMA = np.uint64(0x9E3779B97F4A7C15)
#: Bases of the two hash lanes.
BASES = (0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _GAMMA)


class Powers:
    """B**i and B**-i modulo 2**64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.n = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1024)
            self.up = self._table(self.base)
            self.down = self._table(pow(self.base, -1, 1 << 64))
        return self.up, self.down

    def _table(self, base: int) -> np.ndarray:
        out, have = np.ones(self.n, np.uint64), 1
        while have < self.n:
            more = min(have, self.n - have)
            out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
            have += more
        return out


_POWERS = {b: Powers(b) for b in BASES}


def polynomial(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hash of values[s:e] for every pair, equal for equal contents."""
    up, down = _POWERS[base].upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column's values in UTF-8, nulls as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def few_texts(batch: pa.RecordBatch, column: int, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(part of the batch, its texts as bytes), ``rows`` at a time, so that no second
    copy of a whole batch is made."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, as_bytes(part.column(column))


def pieces(text: bytes) -> Iterator[bytes]:
    """``text`` cut at white space into parts of little over BLOCK bytes."""
    at = 0
    while len(text) - at > BLOCK:
        stop = at + BLOCK
        while stop < len(text) and not SPACE[text[stop]]:
            stop += 1
        yield text[at:stop]
        at = stop
    yield text[at:] if at else text


def slices(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes together."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``."""
    edge = np.ones(len(data) + 2, bool)
    edge[1:-1] = SPACE[data]
    change = np.flatnonzero(edge[1:] != edge[:-1])
    return change[::2], change[1::2]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets: text i has words offsets[i]:offsets[i+1])."""
    hashes, counts = [], np.zeros(len(texts) + 1, np.int64)
    block: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal block, owner, size
        data = np.frombuffer(b" ".join(block), np.uint8)
        starts, ends = bounds(data)
        raw = polynomial(data.astype(np.uint64), starts, ends)
        hashes.append(mix(raw + (ends - starts).astype(np.uint64) * _GAMMA))
        edges = np.cumsum([len(b) + 1 for b in block])
        np.add.at(counts, np.array(owner) + 1, np.diff(np.searchsorted(starts, edges), prepend=0))
        block, owner, size = [], [], 0

    for i, text in enumerate(texts):
        for part in pieces(text):
            block.append(part)
            owner.append(i)
            size += len(part) + 1
            if size > BLOCK:
                flush()
    if block:
        flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words within a text, and their offsets; a
    shorter text that has words counts as one shingle."""
    n = np.diff(offsets)
    total = len(words)
    if total >= width:
        run = np.zeros(total - width + 1, np.uint64)
        for j in range(width):
            run = run * np.uint64(BASES[1]) + words[j : total - width + 1 + j]
        run = mix(run)
    else:
        run = np.zeros(0, np.uint64)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(out_offsets[-1], np.uint64)
    for i in np.flatnonzero(count):
        at, stop = out_offsets[i], out_offsets[i + 1]
        if n[i] >= width:
            out[at:stop] = run[offsets[i] : offsets[i] + count[i]]
        else:
            out[at] = mix(polynomial(words[offsets[i] : offsets[i + 1]], np.array([0]), np.array([n[i]])) + np.uint64(n[i]))[0]
    return out, out_offsets

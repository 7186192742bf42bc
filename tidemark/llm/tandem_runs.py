"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of consecutive words of one text with smallest period q that no
neighbouring word extends; those of ``LEAST`` words or more and at least three
periods are found, each whole.

1. A run's windows of ``window(LEAST)`` words all occur twice in its text, so only
   stretches of such windows are looked at. That is exact: a run of three periods
   has its window again one period earlier or later.
2. The stretches of a batch stand in one string, a symbol of its own after each.
   Names of all substrings of power-of-two length give common extensions both
   ways, the suffix array and its common prefixes (the suffix tree's intervals).
3. Lempel-Ziv blocks: squares that end in a block or reach over its start are
   found by extending both ways from the block's edges, which covers every square
   leftmost; squares of squares are left out.
4. Walks complete the vocabulary: a square is rotated along its own occurrence as
   far as that goes, then by the suffix link, down by its first word, as long as
   the tree has such a place that is not marked.
5. All occurrences of the vocabulary, read off their intervals, merge into runs.

Defined cases: a null or empty text has no words and no runs; repeated rows are
rows of their own; other columns are ignored; an empty table gives an empty result.
A text is handled within one task, with about 200 bytes a word of its repeated
stretches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words

LEAST = 24
PERIODS = 3
#: Bytes of text that are worked on at once.
CHUNK = 1 << 22
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def window(least: int) -> int:
    return (least + 2) // 3


def ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place within the owner) of sum(counts) items."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Tree:
    """A string's names, suffix array and common prefixes, with the intervals of its suffix tree."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.n = n = len(symbols)
        distinct, first = np.unique(symbols, return_inverse=True)
        self.names = [np.append(first.astype(np.int32), np.int32(-1))]
        while len(distinct) < n:
            step, last = 1 << (len(self.names) - 1), self.names[-1]
            after = np.full(n, -1, np.int64)
            after[: n - step] = last[step:n]
            distinct, name = np.unique(last[:n].astype(np.int64) * (n + 1) + after + 1, return_inverse=True)
            self.names.append(np.append(name.astype(np.int32), np.int32(-1)))
        self.rank = self.names[-1][:n]
        self.sa = np.empty(n, np.int64)
        self.sa[self.rank] = np.arange(n)
        prefix = np.full(2 * n + 2, -1, np.int32)
        prefix[1:n] = self.forward(self.sa[:-1], self.sa[1:])
        #: least[j][r]: the least common prefix of neighbours r - 2**j + 1 .. r
        self.least = [prefix]
        while 1 << len(self.least) <= n:
            step, low = 1 << (len(self.least) - 1), self.least[-1].copy()
            low[step:] = np.minimum(low[step:], low[:-step])
            low[:step] = -1
            self.least.append(low)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from a and b (different places) on."""
        a, b = a.copy(), b.copy()
        begin = a.copy()
        for j in reversed(range(len(self.names))):
            same = self.names[j][a] == self.names[j][b]
            a += same << j
            b += same << j
        return a - begin

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree before a and b, a < b."""
        a, b = a.copy(), b.copy()
        begin = a.copy()
        for j in reversed(range(len(self.names))):
            step = 1 << j
            same = (a >= step) & (self.names[j][np.maximum(a - step, 0)] == self.names[j][np.maximum(b - step, 0)])
            a -= same << j
            b -= same << j
        return begin - a

    def low(self, place: np.ndarray, length: np.ndarray) -> np.ndarray:
        """First rank of the interval of suffixes that share ``length`` words with ``place``'s."""
        r = self.rank[place].astype(np.int64)
        for j in reversed(range(len(self.least))):
            r -= (self.least[j][r] >= length) << j
        return r

    def high(self, r: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Last rank of that interval, from any rank in it."""
        r = r.astype(np.int64)
        for j in reversed(range(len(self.least))):
            r += (self.least[j][np.minimum(r + (1 << j), 2 * self.n)] >= length) << j
        return r

    def child(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """First rank in low..high whose suffix has ``symbol`` (a first name) at ``depth``; -1 without one."""
        name, a, b = self.names[0], low.copy(), high + 1
        while len(a) and (a < b).any():
            mid = np.minimum((a + b) >> 1, high)
            less = (a < b) & (name[self.sa[mid] + depth] < symbol)
            a, b = np.where(less, mid + 1, a), np.where((a < b) & ~less, mid, b)
        at = np.minimum(a, high)
        return np.where((a <= high) & (name[self.sa[at] + depth] == symbol), at, -1)

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks, and the length last."""
        n = self.n
        before, after = np.arange(-1, n).tolist(), np.arange(1, n + 2).tolist()
        left, right = [-1] * n, [-1] * n
        for i, r in zip(range(n - 1, -1, -1), self.rank[::-1].tolist(), strict=True):  # later places have been taken out
            p, q = before[r], after[r]
            left[i], right[i] = p, q
            if p >= 0:
                after[p] = q
            before[q] = p
        factor = np.zeros(n, np.int64)
        for near in (np.array(left), np.array(right)):
            has = np.flatnonzero((near >= 0) & (near < n))
            factor[has] = np.maximum(factor[has], self.forward(has, self.sa[near[has]]))
        steps, out, i = np.maximum(factor, 1).tolist(), [], 0
        while i < n:
            out.append(i)
            i += steps[i]
        return np.array([*out, n])

    def covering(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, half length) of primitive squares that cover all squares leftmost."""
        edges, n, name = self.blocks(), self.n, self.names[0]
        h, h1 = edges[:-1], edges[1:]
        h2 = np.append(edges[2:], n)
        owner, place = ranges(np.where(h1 < n, h1 - h, 0))  # reach over the block's end
        k = place + 1
        hit = name[h1[owner]] == name[h1[owner] - k]
        k, a = k[hit], h1[owner[hit]]
        q = a - k
        ahead, back = self.forward(q, a), self.backward(q, a)
        start = np.maximum(q - back, q - k + 1)
        ok = ahead + back >= k
        found = [(start[ok], k[ok])]
        owner, place = ranges(np.minimum(h2, n) - h)  # reach over the block's start
        k = place + 1
        hit = h[owner] + k < n
        owner, k = owner[hit], k[hit]
        hit = name[h[owner]] == name[h[owner] + k]
        k, a, end = k[hit], h[owner[hit]], h1[owner[hit]]
        ahead, back = self.forward(a, a + k), self.backward(a, a + k)
        start = np.maximum(a - back, a - k + 1)
        ok = (ahead + back >= k) & (back > 0) & (start + k <= end)
        found.append((start[ok], k[ok]))
        start, k = (np.concatenate(x) for x in zip(*found, strict=True))
        start, k = np.divmod(np.unique(start * (n + 1) + k), n + 1)
        whole = self.primitive(start, k)
        return start[whole], k[whole]

    def primitive(self, start: np.ndarray, k: np.ndarray) -> np.ndarray:
        """True where the k words from start are not a power."""
        out = np.ones(len(k), bool)
        if not len(k):
            return out
        factor = np.arange(int(k.max()) + 1)
        for p in range(2, int(len(factor) ** 0.5) + 1):
            if factor[p] == p:
                part = factor[p * p :: p]
                part[part == np.arange(p * p, len(factor), p)] = p
        rest = k.copy()
        while (rest > 1).any():
            at = np.flatnonzero(rest > 1)
            p = factor[rest[at]]
            d = k[at] // p
            out[at] &= self.forward(start[at], start[at] + d) < k[at] - d
            rest[at] //= p
        return out

    def vocabulary(self) -> tuple[np.ndarray, np.ndarray]:
        """(first rank of its interval, half length) of every primitive square."""
        start, k = self.covering()
        n, marked = self.n, np.zeros(0, np.int64)
        while len(start):
            along = np.minimum(self.forward(start, start + k) - k, k - 1)
            owner, turn = ranges(along + 1)
            place, half = start[owner] + turn, k[owner]
            mark = self.low(place, 2 * half) * (n + 1) + half
            fresh = ~np.isin(mark, marked)
            marked = np.union1d(marked, mark)
            tail = np.cumsum(along + 1) - 1
            on = fresh[tail] & (along < k - 1)
            place, half = place[tail][on], half[tail][on]
            inner = place + 1  # the suffix link drops the first word, which must follow at the end
            low = self.low(inner, 2 * half - 1)
            at = self.child(low, self.high(low, 2 * half - 1), 2 * half - 1, self.names[0][place])
            start, k = self.sa[at[at >= 0]], half[at >= 0]
            new = ~np.isin(self.low(start, 2 * k) * (n + 1) + k, marked)
            start, k = np.divmod(np.unique(start[new] * (n + 1) + k[new]), n + 1)
        return np.divmod(marked, n + 1)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, smallest period) of all runs of two periods or more, by period, then start."""
        low, k = self.vocabulary()
        owner, turn = ranges(self.high(low, 2 * k) - low + 1)
        k, place = np.divmod(np.sort(k[owner] * (self.n + 1) + self.sa[low[owner] + turn]), self.n + 1)
        first = np.ones(len(k), bool)
        first[1:] = (k[1:] != k[:-1]) | (place[1:] != place[:-1] + 1)
        last = np.append(first[1:], True)[: len(k)]
        return place[first], place[last] + 2 * k[last] - place[first], k[first]


def stretches(texts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of the stretches whose every window occurs again in its
    text, and the number of words of each text."""
    hashes, offsets = words.word_hashes(texts)
    n, width = np.diff(offsets), window(least)
    if len(hashes) < least:
        none = np.zeros(0, np.int64)
        return none, none, none, n
    total = len(hashes) - width + 1
    key = np.zeros(total, np.uint64)
    for j in range(width):
        key = key * np.uint64(words.BASES[1]) + hashes[j : total + j]
    text = np.repeat(np.arange(len(texts)), n)[:total]
    inside = np.arange(total) + width <= offsets[1:][text]
    key = words.mix(words.mix(key) + words.mix(text.astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(key[inside])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    again = np.zeros(total + 2, bool)  # with an edge on both sides
    if len(twice):
        at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        again[1:-1] = inside & (twice[at] == key)
    edge = np.flatnonzero(again[1:] != again[:-1])
    # two texts' windows never touch: the last windows before a text's end are not inside
    start, stop = edge[::2], edge[1::2] + width - 1
    long = stop - start >= least
    start, stop = start[long], stop[long]
    owner = text[start] if len(start) else start
    return owner, start - offsets[owner], stop - offsets[owner], n


def find(texts: list[bytes], least: int = LEAST) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """(runs as (start, length, period) by start, then period, of each text; numbers of words)."""
    owner, start, stop, n = stretches(texts, least)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(owner):
        return out, n
    known: dict[bytes, int] = {}
    symbols, begins, at, held, split = [], [], 0, -1, []
    for i, (t, s, e) in enumerate(zip(owner.tolist(), start.tolist(), stop.tolist(), strict=True)):
        if t != held:
            held, split = t, texts[t].split()
        begins.append(at)
        symbols.append(np.array([*(known.setdefault(w, len(known)) for w in split[s:e]), -1 - i]))
        at += e - s + 1
    place, length, period = Tree(np.concatenate(symbols)).runs()
    keep = length >= np.maximum(least, PERIODS * period)
    place, length, period = place[keep], length[keep], period[keep]
    part = np.searchsorted(begins, place, side="right") - 1
    begin = place - np.array(begins)[part] + start[part]
    for t, run in sorted(zip(owner[part].tolist(), zip(begin.tolist(), length.tolist(), period.tolist(), strict=True), strict=True)):
        out[t].append(run)
    return out, n


def collapse(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    split = text.split()
    if runs:
        keep = np.ones(len(split), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        split = [split[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(split)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, collapsed (the text without the
    repeats of its runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in (x for b in batches for x in words.few_texts(b, 1, 4096)):
            for s, e in words.slices(texts, CHUNK):
                found, n = find(texts[s:e], least)
                rows = [[{"start": a, "length": b, "period": c} for a, b, c in r] for r in found]
                cells = [batch.column(0).slice(s, e - s), pa.array(n, pa.int64()), pa.array(rows, _RUNS), pa.array(list(map(collapse, texts[s:e], found)), pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cells, ["doc_id", "n_words", "runs", "collapsed"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where the texts whose crc32 of the id ends in 0 are made periodic
    from a place on that the id tells. A text of a null id stays as it is."""

    def periodic(doc_id: int | None, text: bytes) -> bytes:
        if doc_id is None or (h := zlib.crc32(str(doc_id).encode())) % 10 or not (split := text.split()):
            return text
        g, n = h // 10, len(split)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        cycle = split[a : a + p]
        return b" ".join(split[:a] + (cycle * (-(-(n - a) // p)))[: n - a])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in (x for b in batches for x in words.few_texts(b, 1, 4096)):
            done = map(periodic, batch.column(0).to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(done), pa.binary()).cast(pa.string())], ["doc_id", "text"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, text string")


def strongest(runs: str) -> Column:
    """The run of greatest length / period, compared exactly; ties: least start, then period."""

    def better(best: Column, r: Column) -> Column:
        more, most = r["length"] * best["period"], best["length"] * r["period"]
        first = (r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"]))
        return F.when(best.isNull() | (more > most) | ((more == most) & first), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)

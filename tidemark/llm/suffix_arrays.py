"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classed as S (smaller than the next one) or L. The leftmost S
substrings (from one leftmost S place to the next) are sorted by one induction,
named, and sorted as suffixes by doubling over their names; a second induction
orders all suffixes. An induction goes bucket by bucket with array
operations: all that enters a bucket from smaller ones is known when its turn
comes, and runs of the bucket's own byte are unrolled in rounds. Where only so many
bytes of a suffix count, doubling ends there, and the induction keeps that order.
"""

from __future__ import annotations

import numpy as np


def s_types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it; the last is not."""
    n = len(t)
    rises = t[:-1] < t[1:]
    decided = np.append(np.flatnonzero(t[:-1] != t[1:]), n - 1)
    last = np.append(rises, False)
    return np.repeat(last[decided], np.diff(decided, prepend=-1))


def leftmost(is_s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def _unroll(seeds: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The seeds, then each one's predecessors in its run: first all nearest ones, then the next."""
    back = run[seeds]
    if not back.any():
        return seeds
    total = back + 1
    each = np.repeat(np.arange(len(seeds)), total)
    depth = np.arange(len(each)) - np.repeat(np.cumsum(total) - total, total)
    return (seeds[each] - depth)[np.argsort(depth, kind="stable")]


def _send(from_: np.ndarray, t: np.ndarray, c: int, up: bool, pending: list[list[np.ndarray]]) -> None:
    """Deals the predecessors whose byte is above (below) c to their buckets."""
    before = from_[from_ > 0] - 1
    byte = t[before]
    chosen = byte > c if up else byte < c
    before, byte = before[chosen], byte[chosen]
    if not len(before):
        return
    order = np.argsort(byte, kind="stable")
    before, byte = before[order], byte[order]
    edges = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
    for s, e, b in zip(edges, [*edges[1:], len(byte)], byte[edges].tolist(), strict=True):
        pending[b].append(before[s:e])


def _run_lengths(t: np.ndarray, is_s: np.ndarray, of_s: bool) -> np.ndarray:
    """How many places just before each hold the same byte and are of the class."""
    n = len(t)
    goes_on = np.zeros(n, bool)
    goes_on[1:] = (t[1:] == t[:-1]) & (is_s[:-1] == of_s)
    at = np.arange(n, dtype=np.int32)
    return at - np.maximum.accumulate(np.where(goes_on, np.int32(0), at))


def induce(t: np.ndarray, is_s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All places in the order that the order ``first`` of leftmost S places induces."""
    n, sigma = len(t), 256
    none = np.zeros(0, np.int64)
    join = lambda parts: np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else none
    edges = np.searchsorted(t[first], np.arange(sigma + 1)) if len(first) else np.zeros(sigma + 1, int)
    used = np.flatnonzero(np.bincount(t, minlength=sigma)).tolist()
    run = _run_lengths(t, is_s, False)
    pending: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    pending[int(t[-1])].append(np.array([n - 1]))
    large: dict[int, np.ndarray] = {}
    for c in used:
        large[c] = _unroll(join(pending[c]), run)
        _send(large[c], t, c, True, pending)
        _send(first[edges[c] : edges[c + 1]], t, c, True, pending)
    run = _run_lengths(t, is_s, True)
    pending = [[] for _ in range(sigma)]
    small: dict[int, np.ndarray] = {}
    for c in reversed(used):
        small[c] = _unroll(join(pending[c]), run)
        _send(small[c], t, c, False, pending)
        _send(large[c][::-1], t, c, False, pending)
    return np.concatenate([x for c in used for x in (large[c], small[c][::-1])])


def names_order(names: np.ndarray, starts: np.ndarray, end: int, depth: int | None) -> np.ndarray:
    """The order of the suffixes of ``names`` (of the substrings at ``starts``), by prefix
    doubling; of those that share ``depth`` bytes or more, the order is open."""
    m = len(names)
    width = m.bit_length()
    rank = np.append(names + 1, 0)  # 0: beyond the end
    live, known = np.arange(m), 0  # a suffix is live while others share its rank, its first ``known`` names
    while len(live):
        after = rank[np.minimum(live + known, m)] if known else 0
        key = (rank[live] << width) + after
        if 3 * width < 64:  # the place goes along in the key, which sorts faster than an index
            key = np.sort((key << width) + np.arange(len(live)))
            live, key = live[key & ((1 << width) - 1)], key >> width
        else:
            order = np.argsort(key, kind="stable")
            live, key = live[order], key[order]
        old = rank[live]
        at = np.arange(len(live))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.maximum.accumulate(np.where(new, at, 0))
        if known:
            base = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
            rank[live] = old + group - base
        else:
            rank[live] = group + 1
        single = new & np.append(new[1:], True)
        known = 2 * known or 1
        live = live[~single]
        if depth is not None:  # equal names are equal bytes, so all of a rank end at once
            live = live[np.append(starts, end)[np.minimum(live + known, m)] - starts[live] < depth]
    return np.sort((rank[:m] << width) + np.arange(m)) & ((1 << width) - 1)


def _ranked(starts: np.ndarray, place: np.ndarray, found: np.ndarray, same: np.ndarray, end: int, depth: int | None) -> np.ndarray:
    """The leftmost S places in suffix order; ``found`` has them by substring, ``same`` marks equal neighbours."""
    name = np.cumsum(~same) - 1
    if name[-1] + 1 == len(starts):
        return found
    names = np.empty(len(starts), np.int64)
    names[place[found]] = name
    return starts[names_order(names, starts, end, depth)]


class Text:
    """Bytes with what comparing their places needs."""

    def __init__(self, data: bytes) -> None:
        self.t = np.frombuffer(data, np.uint8)
        self.n = len(data)
        self.padded = data + bytes(16)
        self.eight = np.ndarray((self.n + 8,), "<u8", self.padded, strides=(1,))

    def common(self, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
        """Length of the common prefix at each pair of places, ``cap`` or more counting as such."""
        length = np.zeros(len(a), np.int64)
        room = self.n - np.maximum(a, b)
        live = np.flatnonzero(room > 0)
        while len(live):
            x = self.eight[a[live] + length[live]] ^ self.eight[b[live] + length[live]]
            length[live] += np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
            live = live[(x == 0) & (length[live] < np.minimum(room[live], cap))]
        return np.minimum(length, room)


def suffix_array(text: Text, depth: int | None = None) -> np.ndarray:
    """All places in the order of their suffixes; with ``depth``, in that of so many bytes
    of them, which keeps places that share these next to each other."""
    t, n = text.t, text.n
    if n < 2:
        return np.arange(n)
    is_s = s_types(t)
    starts = leftmost(is_s)
    if not len(starts):
        return induce(t, is_s, starts)
    rough = starts[np.argsort(t[starts], kind="stable")]
    place = np.full(n, -1, np.int64)
    place[starts] = np.arange(len(starts))
    sorted_ = induce(t, is_s, rough)
    sorted_ = sorted_[place[sorted_] >= 0]
    size = np.diff(starts, append=n) + 1
    own = size[place[sorted_]]
    same = np.zeros(len(sorted_), bool)
    pairs = np.flatnonzero((own[1:] == own[:-1]) & (place[sorted_][1:] < len(starts) - 1) & (place[sorted_][:-1] < len(starts) - 1))
    alike = text.common(sorted_[pairs], sorted_[pairs + 1], int(size.max())) >= own[pairs]
    same[pairs[alike] + 1] = True
    return induce(t, is_s, _ranked(starts, place, sorted_, same, n, depth))


def permuted_common_prefixes(text: Text, sa: np.ndarray, cap: int) -> np.ndarray:
    """By place: the common prefix with the suffix before it in order, ``cap`` or
    more counting as such. Places whose predecessor byte differs from their
    neighbour's are compared; the others lose one byte from place to place."""
    n = text.n
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    follows = np.zeros(n, bool)
    inner = np.flatnonzero((phi > 0) & (at > 0))
    follows[inner] = (text.t[inner - 1] == text.t[phi[inner] - 1]) & (phi[inner - 1] == phi[inner] - 1)
    begin = np.flatnonzero(~follows)
    value = np.zeros(len(begin), np.int64)
    real = phi[begin] >= 0
    longest = np.diff(begin, append=n).max() if len(begin) else 0
    value[real] = text.common(begin[real], phi[begin[real]], int(cap + longest))
    run = np.cumsum(~follows) - 1
    return np.maximum(value[run] - (at - begin[run]), 0)

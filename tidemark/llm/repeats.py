"""Finding repeated windows through winnowed anchors; shared by substring and
suffix-array dedup.

A text is an array of units (words or bytes). Of every window of W units the
k-unit gram of least hash is its anchor, so equal windows have equal anchors at
equal places: joining texts on anchors loses no repeat, at about 2 / (W - k + 2)
rows a unit. The consecutive windows that one anchor leads form its region.
Anchors only bring places together. Regions are the same if a 128-bit
cryptographic digest of their units is; where an anchor has different regions,
the units themselves are compared.

A document is a row key: its id and a mark of its text, so that rows that repeat
an id with other texts stay apart, in order of id, then mark. A cover is
(doc_id, mark, start, n): n units from start are repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import HOT_SHARE, cut, join_hot

#: Stands for a null id in keys; results carry the id itself.
NO_ID = -(1 << 63)
LIMIT = 1 << 20
SALTS = 64
_PLACE = np.uint64((1 << 24) - 1)
DOC = ["doc_id", "mark"]
ROW = "anchor long, d1 long, d2 long, doc_id long, mark long, start int, n int, lead int"
NAMES = [x.split()[0] for x in ROW.split(", ")]
COVER = "doc_id long, mark long, start int, n int"
COVER_NAMES = [x.split()[0] for x in COVER.split(", ")]


def byte_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    return values, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


@dataclass(frozen=True)
class Repeats:
    """``units`` turns texts into (values, offsets). ``every``: all places of a
    repeat are covered, or all but the earliest."""

    units: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    window: int
    gram: int
    every: bool

    def cutter(self, text: bytes) -> Callable[[int, int], bytes]:
        """Function of (first unit, end unit) -> the units' bytes, words joined by one space."""
        if self.units is byte_units:
            return lambda s, e: text[s:e]
        plain = b" ".join(text.split())
        starts, ends = words.bounds(np.frombuffer(plain, np.uint8))
        return lambda s, e: plain[starts[s] : ends[e - 1]]


def digests(cut_out: Callable[[int, int], bytes], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """int64[n, 2]: 128-bit digests of the units of each range."""
    found = [blake2b(cut_out(s, e), digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def regions(values: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, windows, anchor's place in the first window) of all
    regions; windows do not cross ``offsets``."""
    n, reach = len(values), window - gram + 1
    if n < window:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    up, down = words._POWERS[words.BASES[0]].upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * up[:n], out=sums[1:])
    grams = words.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    # hash above, place below: a minimum names its leftmost place
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span, m = 1, n - window + 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[:m], least[reach - span : reach - span + m])
    leader = (least & _PLACE).astype(np.int64)
    last = np.repeat(offsets[1:], np.diff(offsets))[:m]
    leader[np.arange(m) + window > last] = -1
    change = np.flatnonzero(np.concatenate([[True], leader[1:] != leader[:-1], [True]]))
    first, stop = change[:-1], change[1:]
    real = leader[first] >= 0
    first, stop = first[real], stop[real]
    at = leader[first]
    return grams[at], first, stop - first, at - first


def text_regions(rep: Repeats, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text index, anchor, digest, first window, windows, lead) of all regions; long
    texts go in overlapping parts of LIMIT units."""
    for s, e in words.slices(texts, LIMIT):
        values, offsets = rep.units(texts[s:e])
        if len(values) <= 4 * LIMIT:
            anchor, first, n, lead = regions(values, offsets, rep.window, rep.gram)
            text = np.searchsorted(offsets, first, side="right") - 1
            first = first - offsets[text]
            edges = np.searchsorted(text, np.arange(e - s + 1))
            parts = [(a, b, rep.cutter(texts[s + i])) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
            digest = [digests(f, first[a:b], first[a:b] + n[a:b] + rep.window - 1) for a, b, f in parts]
            yield text + s, anchor, np.concatenate(digest) if digest else np.zeros((0, 2), np.int64), first, n, lead
            continue
        cut_out = rep.cutter(texts[s])
        for at in range(0, len(values), LIMIT):  # one very long text
            part = values[at : at + LIMIT + rep.window - 1]
            anchor, first, n, lead = regions(part, np.array([0, len(part)]), rep.window, rep.gram)
            first = first + at
            yield np.full(len(first), s), anchor, digests(cut_out, first, first + n + rep.window - 1), first, n, lead


def merge(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching covers of a document as one."""
    if not len(doc):
        return doc, mark, start.astype(np.int64), n.astype(np.int64)
    order = np.lexsort((start, mark, doc))
    doc, mark, start, end = doc[order], mark[order], start[order].astype(np.int64), (start + n)[order].astype(np.int64)
    shift = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])) << 34
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    stop = np.concatenate([at[1:], [len(doc)]]) - 1
    return doc[at], mark[at], start[at], (reach[stop] - shift[stop]) - start[at]


def cover_rows(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    d, m, s, n = merge(doc, mark, start, n)
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(m), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], COVER_NAMES)


def row_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """own_id, doc_id (NO_ID for null), mark, text."""
    text = F.col(text_col).cast("string")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(F.col(id_col).cast("long").alias("own_id"), key.alias("doc_id"), row_mark(text).alias("mark"), text.alias("text"))


def anchors(rows: DataFrame, rep: Repeats) -> DataFrame:
    """ROW: a row for each region of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark = (batch.column(i).to_numpy() for i in range(2))
            for text, anchor, digest, start, n, lead in text_regions(rep, words.as_bytes(batch.column(2))):
                whole = (anchor.view(np.int64), digest[:, 0], digest[:, 1], doc[text], mark[text])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in whole] + [pa.array(x.astype(np.int32)) for x in (start, n, lead)], NAMES)

    return rows.select(*DOC, "text").mapInArrow(run, ROW)


def paired(rows: DataFrame, rep: Repeats, keep: bool) -> DataFrame:
    """The regions whose anchor has another place. Regions are found twice, or once
    and stored with ``keep``, which takes about 50 bytes for each."""
    found = cut(anchors(rows, rep)) if keep else anchors(rows, rep)
    shared = cut(found.groupBy("anchor").count().where("count > 1"))
    total = shared.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    # a hot anchor's places are dealt over salts, each of which knows it
    is_hot = F.col("count") > total // HOT_SHARE
    hot = F.broadcast(shared.where(is_hot).select("anchor", F.lit(True).alias("is_hot")))  # under HOT_SHARE rows
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = shared.select("anchor", F.explode(salts).alias("salt"))
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(*DOC, "start"), F.lit(SALTS))).otherwise(0).cast("int")
    return cut(found.join(hot, "anchor", "left").withColumn("salt", salt).join(known, ["anchor", "salt"]).select(*NAMES))


def grouped(pairs: DataFrame) -> DataFrame:
    """One row per distinct region: anchor, d1, d2, n, lead, its earliest and last place, and how many."""
    place = F.struct(*DOC, "start")
    each = pairs.groupBy("anchor", "d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("n").alias("n"), F.min("lead").alias("lead"), F.count("*").alias("rows"))
    return cut(each)


def places_of(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``pairs`` in ``groups`` (d1, d2, rows and more), with what those carry."""
    table = groups.select("d1", F.col("d2").alias("g_d2"), "rows", *[F.col(c).alias(f"g_{c}") for c in groups.columns if c not in NAMES and c != "rows"])
    return join_hot(pairs, table, "d1", "rows", pairs.count()).where("d2 = g_d2")


def open_regions(groups: DataFrame) -> DataFrame:
    """The earliest place of each region whose anchor has other regions too: anchor,
    doc_id, mark, start, n, lead, others."""
    many = cut(groups.groupBy("anchor").agg(F.count("*").alias("others")).where("others > 1"))
    return join_hot(groups, many, "anchor", "others", groups.count()).select("anchor", "first.*", "n", "lead", "others")


def packed(rows: DataFrame) -> DataFrame:
    """doc_id, mark, own_id and the text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = pa.array([squeeze(t) for t in words.as_bytes(batch.column(3))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts], [*DOC, "own_id", "packed"])

    return rows.select(*DOC, "own_id", "text").mapInArrow(run, "doc_id long, mark long, own_id long, packed binary")


def unpack(column: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(b) for b in column.to_pylist()]


def with_lists(texts: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """doc_id, mark, own_id, packed and the document's ``lists``, which has them as ``list``."""
    return texts.join(lists, DOC, how).select(*DOC, "own_id", "packed", "list")


def whole_tables(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """Rows sorted by ``keys`` in tables of ``most`` bytes or little more, each with whole groups."""
    rest, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rest.append(part)
            size += part.nbytes
            if size > most:
                table = pa.Table.from_batches(rest).combine_chunks()
                key = [table.column(k).to_numpy() for k in keys]
                other = np.any([k != k[-1] for k in key], axis=0)
                done = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
                if done:
                    yield table.slice(0, done)
                rest = table.slice(done).to_batches()
                size = sum(b.nbytes for b in rest)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def with_covers(texts: DataFrame, covers: DataFrame) -> DataFrame:
    """own_id, packed, list (array of structs start, n; null if none)."""
    lists = covers.groupBy(*DOC).agg(F.collect_list(F.struct("start", "n")).alias("list"))
    return with_lists(texts, lists, "left").select("own_id", "packed", "list")


def covered_mask(size: int, covers: list[dict] | None) -> np.ndarray:
    change = np.zeros(size + 1, np.int64)
    for c in covers or ():
        if c["start"] < size:
            change[c["start"]] += 1
            change[min(size, c["start"] + c["n"])] -= 1
    return np.cumsum(change[:-1]) > 0

"""Suffix-array dedup of byte strings.

Winnowed anchors (see ``repeats``) bring equal windows of 400 bytes into one shard;
the shard's suffix array, by induced sorting, and its permuted common prefixes
decide which windows occur more than once.

A region that occurs at several places (by its digest) goes to a shard from two of
them, the earliest and the last. All regions that two documents share in this way
go together, those that touch as one run (long ones in stretches), so a copied text is
sent about once for each of the two and not once a region. Other places of the region follow: they
hold the bytes that the array has found twice.

A region that differs from others of its anchor is cut into pieces: the windows
whose anchor stands in one half of its possible places all hold the same core,
the bytes around the anchor that every such window has, and only pieces whose core
occurs twice go on. Each group of equal cores is part of a shard. A core that more
than ``most`` pieces share is dealt over several shards. Windows that a shard finds
repeated are settled but for one of each; these and the ones not found yet go on
as pieces of half the range of places, with longer and so rarer cores. A range of
one place has the whole window as its core and is settled by counting, so no case
is left out and no shard grows.

Defined cases: a null text is empty; a text shorter than a window loses nothing;
rows that repeat an id stand each for itself, and identical rows repeat each other;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .repeats import COVER, COVER_NAMES, DOC, Repeats, byte_units, cover_rows, covered_mask, grouped, narrow, open_regions, packed, paired, places_of, unpack, whole_tables, with_covers, with_lists
from .suffix_arrays import Text, permuted_common_prefixes, suffix_array

WINDOW = 400
GRAM = 16
MOST = 256
#: Bytes of one suffix array; a group of equal cores is never cut.
SHARD = 1 << 20
#: Bytes of what two documents share that go to one array, of each of them.
STRETCH = 1 << 19
PIECE = "key long, doc_id long, mark long, start int, n int, lead int, low int, high int, bytes binary"
PIECE_NAMES = [x.split()[0] for x in PIECE.split(", ")]
RUN = "pair long, doc_id long, mark long, start int, bytes binary, at array<int>, n array<int>, d1 array<long>, d2 array<long>"
RUN_NAMES = [x.split()[0] for x in RUN.split(", ")]
FOUND = "d1 long, d2 long, doc_id long, mark long, start int, n int"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def runs(texts: DataFrame, groups: DataFrame, rep: Repeats) -> DataFrame:
    """RUN: for each two documents that are the earliest and the last to hold some
    regions, each one's runs of them, in stretches of STRETCH bytes of the earliest, so that
    two long texts are many shards. A run holds its last window whole, so stretches share
    a window less one byte. ``groups``: d1, d2, n, first, last."""
    pair = F.xxhash64("first.doc_id", "first.mark", "last.doc_id", "last.mark", F.floor(F.col("first.start") / STRETCH))
    region = lambda end: F.struct(pair.alias("pair"), F.col(f"{end}.start").alias("start"), "n", "d1", "d2")
    ends = [groups.select(*[F.col(f"{end}.{c}").alias(c) for c in DOC], region(end).alias("at")) for end in ("first", "last")]
    lists = ends[0].unionByName(ends[1]).groupBy(*DOC).agg(F.array_sort(F.collect_list("at")).alias("list"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, found = unpack(batch.column(3).slice(i, 1))[0], batch.column(4).slice(i, 1).flatten()
                pair, start, n, d1, d2 = (x.to_numpy() for x in found.flatten())
                cut_ = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (start[1:] > start[:-1] + n[:-1]), [True]]))
                rows = []
                for a, b in zip(cut_[:-1].tolist(), cut_[1:].tolist(), strict=True):
                    own = text[start[a] : start[b - 1] + n[b - 1] + rep.window - 1]
                    rows.append((pair[a], batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), start[a], own, start[a:b] - start[a], n[a:b], d1[a:b], d2[a:b]))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], RUN_NAMES)

    return with_lists(texts, lists).mapInArrow(run, RUN)


def run_covers(shared: DataFrame, rep: Repeats) -> DataFrame:
    """FOUND: covers of the windows that a shard's array finds more than once (d1 null),
    and the digests of the regions all of whose windows are (doc_id null)."""

    def batch(covers: pa.RecordBatch, d1: np.ndarray, d2: np.ndarray) -> Iterator[pa.RecordBatch]:
        none = lambda n, kind: pa.nulls(n, kind)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([none(covers.num_rows, pa.int64())] * 2 + covers.columns, FOUND_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), *[none(len(d1), k) for k in kinds]], FOUND_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tables(batches, ["pair"], SHARD):
            part, place, known, again = repeated(table.column("bytes").to_pylist(), rep.window)
            hit = known | again
            doc, mark, start = (table.column(c).to_numpy() for c in (*DOC, "start"))
            p, s, m = stretches(part, place, hit)
            covers = cover_rows(doc[p], mark[p], start[p].astype(np.int64) + s, m + (rep.window - 1))
            lists = [table.column(c).combine_chunks() for c in ("at", "n", "d1", "d2")]
            at, n, d1, d2 = (x.flatten().to_numpy() for x in lists)
            of = np.repeat(np.arange(table.num_rows), np.diff(lists[0].offsets.to_numpy()))
            before = np.concatenate([[0], np.cumsum(~hit)])  # windows not found, up to each
            first = np.searchsorted(part, of) + at
            whole = before[first + n] == before[first]
            yield from batch(covers, d1[whole], d2[whole])

    return shared.repartition("pair").sortWithinPartitions("pair").mapInArrow(run, FOUND)


def _piece(text: bytes, base: int, rep: Repeats, doc: int, mark: int, start: int, n: int, lead: int, low: int, high: int) -> tuple:
    """A row of PIECE: windows start .. start + n - 1 of a document, whose bytes
    from ``base`` on are ``text``; the anchor is ``lead`` behind the first one."""
    at = start - base
    gram = at + lead
    core = text[gram - low : gram + rep.window - high + 1]  # held by every window with low <= lead < high
    key = xxhash.xxh64_intdigest(core, (low << 16) + high) - (1 << 63)
    return key, doc, mark, start, n, lead, low, high, text[at : at + n + rep.window - 1]


def _halves(text: bytes, base: int, rep: Repeats, doc: int, mark: int, start: int, n: int, lead: int, low: int, high: int) -> list[tuple]:
    """The windows as pieces of the two halves of low .. high."""
    middle, out = (low + high) // 2, []
    for a, b in ((low, middle), (middle, high)):
        first, stop = max(0, lead - b + 1), min(n, lead - a + 1)  # windows with a <= lead - i < b
        if first < stop:
            out.append(_piece(text, base, rep, doc, mark, start + first, stop - first, lead - first, a, b))
    return out


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 3, *[pa.int32()] * 5, pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], PIECE_NAMES)


def pieces(texts: DataFrame, places: DataFrame, rep: Repeats, whole: bool = True) -> DataFrame:
    """PIECE rows of the open regions ``places``, or without ``whole`` only their keys."""
    lists = places.groupBy(*DOC).agg(F.collect_list(F.struct("start", "n", "lead")).alias("list"))
    wide = rep.window - rep.gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark = (batch.column(j).to_pylist() for j in range(2))
            for i in range(batch.num_rows):
                text, rows = unpack(batch.column(3).slice(i, 1))[0], []
                found = (x.to_numpy().tolist() for x in batch.column(4).slice(i, 1).flatten().flatten())
                for start, n, lead in zip(*found, strict=True):
                    rows += _halves(text, 0, rep, doc[i], mark[i], start, n, lead, 0, wide)
                if whole:
                    yield _piece_rows(rows)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64())], ["key"])

    return with_lists(texts, lists).mapInArrow(run, PIECE if whole else "key long")


def repeated(parts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(part, place, is one more of an earlier kind, occurs again) of every window
    inside a part; by the suffix array of all parts."""
    data = b"\xff".join(parts)  # no byte of UTF-8
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])
    text = Text(data)
    order = suffix_array(text, window)
    common = permuted_common_prefixes(text, order, window)
    long = common >= window
    before_another = np.zeros(len(order), bool)
    before_another[order[:-1]] = long[order[1:]]
    count = np.array([max(0, len(p) - window + 1) for p in parts], np.int64)
    part = np.repeat(np.arange(len(parts)), count)
    before = np.cumsum(count) - count
    place = np.arange(len(part)) - np.repeat(before, count)
    at = np.arange(len(part)) + np.repeat(starts[:-1] - before, count)
    return part, place, long[at], before_another[at]


def stretches(part: np.ndarray, place: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """(part, first place, windows) of each run of neighbouring windows that are chosen."""
    p, s = part[chosen], place[chosen]
    edge = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)])) if len(p) else np.zeros(0, np.int64)
    return p[edge], s[edge], np.diff(edge, append=len(p))


def _settled(table: pa.Table, rep: Repeats, go_on: bool) -> tuple[pa.RecordBatch, list[tuple]]:
    """(covers of the windows that occur twice in the table, pieces of the others and of one of each kind)."""
    parts = table.column("bytes").to_pylist()
    part, place, known, again = repeated(parts, rep.window)
    doc, mark, start = (table.column(c).to_numpy() for c in (*DOC, "start"))
    p, s, n = stretches(part, place, known | again)
    covers = cover_rows(doc[p], mark[p], start[p].astype(np.int64) + s, n + (rep.window - 1))
    rows: list[tuple] = []
    if go_on:
        lead, low, high = (table.column(c).to_numpy() for c in ("lead", "low", "high"))
        for k, i, n in zip(*(x.tolist() for x in stretches(part, place, ~known)), strict=True):
            rows += _halves(parts[k], int(start[k]), rep, int(doc[k]), int(mark[k]), int(start[k]) + i, n, int(lead[k]) - i, int(low[k]), int(high[k]))
    return covers, rows


def shard_covers(groups: DataFrame, rep: Repeats) -> DataFrame:
    """COVER rows of the repeats inside each key's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tables(batches, ["key"], SHARD):
            yield _settled(table, rep, False)[0]

    return groups.repartition("key").sortWithinPartitions("key").mapInArrow(run, COVER)


def salted_shards(groups: DataFrame, rep: Repeats, most: int) -> DataFrame:
    """PIECE rows of what goes on, and covers (low = -1, bytes empty); ``groups`` has ``pieces``, their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tables(batches, ["key", "salt"], SHARD):
            covers, rows = _settled(table, rep, True)
            columns = (covers.column(c).to_pylist() for c in COVER_NAMES)
            yield _piece_rows([(0, *x, 0, -1, 0, b"") for x in zip(*columns, strict=True)])
            yield _piece_rows(rows)

    salt = F.pmod(F.xxhash64(*DOC, "start"), F.ceil(F.col("pieces") * 2 / most))
    dealt = groups.withColumn("salt", salt).repartition("key", "salt").sortWithinPartitions("key", "salt")
    return dealt.select(*PIECE_NAMES, "salt").mapInArrow(run, PIECE)


def piece_covers(found: DataFrame, keys: DataFrame, rep: Repeats, most: int) -> DataFrame:
    """COVER rows of all windows of the pieces that occur more than once. ``keys`` has
    the keys of the first pieces."""
    out = None
    while True:
        counts = keys.groupBy("key").agg(F.count("*").alias("pieces")).where("pieces > 1")
        shared = cut(found.join(counts, "key"))
        single = shared.where("high - low = 1").withColumn("sha", F.sha2("bytes", 256))  # one window a row, its bytes are the core
        whole = single.join(single.groupBy("sha").count().where("count > 1"), "sha").select(*COVER_NAMES).withColumn("n", F.col("n") + (rep.window - 1))
        part = whole.unionByName(shard_covers(shared.where(f"high - low > 1 and pieces <= {most}").select(*PIECE_NAMES), rep))
        out = part if out is None else out.unionByName(part)
        large = shared.where(f"high - low > 1 and pieces > {most}")
        if large.isEmpty():
            return out
        found = cut(salted_shards(large, rep, most))
        out = out.unionByName(found.where("low < 0").select(*COVER_NAMES))
        keys = found.where("low >= 0").select("key")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, spans (maximal
    removed runs of bytes, start and end), kept (the remaining bytes)."""
    rep = Repeats(byte_units, window, gram, every=True)
    rows = narrow(docs, id_col, text_col)
    pairs = paired(rows, rep, keep=True)
    groups, texts = grouped(pairs), packed(rows)
    several = groups.where("rows > 1")
    found = cut(run_covers(runs(texts, several, rep), rep))
    sure = cut(several.select("d1", "d2", "rows", "first", "last").join(found.where("d1 is not null").select("d1", "d2").distinct(), ["d1", "d2"]))
    same = places_of(pairs, sure)
    other = F.struct(*DOC, "start")
    follow = same.where((other != F.col("g_first")) & (other != F.col("g_last"))).select(*DOC, "start", (F.col("n") + (window - 1)).alias("n"))
    covers = found.where("d1 is null").select(*COVER_NAMES).unionByName(follow)
    open_ = cut(open_regions(groups))
    covers = covers.unionByName(piece_covers(pieces(texts, open_, rep), pieces(texts, open_, rep, False), rep, most))
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[tuple] = []
                for text, found in zip(unpack(part.column(1)), part.column(2).to_pylist(), strict=True):
                    gone = covered_mask(len(text), found)
                    edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2).tolist()
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if edges else text
                    out.append((len(text), len(text) - len(kept), [{"start": s, "end": e} for s, e in edges], kept))
                n, removed, spans, kept = zip(*out, strict=True)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return with_covers(texts, covers).mapInArrow(run, schema)

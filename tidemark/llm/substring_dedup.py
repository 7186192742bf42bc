"""Substring dedup by seed and extend.

Documents join on winnowed anchors of six words (see ``repeats``): any two equal
windows of 20 words meet at a seed. A region, which is a seed extended both ways
over all windows that it leads, is a repeat as a whole if its words (by a 128-bit
digest) occur earlier. Where a seed stands among different words, the words
around it come together and every place is extended both ways as far as they
agree with an earlier place: runs of 1, 2, 4, 8 and 16 words are named in turn,
equal words having equal names, so two places agree over a window if its names
do. Repeats that overlap or touch make one maximal span, of ``window`` words or
more, and all but the earliest place of each window go.

A seed with over ``most`` different surroundings (a common phrase) is not taken by
one task: each of its windows goes to where equal ones are, by the digest of its
words, and the earliest of each is found by a combined aggregate.

Defined cases: a null text has no words; a text shorter than a window loses
nothing; rows that repeat an id stand each for itself, in order of a hash of their
texts, and identical rows count as one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import cut
from .repeats import COVER, COVER_NAMES, DOC, Repeats, cover_rows, covered_mask, digests, grouped, narrow, open_regions, packed, paired, places_of, unpack, whole_tables, with_covers, with_lists

WINDOW = 20
GRAM = 6
MOST = 256
#: Bytes of the words that a task extends at once; one seed's are never cut.
SHARD = 1 << 22
CONTEXT = "anchor long, doc_id long, mark long, start int, n int, words binary"
SPAN = "w1 long, w2 long, doc_id long, mark long, start int"


def contexts(texts: DataFrame, places: DataFrame, rep: Repeats) -> DataFrame:
    """CONTEXT: the words of the regions ``places``."""
    lists = places.groupBy(*DOC).agg(F.collect_list(F.struct("anchor", "start", "n")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = batch.column(4)[i].as_py()
                take = rep.cutter(unpack(batch.column(3).slice(i, 1))[0])
                anchor, start, n = ([p[k] for p in found] for k in ("anchor", "start", "n"))
                own = [take(s, s + k + rep.window - 1) for s, k in zip(start, n, strict=True)]
                key = [pa.array([batch.column(j)[i].as_py()] * len(found), pa.int64()) for j in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), *key, pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(own, pa.binary())], [x.split()[0] for x in CONTEXT.split(", ")])

    return with_lists(texts, lists).mapInArrow(run, CONTEXT)


def names(own: list[bytes], window: int) -> np.ndarray:
    """A number for the window at every word of ``own``, equal for equal words; windows
    that run over the end get numbers too, which mean nothing."""
    known: dict[bytes, int] = {}
    one = np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own))
    runs, out, done = {1: one}, None, 0
    width = 1
    while 2 * width <= window:
        a = runs[width]
        runs[2 * width] = _joined(a, width)
        width *= 2
    for width in sorted(runs, reverse=True):
        while window - done >= width:
            out = runs[width] if out is None else _joined(out, done, runs[width])
            done += width
    return out


def _joined(a: np.ndarray, at: int, b: np.ndarray | None = None) -> np.ndarray:
    """Numbers of (a[i], b[i + at]): of the run ``a`` and the run ``b`` that follows it."""
    b = a if b is None else b
    then = np.concatenate([b[at:], np.zeros(min(at, len(b)), np.int64)])
    return np.unique(a * (b.max(initial=0) + 1) + then, return_inverse=True)[1]


def extended(seeds: DataFrame, rep: Repeats) -> DataFrame:
    """Covers of the windows of CONTEXT rows that an earlier place of the same seed has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tables(batches, ["anchor"], SHARD):
            doc, mark, start, n = (table.column(c).to_numpy() for c in COVER_NAMES)
            own = table.column("words").to_pylist()
            size = n + rep.window - 1
            window = names([w for x in own for w in x.split(b" ")], rep.window)
            base = np.cumsum(size) - size
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            window = window[base[row] + step]
            place = (doc[row], mark[row], start[row] + step)
            order = np.lexsort((*place[::-1], window))
            new = np.concatenate([[True], window[order][1:] != window[order][:-1]])
            first = order[new][np.cumsum(new) - 1]
            hit = order[np.any([x[order] != x[first] for x in place], axis=0)]
            yield cover_rows(*[x[hit] for x in place], np.full(len(hit), rep.window))

    dealt = seeds.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, COVER)


def single_windows(texts: DataFrame, places: DataFrame, rep: Repeats) -> DataFrame:
    """SPAN: digest and place of every window of ``places``."""
    lists = places.groupBy(*DOC).agg(F.collect_list(F.struct("start", "n")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                take = rep.cutter(unpack(batch.column(3).slice(i, 1))[0])
                each = np.concatenate([p["start"] + np.arange(p["n"]) for p in batch.column(4)[i].as_py()])
                found = digests(take, each, each + rep.window)
                key = [np.full(len(each), batch.column(j)[i].as_py(), np.int64) for j in range(2)]
                columns = [np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1]), *key, each.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in SPAN.split(", ")])

    return with_lists(texts, lists).mapInArrow(run, SPAN)


def window_covers(found: DataFrame, rep: Repeats) -> DataFrame:
    each = cut(found.withColumnRenamed("w1", "d1").withColumnRenamed("w2", "d2"))
    first = each.groupBy("d1", "d2").agg(F.min(F.struct(*DOC, "start")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    same = places_of(each, cut(first))
    return same.where(F.struct(*DOC, "start") != F.col("g_first")).select(*DOC, "start", F.lit(rep.window).alias("n"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, spans (maximal
    removed runs of words, start and end), kept (the words that stay, joined by
    one space)."""
    rep = Repeats(words.word_hashes, window, gram, every=False)
    rows = narrow(docs, id_col, text_col)
    pairs = paired(rows, rep, keep=False)
    groups, texts = grouped(pairs), packed(rows)
    same = places_of(pairs, groups.where("rows > 1").select("d1", "d2", "rows", "first"))
    whole = same.where(F.struct(*DOC, "start") != F.col("g_first")).select(*DOC, "start", (F.col("n") + (window - 1)).alias("n"))
    open_ = cut(open_regions(groups))
    few, many = open_.where(F.col("others") <= most), open_.where(F.col("others") > most)
    covers = whole.unionByName(extended(contexts(texts, few, rep), rep))
    if not many.isEmpty():
        covers = covers.unionByName(window_covers(single_windows(texts, many, rep), rep))
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string"
    names_ = ["doc_id", "n_words", "n_removed", "spans", "kept"]
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[tuple] = []
                for text, found in zip(unpack(part.column(1)), part.column(2).to_pylist(), strict=True):
                    own = text.split()
                    gone = covered_mask(len(own), found)
                    edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2).tolist()
                    kept = own if not edges else [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
                    out.append((len(own), int(gone.sum()), [{"start": s, "end": e} for s, e in edges], b" ".join(kept).decode()))
                n, removed, spans, kept = zip(*out, strict=True)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names_)

    return with_covers(texts, covers).mapInArrow(run, schema)

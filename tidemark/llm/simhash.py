"""SimHash near-dedup with covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its shingle hashes do.
To link fingerprints that differ in at most r bits, every bit position gets a
nonzero vector of r + 1 bits, and for each nonzero v of r + 1 bits a table masks
the positions whose vector has an odd product with v. The vectors of r positions
leave some v orthogonal to all of them, so two fingerprints within the radius
agree on a whole mask: they meet in one of the 2**(r+1) - 1 tables for certain.

Equal fingerprints are one node. A bucket of a table is searched by one task as
long as it has at most ``MOST`` fingerprints, and yields a spanning forest of
its links rather than all pairs. A larger bucket is covered again: its members
agree on the mask, so the same construction over the remaining bits splits it
into smaller ones without losing a pair, at most until few bits remain.

Defined cases: a null text is empty; texts without words have fingerprint zero
and link like any other; rows that repeat an id stand each for themselves; an
empty table gives an empty result; extra columns are ignored by ``near_groups``
and unchanged in ``keep_one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import cut, join_hot, short
from .components import components

BITS = 64
RADIUS = 3
MOST = 2048
# Near copies: five-word shingles with a Jaccard similarity of at least SIMILAR.
COPY_WIDTH = 5
SIMILAR = 0.8
SEED = 42


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of a text's ``width``-word shingles, repeats included."""
    norm = b" ".join(text.lower().split())
    if not norm:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    n = len(gaps) + 1
    if n <= width:
        return np.array([digest(norm, SEED)], np.uint64)
    starts, ends = [0, *(gaps[: n - width] + 1).tolist()], [*gaps[width - 1 :].tolist(), len(norm)]
    return np.fromiter((digest(norm[s:e], SEED) for s, e in zip(starts, ends, strict=True)), np.uint64, n - width + 1)


def fingerprint(text: bytes, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a text's ``width``-word shingles."""
    hashes = shingles(text, width)
    if not len(hashes):
        return 0
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        votes += np.unpackbits(part.view(np.uint8)).reshape(len(part), BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(np.uint64)[0])


def text_mark(text: Column) -> Column:
    """Tells the texts of rows that repeat an id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, mark (see ``text_mark``), fp (the fingerprint as a signed long), one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in words.few_texts(batch, 2):
                fps = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(fps.view(np.int64))], ["doc_id", "mark", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_mark(F.col(text_col)).alias("mark"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, mark long, fp long")


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``positions`` that leave no set of ``radius`` of them hit by all."""
    top = (1 << (radius + 1)) - 1
    vectors = [i % top + 1 for i in range(len(positions))]
    return [sum(1 << p for p, m in zip(positions, vectors, strict=True) if (m & v).bit_count() & 1) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _first_tables(nodes: DataFrame, radius: int) -> DataFrame:
    """key, free (bits that the key leaves open), fp."""
    masks = covering_masks(list(range(BITS)), radius)
    rows = [F.struct(F.lit(_signed(~m & (1 << 64) - 1)).alias("free"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for m in masks]
    return nodes.select("fp", F.explode(F.array(*rows)).alias("t")).select(F.xxhash64("t.free", "t.part").alias("key"), "t.free", "fp")


def _next_tables(keyed: DataFrame, radius: int) -> DataFrame:
    """Each bucket covered again over its free bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for batch in batches:
            key, free, fp = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
            for f in np.unique(free).tolist():
                if f not in known:
                    known[f] = covering_masks([i for i in range(BITS) if f >> i & 1], radius)
                at = free == np.uint64(f)
                for mask in known[f]:
                    sub = words.mix(key[at] ^ words.mix((fp[at] & np.uint64(mask)) + words.mix(np.full(at.sum(), mask, np.uint64))))
                    left = np.full(len(sub), f & ~mask, np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (sub, left, fp[at])], ["key", "free", "fp"])

    return keyed.mapInArrow(run, "key long, free long, fp long")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs (root, member) that join the fingerprints within the radius, transitively."""
    rest, out = np.arange(len(fps)), []
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for f in front:
                near |= np.bitwise_count(fps[rest] ^ fps[f]) <= radius
            front, rest = rest[near], rest[~near]
            out += [(root, i) for i in front]
    return out


def _links(keyed: DataFrame, radius: int, join=forest) -> DataFrame:
    """Links (a, b) that ``join`` gives for every bucket; buckets have at most MOST members."""

    def search(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(cuts)
        two = cuts[:-1][size == 2]
        pair = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        a, b = [fp[pair]], [fp[pair + 1]]
        for s, n in zip(cuts[:-1][size > 2], size[size > 2], strict=True):
            own = fp[s : s + n]
            if found := join(own, radius):
                i, j = np.array(found).T
                a.append(own[i])
                b.append(own[j])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, np.uint64)
        for batch in batches:  # sorted by key; the last bucket may go on in the next batch
            key = np.concatenate([key, batch.column(0).to_numpy().view(np.uint64)])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            done = int(np.flatnonzero(key == key[-1])[0]) if len(key) else 0
            if done:
                a, b = search(key[:done], fp[:done])
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            key, fp = key[done:], fp[done:]
        if len(key):
            a, b = search(key, fp)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, radius: int = RADIUS, most: int = MOST, join=forest) -> DataFrame:
    """``nodes`` (distinct fp) -> (a, b) whose transitive closure joins the same
    fingerprints as all pairs within the radius."""
    keyed, out = _first_tables(nodes, radius), None
    while True:
        large = cut(keyed.groupBy("key").count().where(F.col("count") > most).select("key"))
        n = large.count()
        if not n:
            part = _links(keyed, radius, join)
            return part if out is None else out.unionByName(part)
        if n <= 10_000:
            large = F.broadcast(large)
        part = _links(keyed.join(large, "key", "left_anti"), radius, join)
        out = part if out is None else out.unionByName(part)
        keyed = cut(_next_tables(keyed.join(large, "key", "left_semi").select("key", "free", "fp"), radius))


def grouped(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int, most: int) -> DataFrame:
    """doc_id, mark, fp, root (a fingerprint of its group, the same for all), component_id of every row."""
    fps = cut(fingerprints(docs, id_col, text_col, width))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    joined = cut(components(links(nodes.select("fp"), radius, most)))
    ends = joined.join(nodes.select(F.col("fp").alias("node"), "least"), "node")
    least = cut(ends.groupBy("root").agg(F.min("least").alias("of_root"), F.count("*").alias("nodes")))
    linked = join_hot(joined, least, "root", "nodes", joined.count()).select(F.col("node").alias("fp"), "root", "of_root")
    label = [F.coalesce("root", "fp").alias("root"), F.coalesce("of_root", "least").alias("component_id")]
    labels = cut(nodes.join(linked, "fp", "left").select("fp", "rows", *label))
    return join_hot(fps, labels, "fp", "rows", fps.count()).select("doc_id", "mark", "fp", "root", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id (least id reachable)."""
    hex_fp = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return grouped(docs, id_col, text_col, width, radius, most).select("doc_id", hex_fp.alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group: of documents joined
    by links as in ``near_groups`` and by similar five-word shingles, in any order.
    A row goes by its id and text, so another text under the same id is judged apart."""
    from . import near_copies

    groups = cut(grouped(docs, id_col, text_col, width, radius, MOST))
    labels = groups.where("doc_id is not null").select(F.col("doc_id").alias("id"), "mark", F.col("root").alias("label")).distinct()
    again = near_copies.join_copies(docs, labels, id_col, text_col).select(F.col("node").alias("root"), F.col("root").alias("top"))
    of_top = F.coalesce("top", "root").alias("top")
    each = groups.groupBy("root").agg(F.min("component_id").alias("own"), F.count("*").alias("rows")).join(again, "root", "left")
    each = cut(each.select("root", of_top, "own", "rows"))  # a row for each group of fingerprints
    tops = cut(each.groupBy("top").agg(F.min("own").alias("least"), F.count("*").alias("groups")))
    least = cut(join_hot(each, tops, "top", "groups", each.count()).select("root", "rows", "least"))
    told = join_hot(groups, least, "root", "rows", groups.count())
    lost = told.where(~F.col("doc_id").eqNullSafe(F.col("least")))
    lost = short(cut(lost.select(F.col("doc_id").alias("lost_id"), F.col("mark").alias("lost_mark")).distinct()))
    return docs.join(lost, docs[id_col].eqNullSafe(lost["lost_id"]) & (text_mark(docs[text_col]) == lost["lost_mark"]), "left_anti")

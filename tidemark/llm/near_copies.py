"""All pairs of texts whose five-word shingle sets have a Jaccard similarity of
at least ``SIMILAR``, joined into groups; no fingerprint has a part in it.

Prefix filter: in one order of all shingles, two sets that are similar share one
of the first n - ceil(SIMILAR * n) + 1 of each. Documents meet in a bucket per
such shingle. Any order is right; here frequent shingles come last, as far as a
sample of the documents shows them, and the rest by hash, so that a common line
makes no bucket unless a text has little else. A pair's common prefix shingles
bound its overlap, and so do their sketches: a set's sketch has the parities of its
shingles' numbers in ``SKETCH`` hash buckets, and two sketches differ in no more bits
than the sets do in shingles. That leaves few pairs for the exact check.

Groups that are known already are passed as labels: pairs inside one label are
not searched. The first rounds check each bucket's members against one of them,
another one every round, to join large families by a linear number of pairs; only
links that pass the exact check join labels. The last round checks all pairs of a
bucket whose labels still differ and whose sizes allow similarity. A bucket of over
``LARGE`` members is split for it: by bands of size, of which only neighbours can be
alike, and each band into blocks, of which any two are one task's work. So what a
task holds has a bound, and the pairs of a large bucket are told by many tasks.

Rows go by their shingle sets, one for each distinct set, so texts that repeat an
id or a set need nothing special; a text without words or id is alike to none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import beside, cut, fitted, join_hot, short
from .components import components
from .simhash import COPY_WIDTH, SIMILAR, shingles, text_mark

#: Shingles in so many of the sampled documents come last; of all sampled shingles one in MOST_HOT at least, so their list has a bound.
SAMPLE = 16
HOT = 4
MOST_HOT = 100_000
FLUSH = 1 << 16
#: Bits of a sketch, stored as longs.
SKETCH = 512
BITS = [f"b{i}" for i in range(SKETCH // 64)]
#: Rounds that check a bucket against one member before all its pairs are.
STARS = 2
#: Members of a bucket, and of a block of one, that the last round takes whole.
LARGE = 4096


def prefix_size(n: int) -> int:
    return n - math.ceil(SIMILAR * n - 1e-9) + 1


def least_common(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How many prefix shingles two similar sets of these sizes share at least: up
    to the nearer end of the prefixes all common shingles are in both, and beyond
    it lies no more than the rest of one set."""
    overlap = np.ceil(SIMILAR / (1 + SIMILAR) * (na + nb) - 1e-9)
    rest = np.maximum(np.ceil(SIMILAR * na - 1e-9), np.ceil(SIMILAR * nb - 1e-9)) - 1
    return np.maximum(overlap - rest, 1).astype(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string").alias("text")
    return docs.select(F.col(id_col).cast("long").alias("id"), text_mark(F.col(text_col)).alias("mark"), text).where("id is not null")


def _digest(parts: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(parts.tobytes()) - (1 << 63)


def _sets(texts: DataFrame) -> DataFrame:
    """digest, parts: the distinct shingles in ascending order. ``texts`` has text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own in words.few_texts(batch, 0, 64):
                sets = [np.unique(shingles(t, COPY_WIDTH)) for t in own]
                digests = pa.array([_digest(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([digests, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["digest", "parts"])

    return texts.select("text").mapInArrow(run, "digest long, parts array<long>")


def sketch(parts: np.ndarray) -> np.ndarray:
    """uint64[SKETCH / 64] of a set of shingle hashes."""
    odd = np.bincount((words.mix(parts) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def hot_shingles(texts: DataFrame, sample: int = SAMPLE, hot: int = HOT) -> np.ndarray:
    """Frequent shingles of every ``sample``-th document; they set the order only."""
    sets = _sets(texts.where(F.pmod(F.xxhash64("id"), F.lit(sample)) == 0))
    counts = cut(sets.select(F.explode("parts").alias("part")).groupBy("part").count().where(F.col("count") >= hot))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    found = counts.where(F.col("count") >= max(hot, -(-total // MOST_HOT))).select("part")  # MOST_HOT rows at most
    return np.sort(np.array([r.part for r in found.collect()], np.int64).view(np.uint64))


def prefixes(texts: DataFrame, hot: np.ndarray | None = None) -> DataFrame:
    """id, mark, digest (of the whole set), n (its size), and the prefix in an order
    that has ``hot`` shingles last, or without such a list the sketch; texts without
    words are absent. Shingles are made anew for either form, since stored prefixes
    would take a fifth of the corpus."""
    shared = None if hot is None else texts.sparkSession.sparkContext.broadcast(hot)
    more = [("prefix", "array<long>")] if shared else [(b, "long") for b in BITS]
    schema = ", ".join(f"{k} {v}" for k, v in [("id", "long"), ("mark", "long"), ("digest", "long"), ("n", "long"), *more])
    names = [x.split()[0] for x in schema.split(", ")]

    def prefix(own: np.ndarray) -> np.ndarray:
        late = shared.value
        if len(late):
            last = late[np.minimum(np.searchsorted(late, own), len(late) - 1)] == own
            own = np.concatenate([own[~last], own[last]])
        return own[: prefix_size(len(own))].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in (x for b in batches for x in words.few_texts(b, 2)):
            at, digests, sizes, extra = [], [], [], []
            for i, t in enumerate(texts):
                own = np.unique(shingles(t, COPY_WIDTH))
                if len(own):
                    at.append(i)
                    digests.append(_digest(own))
                    sizes.append(len(own))
                    extra.append(prefix(own) if shared else sketch(own))
            rows = pa.array(at, pa.int64())
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(digests, pa.int64()), pa.array(sizes, pa.int64())]
            if shared:
                columns.append(pa.array(extra, pa.list_(pa.int64())))
            else:
                columns += [pa.array(x) for x in np.array(extra, np.uint64).reshape(-1, len(BITS)).T.copy().view(np.int64)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts.mapInArrow(run, schema)


Columns = tuple[np.ndarray, ...]


def _by_bucket(rows: DataFrame, search: Callable[[Columns], Iterator[Columns]], schema: str, dealt: bool = False) -> DataFrame:
    """``search`` over whole buckets of ``rows`` (key, label, set, n and perhaps BITS,
    all longs), in the order of key, label and set; one call has all buckets that end
    in a batch. ``dealt``: every bucket lies in one partition already, so no row moves."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def searched(rows: Columns) -> Iterator[pa.RecordBatch]:
            for out in search(rows) if len(rows[0]) else ():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            if not batch.num_rows:
                continue
            if held and held[0][0][0] == new[0][-1]:  # all of one bucket, which may go on
                for h, x in zip(held, new, strict=True):
                    h.append(x)
                continue
            done = int(np.searchsorted(new[0], new[0][-1]))
            yield from searched(tuple(np.concatenate([*h, x[:done]]) for h, x in zip(held or [[]] * len(new), new, strict=True)))
            held = [[x[done:]] for x in new]
        if held:
            yield from searched(tuple(np.concatenate(h) for h in held))

    return (rows if dealt else rows.repartition("key")).sortWithinPartitions("key", "label", "set").mapInArrow(run, schema)


def _mixed(rows: Columns) -> Iterator[Columns]:
    """The rows that have one under another label in their bucket, of a size that allows similarity."""
    new = np.concatenate([[True], rows[0][1:] != rows[0][:-1]])
    starts = np.flatnonzero(new)
    size = np.diff(np.concatenate([starts, [len(new)]]))
    several = np.repeat(rows[1][starts] != rows[1][starts + size - 1], size)  # labels are in order
    key, label, sets, n = (x[several] for x in rows)
    bucket = np.cumsum(new[several])
    run = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (label[1:] != label[:-1])])[: len(key)])
    least, most = np.ceil(SIMILAR * n - 1e-6).astype(np.int64), np.floor(n / SIMILAR + 1e-6).astype(np.int64)

    def fitting(group: np.ndarray) -> np.ndarray:
        """Rows of each one's group whose sizes fit its own."""
        group = group << 32
        order = np.sort(group + n)
        return np.searchsorted(order, group + most, side="right") - np.searchsorted(order, group + least)

    keep = fitting(bucket) > fitting(run)
    yield key[keep], label[keep], sets[keep], n[keep]


def _pairs(star: int | None) -> Callable[[Columns], Iterator[Columns]]:
    """(a, b, need) of a bucket's members under different labels whose sizes allow
    similarity: one member with the others (another one for every ``star``), or all
    pairs (None), in blocks of about FLUSH."""

    def search(rows: Columns) -> Iterator[Columns]:
        key, label, sets, n, *bits = rows
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        ends = np.concatenate([starts[1:], [len(key)]])
        runs = np.flatnonzero(new | np.concatenate([[True], label[1:] != label[:-1]]))
        size = np.diff(np.concatenate([runs, [len(key)]]))
        first, after = np.repeat(runs, size), np.repeat(runs + size, size)  # where a member's label starts, and the next one
        middle = starts
        if star:  # the same label in all the buckets that a family shares
            rank = words.mix(label.view(np.uint64) + np.uint64(star))
            least = np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, starts), ends - starts))
            middle = least[np.searchsorted(least, starts)]
        left, right, held = [], [], 0
        for s, e, m in zip(starts.tolist(), ends.tolist(), middle.tolist(), strict=True):
            for i in range(s, e) if star is None else (m,):  # a bucket's pairs are told in one task, only those that may be alike leave it
                others = np.arange(after[i], e)
                if star:
                    others = np.concatenate([np.arange(s, first[i]), others])
                if not len(others):
                    if star is None:
                        break
                    continue
                left.append(np.full(len(others), i))
                right.append(others)
                held += len(others)
                if held >= FLUSH:
                    yield _told(np.concatenate(left), np.concatenate(right), sets, n, bits)
                    left, right, held = [], [], 0
        if left:
            yield _told(np.concatenate(left), np.concatenate(right), sets, n, bits)

    return search


def _split(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of small buckets, rows of the blocks of large ones): the latter with a key for any two
    blocks of a band and ``tag``, which tells the block and whether the row is of the band itself."""
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > LARGE))  # one in LARGE rows at most
    if sizes.isEmpty():
        return rows, None
    large = short(sizes.select("key"))
    cold, hot = rows.join(large, "key", "left_anti"), rows.join(large, "key")
    band = F.floor(F.log("n") / math.log(1 / SIMILAR)).cast("long")
    places = F.array(F.struct(band.alias("band"), F.lit(1).alias("own")), F.struct((band + 1).alias("band"), F.lit(0).alias("own")))
    hot = hot.withColumn("p", F.explode(places)).select(*names, "p.band", "p.own")
    # a band without rows of its own has no pairs that are not told in the one below
    blocks = cut(hot.groupBy("key", "band").agg(F.ceil(F.count("*") / LARGE).alias("blocks"), F.max("own").alias("own")).where("own = 1").drop("own"))
    hot = hot.join(short(blocks), ["key", "band"]).withColumn("g", F.pmod(F.xxhash64("set"), F.col("blocks")))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = F.xxhash64("key", "band", F.least("g", "other"), F.greatest("g", "other"))
    return cold, hot.withColumn("key", key).select(*names, (F.col("g") * 2 + F.col("own")).alias("tag"))


def _block_pairs(rows: Columns) -> Iterator[Columns]:
    """(a, b, need) of two blocks' members, as ``_pairs`` tells them of a whole bucket: between the
    blocks, or inside where both are the same, and not between two of the band below."""
    key, label, sets, n, *bits, tag = rows
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    block, own = tag >> 1, (tag & 1).astype(bool)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
        order = s + np.argsort(n[s:e], kind="stable")  # by size, so that those which may be alike stand together
        size, two = n[order], block[s:e].min() != block[s:e].max()
        last = np.searchsorted(size, np.floor(size / SIMILAR + 1e-9), side="right")
        left, right, held = [], [], 0
        for i in range(e - s - 1):
            j = order[i + 1 : last[i]]
            a = order[i]
            fits = (label[j] != label[a]) & (own[j] | own[a])
            if two:
                fits &= block[j] != block[a]
            j = j[fits]
            left.append(np.full(len(j), a))
            right.append(j)
            held += len(j)
            if held >= FLUSH:
                yield _told(np.concatenate(left), np.concatenate(right), sets, n, bits)
                left, right, held = [], [], 0
        if held:
            yield _told(np.concatenate(left), np.concatenate(right), sets, n, bits)


def _told(i: np.ndarray, j: np.ndarray, sets: np.ndarray, n: np.ndarray, bits: list[np.ndarray]) -> Columns:
    fits = np.minimum(n[i], n[j]) >= np.ceil(SIMILAR * np.maximum(n[i], n[j]) - 1e-9)
    i, j = i[fits], j[fits]
    apart = sum(np.bitwise_count((b[i] ^ b[j]).view(np.uint64)).astype(np.int64) for b in bits)
    fits = apart * (1 + SIMILAR) <= (n[i] + n[j]) * (1 - SIMILAR) + 1e-6
    i, j = i[fits], j[fits]
    return np.minimum(sets[i], sets[j]), np.maximum(sets[i], sets[j]), least_common(n[i], n[j])


def _similar(pairs: DataFrame, texts: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs' labels (a, b) where the sets are similar. ``first``: digest, label, id, mark of one text for each set."""
    ends = fitted(cut(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()))
    owners = short(fitted(cut(first.join(short(ends), "digest", "left_semi").select("digest", "label", "id", "mark"))))
    sets = _sets(texts.join(owners.select("id", "mark"), ["id", "mark"], "left_semi")).groupBy("digest").agg(F.min("parts").alias("parts"))
    sets = fitted(cut(sets.join(owners.select("digest", "label"), "digest")), FLUSH >> 5)
    left, right = (sets.select(F.col("digest").alias(x), F.col("label").alias(f"{x}_label"), F.col("parts").alias(f"{x}_parts")) for x in "ab")
    both = F.size(F.array_intersect("a_parts", "b_parts"))
    enough = both >= SIMILAR * (F.size("a_parts") + F.size("b_parts") - both) - 1e-9
    return pairs.join(left, "a").join(right, "b").where(enough).select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct()


def _renamed(rows: DataFrame, roots: DataFrame) -> tuple[DataFrame, bool]:
    """``rows`` under the roots of their labels, and whether they stayed in their partitions."""
    out, stayed = beside(rows, roots.select(F.col("node").alias("label"), "root"), "label", "left")
    return out.withColumn("label", F.coalesce("root", "label")).select(*rows.columns), stayed


def join_copies(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, hot: int = HOT) -> DataFrame:
    """``labels`` (id, label and, where ids repeat, mark), one row per document ->
    (node, root): the least label that each label is joined with by similar texts,
    where it is joined at all."""
    texts = _texts(docs, id_col, text_col)
    late = hot_shingles(texts, sample, hot)
    each = cut(prefixes(texts).join(labels, [c for c in ("id", "mark") if c in labels.columns]))
    first = F.min(F.struct("label", "id", "mark", "n", *BITS)).alias("one")
    first = cut(each.groupBy("digest").agg(first, F.count("*").alias("copies")).select("digest", "one.*", "copies"))
    same = first.select("digest", F.col("label").alias("b"), "copies")
    links = join_hot(each.select("digest", F.col("label").alias("a")), same, "digest", "copies", each.count()).select("a", "b").where("a != b").distinct()
    roots = cut(components(links))
    owners = short(cut(first.select("id", "mark", "label", F.col("digest").alias("set"))))
    rows = prefixes(texts, late).join(owners, ["id", "mark"]).where("digest = set").select(F.explode("prefix").alias("key"), "label", "set", "n")
    row, found = "key long, label long, set long, n long", "a long, b long, need long"
    names = rows.columns
    rows = cut(_by_bucket(rows, _mixed, row))
    sketches = cut(first.select(F.col("digest").alias("set"), *BITS))
    for star in (*range(STARS), None):
        if star != 0:
            renamed, stayed = _renamed(rows, roots)
            rows = cut(_by_bucket(renamed, _mixed, row, stayed))
        # rows wait without their sketches, whole buckets in a partition, which get them when pairs are told
        small, large = (rows, None) if star is not None else _split(rows, names)
        wide, stayed = beside(small, sketches, "set")
        told = _by_bucket(wide.select(*names, *BITS), _pairs(star), found, stayed and large is None)
        if large is not None:
            wide = beside(large, sketches, "set")[0]
            told = told.unionByName(_by_bucket(wide.select(*names, *BITS, "tag"), _block_pairs, found))
        met = told.groupBy("a", "b").agg(F.count("*").alias("common"), F.min("need").alias("need"))
        links = fitted(cut(links.union(_similar(fitted(cut(met.where("common >= need").select("a", "b"))), texts, first)).distinct()))
        roots = cut(components(links))
    return roots

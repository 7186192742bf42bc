"""Language-model scores by deleted interpolation of n-gram estimates.

The model mixes maximum-likelihood estimates of orders 1 to ``ORDER`` and a uniform
share for the unknown word. How far an order is trusted hangs on how often its
context was seen, by buckets of powers of two. These weights are learned by
expectation-maximisation on held-out counts: one in ``DELETED`` training documents is
left out, its tokens are predicted from the counts of the others, and the weights
that make it likeliest are then used with the counts of all training documents.

Texts are packed into blocks of about ``BLOCK`` tokens, stored in buckets by block. A
block sends each of its distinct n-grams once, with its own counts, to the shard of
the n-gram's hash; the shard adds the counts up and answers in the same order. So a
frequent n-gram costs a number a block, not one an occurrence. Words are known by
64-bit hashes, longer n-grams by hashes of ``SPARE`` bits more than the number of
tokens has, so that one in a million meets another by chance at any size.

Defined cases: a null or empty text is the end token alone; repeated rows and ids are
texts of their own; a null id is a training text; without training texts all counts
are 0 and every token has the uniform share; an empty table gives an empty result;
other columns are ignored. A long text is cut into segments that know the words
before them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import shared_folder, shuffle_partitions

ORDER = 3
DELETED = 16
#: Tokens of a block and of a segment; n-grams of a shard, about.
BLOCK, SEGMENT, SHARD = 1 << 21, 1 << 20, 1 << 21
SPARE = 20
ROUNDS, STILL = 20, 1e-4
#: Classes of documents: held out of training, teaching counts, teaching weights.
OUT, KEPT, LEFT = 0, 1, 2
#: Buckets of context counts, by powers of two.
BUCKETS = 64
START, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
BLOCKS = "block long, doc_id array<bigint>, row array<bigint>, class array<int>, size array<int>, before binary, known binary, ids binary"
ASKED = "order int, shard long, block long, n int, keys binary, width int, counts binary"
ANSWER = "order int, block long, shard long, taught binary, kept binary, kinds bigint, kinds_kept bigint"
SCORES = "row long, doc_id long, class int, n_tokens long, n_known long, base_score double, score double"


def crc(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def held_out(doc_id: Column) -> Column:
    return crc(doc_id) % 5 == 1


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of all of them, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def packed_keys(keys: np.ndarray) -> tuple[bytes, int]:
    """Ascending keys as the first one and differences of as few bytes as the largest needs."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return keys[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), width


def unpacked_keys(data: bytes, width: int) -> np.ndarray:
    first, rest = np.frombuffer(data, "<u8", 1), np.frombuffer(data, np.uint8, offset=8).reshape(-1, width)
    full = np.zeros((len(rest), 8), np.uint8)
    full[:, :width] = rest
    return np.cumsum(np.concatenate([first, full.view("<u8").ravel()]), dtype=np.uint64)


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts' tokens in blocks (BLOCKS): of each segment its document, class and size, the two
    tokens before it, and the tokens as places in the block's list of known hashes."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = row = TaskContext.get().partitionId() << 33
        # documents that teach weights stand in blocks of their own, of odd numbers, which are all that learning reads
        waiting: dict[bool, list[tuple]] = {True: [], False: []}
        sizes = {True: 0, False: 0}

        def flush(left: bool) -> pa.RecordBatch:
            nonlocal block
            held, waiting[left], sizes[left] = waiting[left], [], 0
            block += 2
            known, ids = grouped(np.concatenate([h[4] for h in held]))
            order = np.argsort(-np.bincount(ids), kind="stable")  # frequent tokens get small numbers
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            before = np.array([h[3] for h in held], np.uint64).tobytes()
            columns = [[block - 2 + left], [[h[0] for h in held]], [[h[1] for h in held]], [[h[2] for h in held]], [[len(h[4]) for h in held]], [before], [known[order].tobytes()], [packed(place[ids])]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch, texts in (x for b in batches for x in words.few_texts(b, 2, 1024)):
            ids, classes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, e in words.slices(texts, 1 << 22):
                hashes, offsets = words.word_hashes([t.lower() for t in texts[s:e]])
                for i in range(e - s):
                    tokens = np.append(hashes[offsets[i] : offsets[i + 1]], END)
                    for at in range(0, len(tokens), SEGMENT):
                        before = tokens[at - 2 : at].tolist() if at else [int(START)] * 2
                        left = classes[s + i] == LEFT
                        waiting[left].append((ids[s + i], row, classes[s + i], before, tokens[at : at + SEGMENT]))
                        sizes[left] += len(waiting[left][-1][4])
                        if sizes[left] >= BLOCK:
                            yield flush(left)
                    row += 1
        for left in (True, False):
            if waiting[left]:
                yield flush(left)

    number = crc(F.col(id_col))
    kind = F.when(number % 5 == 1, OUT).when(F.floor(number / 5) % DELETED == 0, LEFT).otherwise(KEPT)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), kind.alias("class"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, BLOCKS)


@dataclass
class Totals:
    """Of what teaches: tokens, documents and distinct tokens."""

    tokens: int
    documents: int
    kinds: int = 0


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys ascending, which of them every place has), as ``np.unique`` tells.
    Sorts the upper bits together with the places, which is several times faster than an
    order of places; keys that only differ in lower bits are rare and sorted in full."""
    low = max(1, len(key).bit_length())
    mask = np.uint64((1 << low) - 1)
    order = np.sort((key & ~mask) | np.arange(len(key), dtype=np.uint64))
    place = (order & mask).astype(np.int32)
    ordered = key[place]
    if len(key) and (ordered[1:] < ordered[:-1]).any():
        place = np.argsort(key, kind="stable")
        ordered = key[place]
    fresh = np.ones(len(key), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    group = np.empty(len(key), np.int32)
    group[place] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return ordered[fresh], group


class Block:
    """A block's tokens with two context tokens before each segment."""

    def __init__(self, row: dict, bits: int) -> None:
        size = np.array(row["size"], np.int64)
        known = np.frombuffer(row["known"], np.uint64)
        starts = np.cumsum(size + 2) - size - 2
        self.real = np.ones(int(size.sum()) + 2 * len(size), bool)
        self.real[starts] = self.real[starts + 1] = False
        self.tokens = np.empty(len(self.real), np.uint64)
        self.tokens[self.real] = known[unpacked(row["ids"])]
        before = np.frombuffer(row["before"], np.uint64).reshape(-1, 2)
        self.tokens[starts], self.tokens[starts + 1] = before[:, 0], before[:, 1]
        self.start = self.tokens == START
        segment = np.repeat(np.arange(len(size), dtype=np.int32), size + 2)
        self.place = np.arange(len(self.real)) - starts[segment]
        # contexts are looked up, but count where they stand
        self.column = np.where(self.real, np.array(row["class"], np.int32)[segment], np.int32(OUT))
        self.size, self.row, self.shift = size, row, np.uint64(64 - bits)

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, places, distinct keys, key of each place) for n = 1 .. order."""
        for n in range(1, order + 1):
            back = np.concatenate([np.zeros(n - 1, np.uint64), self.tokens[: len(self.tokens) - n + 1]])
            key = words.mix((key if n > 1 else np.uint64(0)) * np.uint64(words.BASES[1]) + back + np.uint64(n))  # noqa: F821  the shorter one's
            at = np.flatnonzero((self.place >= n - 1) & ~self.start)
            yield n, at, *grouped(key[at] if n == 1 else key[at] >> self.shift << self.shift)

    def terms(self, order: int, told: list[dict], kind: str, totals: Totals) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(places of the block's own tokens, for orders 1, 2, ... the counts of the n-gram at each
        and of its context), from answers of the ``kind`` 'taught' or 'kept'."""
        places, out = np.flatnonzero(self.real), []
        context = np.full(len(places), totals.tokens)
        for n, at, _, group in self.grams(order):
            parts = [unpacked(r[kind]) for r in sorted(told, key=lambda r: r["shard"]) if r["order"] == n]
            counts = np.zeros(len(self.tokens), np.int64)
            counts[at] = np.concatenate(parts)[group]
            counts[self.start] = totals.documents
            out.append((counts[places], context))
            context = counts[places - 1]
        return places, out


def bucket(counts: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(counts, 1))[1] - 1


@dataclass
class Weights:
    """weights[n - 1][b]: share of order n where its context's count is in bucket b."""

    weights: np.ndarray

    def mixed(self, terms: list[tuple[np.ndarray, np.ndarray]], kinds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each order: (its estimate, its share, the mixture up to it)."""
        below, out = np.full(len(terms[0][0]), 1 / (kinds + 1)), []
        for own, (count, context) in zip(self.weights, terms, strict=True):
            share = own[bucket(context)] * (context > 0)
            estimate = count / np.maximum(context, 1)
            below = share * estimate + (1 - share) * below
            out.append((estimate, share, below))
        return out


def start_weights(order: int) -> Weights:
    return Weights(np.full((order, BUCKETS), 0.5))


def expected(weights: Weights, terms: list[tuple[np.ndarray, np.ndarray]], kinds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(expected uses of each order's estimate by bucket, times the choice came up, log-likelihood)."""
    order = len(terms)
    used, came = np.zeros((order, BUCKETS)), np.zeros((order, BUCKETS))
    levels = weights.mixed(terms, kinds)
    reach = np.ones(len(terms[0][0]))
    for n in reversed(range(order)):
        estimate, share, mixture = levels[n]
        here = terms[n][1] > 0
        b = bucket(terms[n][1])
        use = reach * np.where(here, share * estimate / mixture, 0.0)
        came[n] = np.bincount(b[here], reach[here], BUCKETS)
        used[n] = np.bincount(b[here], use[here], BUCKETS)
        reach = reach - use
    return used, came, float(np.log(levels[-1][2]).sum())


class Corpus:
    """Blocks of texts and the answers to what they asked."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, order: int) -> None:
        self.spark, self.order = docs.sparkSession, order
        self.folder = f"{shared_folder(self.spark)}/ngrams-{uuid.uuid4()}"
        self.table = f"tidemark_blocks_{uuid.uuid4().hex}"
        writer = blocks(docs, id_col, text_col).write.format("parquet").option("compression", "zstd").option("path", f"{self.folder}/blocks")
        writer.bucketBy(min(4 * shuffle_partitions(self.spark), 50_000), "block").sortBy("block").saveAsTable(self.table)
        self.blocks = self.spark.table(self.table)
        each = F.explode(F.arrays_zip("class", "size", "row")).alias("s")
        got = self.blocks.select(each).groupBy("s.class").agg(F.sum("s.size"), F.countDistinct("s.row")).collect()
        by = {r[0]: (int(r[1]), int(r[2])) for r in got}
        some = lambda kinds: Totals(*(sum(by.get(k, (0, 0))[i] for k in kinds) for i in (0, 1)))
        self.taught, self.kept, tokens = some((KEPT, LEFT)), some((KEPT,)), some((OUT, KEPT, LEFT)).tokens
        self.bits = min(64, max(32, tokens.bit_length() + SPARE))
        self.shards = max(1, tokens // SHARD, min(shuffle_partitions(self.spark), tokens >> 14))
        self.answers = self.count()
        kinds = self.answers.agg(F.sum("kinds"), F.sum("kinds_kept")).first()
        self.taught.kinds, self.kept.kinds = int(kinds[0] or 0), int(kinds[1] or 0)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def count(self) -> DataFrame:
        """Sends the n-grams of all blocks to their shards and stores the answers."""
        order, bits, shards = self.order, self.bits, self.shards
        names, out_names = [x.split()[0] for x in ASKED.split(", ")], [x.split()[0] for x in ANSWER.split(", ")]

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
            for row in (b.slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows)):
                block = Block(row, bits)
                for n, at, key, group in block.grams(order):
                    own = np.bincount(group * np.int32(3) + block.column[at], minlength=3 * len(key)).reshape(-1, 3)[:, [KEPT, LEFT]].T
                    shard = ((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)  # ascending, as the keys are
                    edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                    for many in np.array_split(np.arange(len(edges)), len(edges) // 64 + 1):
                        rows = []
                        for s, e in ((edges[i], edges[i + 1] if i + 1 < len(edges) else len(key)) for i in many):
                            data, width = packed_keys(key[s:e] if n == 1 else key[s:e] >> block.shift)
                            rows.append((n, int(shard[s]), row["block"], int(e - s), data, width, packed(own[:, s:e].ravel())))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        def add(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            distinct, group = grouped(np.concatenate([unpacked_keys(r["keys"], r["width"]) for r in rows]))
            own = np.concatenate([unpacked(r["counts"]).reshape(2, -1) for r in rows], axis=1)
            kept, left = (np.bincount(group, c, len(distinct)).astype(np.int64) for c in own)
            taught, kinds = kept + left, [0] * len(rows)
            ends = np.cumsum([r["n"] for r in rows])
            cells = lambda counts, some: [packed(counts[group[e - r["n"] : e]]) if some(r) else None for r, e in zip(rows, ends, strict=True)]
            columns = [[r["order"] for r in rows], [r["block"] for r in rows], [r["shard"] for r in rows], cells(taught, lambda r: True), cells(kept, lambda r: r["block"] % 2), kinds.copy(), kinds]
            if rows[0]["order"] == 1:
                columns[5][0], columns[6][0] = int((taught > 0).sum()), int((kept > 0).sum())
            types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=out_names)

        self.blocks.mapInArrow(ask, ASKED).groupBy("order", "shard").applyInArrow(add, ANSWER).write.parquet(f"{self.folder}/answers")
        return self.spark.read.schema(ANSWER).parquet(f"{self.folder}/answers")

    def each(self, work, schema: str, kind: str, only: str = "true") -> DataFrame:
        """``work(block, places, terms)`` for all blocks, or ``only`` some: an iterator of record batches."""
        order, bits, totals = self.order, self.bits, getattr(self, kind)
        told = self.answers.where(only).groupBy("block").agg(F.collect_list(F.struct("order", "shard", kind)).alias("told"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (b.slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows)):
                block = Block(row, bits)
                yield from work(block, *block.terms(order, row["told"], kind, totals))

        return self.blocks.where(only).join(told, "block").mapInArrow(run, schema)

    def learn(self, rounds: int = ROUNDS) -> Weights:
        """Weights by expectation-maximisation over the tokens of LEFT documents, with counts of KEPT ones."""
        order, kinds = self.order, self.kept.kinds

        def gather(block: Block, places: np.ndarray, terms: list) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([packed64(np.array(terms))], pa.binary())], ["terms"])

        path = f"{self.folder}/held"
        self.each(gather, "terms binary", "kept", "block % 2 = 1").write.parquet(path)
        events, weights = self.spark.read.schema("terms binary").parquet(path), start_weights(order)
        for _ in range(rounds):
            current = weights

            def add_up(batches: Iterator[pa.RecordBatch], current: Weights = current) -> Iterator[pa.RecordBatch]:
                used, came = np.zeros((order, BUCKETS)), np.zeros((order, BUCKETS))
                for data in (x for b in batches for x in b.column(0).to_pylist()):
                    u, c, _ = expected(current, list(unpacked64(data).reshape(order, 2, -1)), kinds)
                    used, came = used + u, came + c
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(order * BUCKETS)), pa.array(used.ravel()), pa.array(came.ravel())], ["k", "used", "came"])

            sums = events.mapInArrow(add_up, "k long, used double, came double").groupBy("k").agg(F.sum("used"), F.sum("came")).collect()
            used, came = np.zeros(order * BUCKETS), np.zeros(order * BUCKETS)
            for k, u, c in sums:
                used[k], came[k] = u, c
            weights = maximised(used.reshape(order, -1), came.reshape(order, -1), weights)
            if np.abs(weights.weights - current.weights).max() < STILL:
                break
        return weights

    def scores(self, weights: Weights) -> DataFrame:
        """SCORES of every segment's document, added up."""
        names, totals = [x.split()[0] for x in SCORES.split(", ")], self.taught

        def score(block: Block, places: np.ndarray, terms: list) -> Iterator[pa.RecordBatch]:
            c = terms[0][0]
            base = np.log10((c + 0.5) / (totals.tokens + 0.5 * (totals.kinds + 1)))
            model = np.log10(weights.mixed(terms, totals.kinds)[-1][2])
            ends = np.cumsum(block.size) - block.size
            add = lambda x: np.add.reduceat(x, ends)  # noqa: E731  no segment is empty
            columns = [block.row["row"], block.row["doc_id"], block.row["class"], block.size, add((c > 0).astype(np.int64)), add(base), add(model)]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

        parts = self.each(score, SCORES, "taught")
        return parts.groupBy("row", "doc_id", "class").agg(*(F.sum(c).alias(c) for c in names[3:]))


def packed64(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values.ravel().astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked64(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def maximised(used: np.ndarray, came: np.ndarray, before: Weights) -> Weights:
    """Shares that the expected uses give; a bucket that never came up takes the share of the one below."""
    out = before.weights.copy()
    for n in range(len(out)):
        for b in range(BUCKETS):
            if came[n, b] > 0:
                out[n, b] = min(used[n, b] / came[n, b], 1 - 1e-6)
            elif b:
                out[n, b] = out[n, b - 1]
    return Weights(out)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score, the log10 probabilities of the text by the smoothed counts and by the model. Training
    documents and their parts are told by a checksum of doc_id."""
    spark: SparkSession = docs.sparkSession
    corpus = Corpus(docs, id_col, text_col, order)
    path = f"{corpus.folder}/scores"
    found = corpus.scores(corpus.learn())
    total = corpus.taught.tokens
    columns = ["doc_id", (F.col("class") == OUT).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"]
    found.select(*columns).write.parquet(path)
    corpus.close()
    return spark.read.parquet(path)

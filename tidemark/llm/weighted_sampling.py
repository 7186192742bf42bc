"""Document fingerprints by consistent weighted sampling.

A text's terms are its five-word shingles, weighted by how often they occur. For
every term and every slot k a gamma variate r, a gamma variate c and a uniform
beta are read off a hash of the term, so all texts see the same ones. A term of
weight w is quantized to t = floor(ln w / r + beta) and gets
ln a = ln c - r (t + 1 - beta); the slot holds the (term, t) of least a. Two
texts agree in a slot with probability sum(min(w)) / sum(max(w)), the generalised
Jaccard similarity of their weights.

The variates come from two tables of ``DRAWS`` entries, indexed by 16 bits each
of a multiplicative hash of the term; a slot is cut to 32 bits.

Defined cases: a null text is empty; a text of fewer than five words is one
term; a text without words has the fingerprint of zeros; equal texts have equal
fingerprints; rows that repeat an id follow one another in order of their text;
a null id comes first; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import cut, shuffle_partitions

SLOTS = 64
WIDTH = 5
DRAWS = 1 << 16
CHUNK = 512


class Sampler:
    """Signatures of ``slots`` consistent weighted samples."""

    def __init__(self, slots: int = SLOTS, seed: int = 1) -> None:
        unit = (words.stream(seed, 5 * DRAWS) >> np.uint64(11)).astype(np.float64)
        u = ((unit + 0.5) / (1 << 53)).reshape(5, DRAWS)
        self.r, self.beta = -np.log(u[0] * u[1]), u[2]
        self.ln_c = np.log(-np.log(u[3] * u[4])).astype(np.float32)
        self.at_one = (self.r * (1 - self.beta)).astype(np.float32)  # r (t + 1 - beta) at weight 1
        self.factors = words.stream(seed + 1, slots) | np.uint64(1)
        self.slots = slots

    def signature(self, terms: np.ndarray) -> np.ndarray:
        """uint32[slots] of a text's term hashes, repeats included."""
        if not len(terms):
            return np.zeros(self.slots, np.uint32)
        ordered = np.sort(terms)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        distinct, weight = ordered[first], np.diff(first, append=len(ordered))
        best = np.full(self.slots, np.inf, np.float32)
        winner, level = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int64)
        slot = np.arange(self.slots)
        for at in range(0, len(distinct), CHUNK):
            part, w = distinct[at : at + CHUNK], weight[at : at + CHUNK]
            bits = (part[:, None] * self.factors).view(np.uint16).reshape(len(part), self.slots, 4)
            i, j = bits[..., 3], bits[..., 2]
            ln_a = self.ln_c[j] - self.at_one[i]
            many = np.flatnonzero(w > 1)
            if len(many):
                ln_a[many] = self.ln_c[j[many]] - self._cost(i[many], w[many])[1]
            row = ln_a.argmin(axis=0)
            value = ln_a[row, slot]
            won = np.flatnonzero(value < best)
            best[won], winner[won] = value[won], part[row[won]]
            level[won] = self._cost(i[row[won], won][:, None], w[row[won]])[0][:, 0]
        mixed = words.mix(winner + words.mix(level.astype(np.uint64)))
        return (mixed >> np.uint64(32)).astype(np.uint32)

    def _cost(self, i: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(t, r (t + 1 - beta)) of rows of weight w."""
        r, beta = self.r[i], self.beta[i]
        t = np.floor(np.log(w)[:, None] / r + beta)
        return t.astype(np.int64), (r * (t + 1 - beta)).astype(np.float32)

    def signatures(self, texts: list[bytes]) -> list[np.ndarray]:
        terms, offsets = words.shingles(*words.word_hashes(texts), WIDTH)
        return [self.signature(terms[offsets[i] : offsets[i + 1]]) for i in range(len(texts))]


_SAMPLERS: dict[int, Sampler] = {}


def sampler(slots: int) -> Sampler:
    if slots not in _SAMPLERS:
        _SAMPLERS[slots] = Sampler(slots)
    return _SAMPLERS[slots]


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / len(a)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, fingerprint (hex) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(slots)
        for batch in batches:
            texts, out = words.as_bytes(batch.column(1)), []
            for s, e in words.slices(texts):
                out += map(to_hex, own.signatures(texts[s:e]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fingerprint string")


def in_id_order(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) dealt in ranges of doc_id: part, tail, doc_id, text.
    Every part is followed by a copy of the row that comes after it (tail = 1),
    and the last one by a copy of the very first row."""
    spark = docs.sparkSession
    parts = 4 * shuffle_partitions(spark)
    cuts = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (10 * parts))
    edges = np.unique(np.array(cuts or [0.0]).astype(np.int64))

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array(np.where(known, np.searchsorted(edges, values, side="right") + 1, 0).astype(np.int32))

    placed = docs.select(part_of("doc_id").alias("part"), "doc_id", "text")
    # one row per part, and there are as many parts as partitions
    firsts = docs.select(part_of("doc_id").alias("part"), "doc_id").groupBy("part").agg(F.min("doc_id").alias("first_id"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("part")
    last = F.max("part").over(Window.partitionBy(F.lit(0)))
    before = firsts.select(F.col("part").alias("f_part"), "first_id", F.coalesce(F.lag("part").over(in_order), last).alias("before"))
    joined = placed.join(F.broadcast(before), F.col("part") == F.col("f_part"))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("tail"))
    copy = F.struct(F.col("before").alias("part"), F.lit(1).alias("tail"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.array(own, copy)).otherwise(F.array(own))
    dealt = joined.select(F.explode(places).alias("at"), "doc_id", "text").select("at.part", "at.tail", "doc_id", "text")
    return dealt.repartition("part").sortWithinPartitions("part", "tail", "doc_id", "text")


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Per row of ``docs`` in id order: its fingerprint, that of its text with the
    second half replaced by the start of the next text, and likenesses. Columns
    doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint,
    near_edited, near_next."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def emit(pairs: list[tuple], own: Sampler) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, _, after, _ in pairs]
        changed = own.signatures([t.encode() for t in edited])
        columns = [
            pa.array([p[0] for p in pairs], pa.int64()),
            pa.array([len(p[1]) for p in pairs], pa.int64()),
            pa.array(edited, pa.string()),
            pa.array([to_hex(p[2]) for p in pairs], pa.string()),
            pa.array([to_hex(s) for s in changed], pa.string()),
            pa.array([likeness(p[2], s) for p, s in zip(pairs, changed, strict=True)], pa.float64()),
            pa.array([likeness(p[2], p[4]) for p in pairs], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, done = sampler(slots), None, False
        for batch in batches:
            part, tail, ids = (batch.column(i).to_pylist() for i in range(3))
            texts = words.as_bytes(batch.column(3))
            for s, e in words.slices(texts):
                pairs = []
                for k, signature in zip(range(s, e), own.signatures(texts[s:e]), strict=True):
                    row = (ids[k], texts[k].decode(), signature)
                    if last is not None and last[0] == part[k] and not done:
                        pairs.append((*last[1], row[1], row[2]))
                    last, done = (part[k], row), bool(tail[k])  # only a part's first tail row counts
                if pairs:
                    yield emit(pairs, own)

    return in_id_order(narrow).mapInArrow(run, schema)

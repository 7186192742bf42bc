"""Quality classifier by importance resampling.

Two generative models draw a text's n-grams independently from hashed buckets:
the target model is counted on labelled good documents, the raw model on all
documents. n-grams are of words (one and two, lower case) and of word shapes (one
to three): the vocabulary is open, and a shape, which is the classes of a word's
first and last byte, which kinds of characters it holds, and whether it repeats
the word before it, tells of words that the target never held.

A document's log weight is its mean of log p_target / p_raw over its n-grams times
``LENGTH``: documents weigh as if all had so many n-grams, so length alone neither
saves nor rejects one, and neighbouring weights are within the noise of sampling.
Gumbel noise is added and the k largest keys are taken: k documents without
replacement in proportion to their weights.

k is a budget of expected size: with the level t at which all but one in ``SPARED``
labelled good documents stay with a probability of 0.999, a document's inclusion
probability is 1 - exp(-weight / exp(t)), and k is their sum. The target model and
t come from at most ``LABELLED`` labelled rows (those of least hashed id); the raw
model, the scores and k cover every document. The k-th key is found by counting
keys in intervals, never by gathering them.

Defined cases: a null or empty text has no n-grams and log weight 0; rows that
repeat an id and a text tie and stay or go together; a null id draws one noise;
without labelled good rows every document stays; an empty table gives an empty
result; other columns come back unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import cut, short
from .mixing import draw
from .simhash import text_mark

WORD_BITS, SHAPE_BITS = 17, 16
BUCKETS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
LENGTH = 32
#: -ln(0.001): how far above the level a weight must be to stay with a probability of 0.999.
SURE = 6.9
LABELLED = 20_000
SPARED = 1_000
BINS = 4096
GATHER = 10_000
SEED = 11
# Character classes: 0 other (also beyond ASCII), 1 lower case, 2 upper case, 3 digit, 4 punctuation.
CLASS = np.zeros(256, np.uint8)
CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
CLASS[48:58], CLASS[65:91], CLASS[97:123] = 3, 2, 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, the text of each)."""
    block, owner = [], []
    for i, t in enumerate(texts):
        for part in words.pieces(t):
            block.append(part)
            owner.append(i)
    data = np.frombuffer(b" ".join(block), np.uint8)
    starts, ends = words.bounds(data)
    text = np.array(owner)[np.searchsorted(np.cumsum([len(b) + 1 for b in block]), starts, side="right")] if len(starts) else starts
    kinds = CLASS[data]
    shape = kinds[starts].astype(np.uint64) if len(starts) else np.zeros(0, np.uint64)
    for k in (1, 2, 3, 4):
        seen = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int32)])
        inside = seen[ends] - seen[np.minimum(starts + 1, ends)]
        shape = shape * np.uint64(4) + np.minimum(inside, 3).astype(np.uint64)
    if len(starts):
        last = np.where(kinds[ends - 1] == 4, data[ends - 1], kinds[ends - 1])
        shape = shape * np.uint64(256) + last.astype(np.uint64)
        same = words.mix(words.polynomial(LOWER[data].astype(np.uint64), starts, ends))
        again = np.concatenate([[False], (same[1:] == same[:-1]) & (text[1:] == text[:-1])])
        shape = shape * np.uint64(2) + again.astype(np.uint64)
    else:
        same = shape
    out, owners = [], []
    for units, orders, bits, base in ((shape, 3, SHAPE_BITS, 1 << WORD_BITS), (same, 2, WORD_BITS, 0)):
        gram = np.zeros(len(units), np.uint64)
        for n in range(1, min(orders, len(units)) + 1):
            gram = gram[: len(units) - n + 1] * np.uint64(words.BASES[1]) + units[n - 1 :] + np.uint64(1)
            inside = text[: len(gram)] == text[n - 1 :]
            out.append((words.mix(gram[inside] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64) + base)
            owners.append(text[: len(gram)][inside])
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)


def _counts(texts: DataFrame) -> np.ndarray:
    """n-gram counts by bucket over all rows of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, own in words.few_texts(batch, 0):
                for s, e in words.slices(own):
                    total += np.bincount(ngrams(own[s:e])[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> tuple[np.ndarray, float]:
    """(log p_target / p_raw by bucket, the level that good documents are above).
    ``labels`` has doc_id and quality; of a document labelled twice either counts."""
    sample = (
        labels.where("doc_id is not null and quality = 1")
        .select(F.col("doc_id").alias("l_id"))
        .distinct()
        .orderBy(F.xxhash64("l_id"), "l_id")
        .limit(labelled)
    )
    # `labelled` ids at most, and so as many texts
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    good = plain.join(F.broadcast(cut(sample)), F.col("doc_id") == F.col("l_id"), "left_semi").select("text")
    target, raw = _counts(good), _counts(plain.select("text"))
    if not target.sum():
        return np.zeros(BUCKETS), -np.inf
    smooth = lambda c: (c + 0.5) / (c.sum() + 0.5 * BUCKETS)
    ratio = np.log(smooth(target)) - np.log(smooth(raw))
    weights = sorted(r.log_weight for r in weigh(good, ratio).select("log_weight").toLocalIterator())
    return ratio, weights[len(weights) // SPARED] - float(np.log(SURE))


def weigh(docs: DataFrame, ratio: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with log_weight at its end."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    names, at = docs.columns, docs.columns.index(text_col)
    plain = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in (x for b in batches for x in words.few_texts(b, at)):
            total = np.zeros(len(own))
            for s, e in words.slices(own):
                buckets, text = ngrams(own[s:e])
                n = np.bincount(text, minlength=e - s)
                total[s:e] = LENGTH * np.bincount(text, shared.value[buckets], e - s) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], [*batch.schema.names, "log_weight"])

    schema = ", ".join([f"c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes)] + ["log_weight double"])
    return plain.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "log_weight")


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of ``keys`` (key double): counted in intervals, and read
    off once the interval holds few rows or one value."""
    low, high, above = *keys.agg(F.min("key"), F.max("key")).first(), 0
    while True:
        inside = keys.where(F.col("key").between(low, high))
        if low == high:
            return high
        place = F.least(F.lit(BINS - 1), F.floor((F.col("key") - low) / ((high - low) / BINS)))
        found = sorted(inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect(), reverse=True)
        for b in found:
            if above + b.n >= k:
                low, high = b.lo, b.hi
                break
            above += b.n
        if b.n <= GATHER:
            return sorted((r.key for r in keys.where(F.col("key").between(low, high)).collect()), reverse=True)[k - above - 1]


def gumbel_key(log_weight: Column, key: Column, seed: int) -> Column:
    return log_weight - F.log(-F.log(draw(key, seed)))


def inclusion(log_weight: Column, level: float) -> Column:
    """Probability that Gumbel noise lifts a weight above the level."""
    return F.lit(1.0) if level == -np.inf else -F.expm1(-F.exp(F.least(F.lit(50.0), log_weight - level)))


def top_keys(keys: DataFrame, level: float, share: float | None = None) -> tuple[int, float]:
    """(k, the k-th largest key) of ``keys`` (log_weight, key): as many as expected
    above the level, or a ``share`` of all."""
    n, expected = keys.agg(F.count("*"), F.sum(inclusion(F.col("log_weight"), level))).first()
    k = min(n, round(n * share if share is not None else expected or 0.0))
    return k, kth_largest(keys, k) if k else np.inf


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, share: float | None = None) -> DataFrame:
    """The documents that the classifier keeps, with log_weight and sample_key.
    Documents are scored once; the keys, not the texts, are stored and ranked."""
    ratio, level = fit(docs, labels, id_col, text_col)
    plain = docs.select(F.col(id_col).alias("k_id"), text_mark(F.col(text_col)).alias("k_mark"), F.col(text_col).cast("string").alias("text"))
    scored = weigh(plain, ratio, "text").select("k_id", "k_mark", "log_weight", gumbel_key(F.col("log_weight"), F.col("k_id"), seed).alias("key"))
    keys = cut(scored)
    k, least = top_keys(keys, level, share)
    kept = short(cut(keys.where(F.col("key") >= least).dropDuplicates(["k_id", "k_mark"])) if k else keys.limit(0))
    at = docs[id_col].eqNullSafe(kept["k_id"]) & (text_mark(docs[text_col]) == kept["k_mark"])
    return docs.join(kept, at).select(*[docs[c] for c in docs.columns], kept["log_weight"], kept["key"].alias("sample_key"))

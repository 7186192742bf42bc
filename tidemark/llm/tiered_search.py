"""Ranked lexical search over an index in tiers of falling impact.

``build`` tokenizes every text once and keeps one posting a document and term with
its impact, the part of a score that hangs on the document alone. For each term a
histogram of impacts (at most ``STEPS`` rows a term, counted before the shuffle)
sets two floors: the first tier holds the term's about ``FIRST`` highest impacts,
the second those of the next ``SECOND``, the last all others. Postings lie as
Parquet by tier; each term keeps, for each tier, a residual bound: the highest
impact that lies below it.

``search`` goes down the tiers. With what the tiers so far say, a document's score
is at least what was found and at most that plus the residual bounds of the item's
terms that were not found in it. An item is closed at a tier if its ``top``-th best
lower bound is over the bound of every document not met; only documents whose upper
bound reaches that mark stay, and their missing terms are looked up below. Items
without that proof fall through to the next tier; at the last nothing is missing.

All is 64-bit integer but the weights. Postings carry a number of their text's row,
so that repeated ids and repeated rows are documents of their own.

Defined cases: a null or empty text has no term and is never found; an item without
a term, or whose terms no document has, gets no row; equal scores come by ascending
doc_id, null ids first; repeated items are asked each for itself; other columns
are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import MOST_SENT, shared_folder, short

FIRST, SECOND = 1 << 10, 1 << 14
TOP = 10
#: Histogram steps of impacts, which are below 1,000,000.
STEPS = 64
IMPACT = 1_000_000
TIERS = 3
#: Bytes that a term cannot hold become blanks; A-Z become a-z.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are split at once.
_PIECE = 1 << 24


def terms_of(text: bytes) -> Counter[bytes]:
    """A text's terms and how often each occurs."""
    text = text.translate(_TERM)
    if len(text) <= _PIECE:
        return Counter(text.split())
    out: Counter[bytes] = Counter()
    for part in words.pieces(text):
        out.update(part.split())
    return out


def postings(docs: DataFrame, id_col: str, text_col: str, wanted: list[bytes] | None = None) -> DataFrame:
    """Of every text with a term: one row without a term (row, doc_id, n), and one row a
    distinct term (all, or the wanted ones) with tf. Rows are numbered as they come,
    so the result must be stored before it is used twice."""
    vocabulary = None if wanted is None else docs.sparkSession.sparkContext.broadcast(frozenset(wanted))
    names = ["row", "doc_id", "n", "term", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        keep = None if vocabulary is None else vocabulary.value
        for batch, texts in (x for b in batches for x in words.few_texts(b, 1)):
            rows, n, size, term, tf = [], [], [], [], []
            for text in texts:
                found = terms_of(text)
                chosen = found.keys() if keep is None else found.keys() & keep
                rows.append(row)
                n.append(found.total())
                size.append(len(chosen) + 1)
                term += [None, *chosen]
                tf += [0, *(found[t] for t in chosen)]
                row += 1
            has = np.repeat(np.array(n) > 0, size)
            at = np.repeat(np.arange(len(texts)), size)[has]
            cells = [pa.array(np.array(rows)[at]), batch.column(0).take(pa.array(at)), pa.array(np.array(n)[at]), pa.array(term, pa.binary()).cast(pa.string()).filter(pa.array(has)), pa.array(np.array(tf, np.int64)[has])]
            for s in range(0, len(at), 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(s, 1 << 16) for c in cells], names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "row long, doc_id long, n long, term string, tf long")


@dataclass
class Index:
    """``postings``: row, doc_id, term, impact, tier. ``terms``: one row a term with df, weight and
    residual_0 .. residual_2, the highest impact below the tier (0 below the last)."""

    postings: DataFrame
    terms: DataFrame
    documents: int
    length: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", asked: DataFrame | None = None, first: int = FIRST, second: int = SECOND) -> Index:
    """The index of all documents. ``asked`` (term) names the terms whose postings are kept;
    without it all are. Counts and lengths are of whole texts either way."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4()}"
    wanted = None
    if asked is not None:
        asked = asked.select("term").distinct()
        some = asked.limit(MOST_SENT + 1).toArrow().column("term")
        wanted = words.as_bytes(some.combine_chunks()) if len(some) <= MOST_SENT else None
    found = postings(docs, id_col, text_col, wanted)
    if asked is not None and wanted is None:
        found = found.join(asked.withColumn("asked", F.lit(True)), "term", "left").where(F.col("term").isNull() | F.col("asked"))
        found = found.select("row", "doc_id", "n", "term", "tf")
    found.write.parquet(f"{folder}/postings")
    found = spark.read.parquet(f"{folder}/postings")
    total, length = found.where("term IS NULL").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    per_impact = F.expr(f"(1000000000 * tf) div (1000 * tf + 8 * (100 - 75 + ((75 * n * {total}L) div {max(length, 1)}L)))")
    scored = found.where("term IS NOT NULL").select("row", "doc_id", "term", per_impact.alias("impact"))
    step = F.expr(f"impact div {IMPACT // STEPS + 1}").cast("int")
    histogram = scored.groupBy("term", step.alias("step")).agg(F.count("*").alias("k"), F.max("impact").alias("most"))
    down = Window.partitionBy("term").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    # a step belongs to the first tier if fewer than `first` postings lie above it
    above = F.coalesce(F.sum("k").over(down), F.lit(0))
    tiers = histogram.withColumn("above", above).withColumn("tier", F.expr(f"CASE WHEN above < {first} THEN 0 WHEN above < {first + second} THEN 1 ELSE 2 END"))
    weight = F.floor(1000 * F.log((2.0 * total + 2) / (2.0 * F.col("df") + 1))).cast("long")
    terms = (
        tiers.groupBy("term")
        .agg(
            F.sum("k").alias("df"),
            *(F.min(F.when(F.col("tier") <= t, F.col("step"))).alias(f"floor_{t}") for t in range(TIERS - 1)),
            *(F.coalesce(F.max(F.when(F.col("tier") > t, F.col("most"))), F.lit(0)).alias(f"residual_{t}") for t in range(TIERS)),
        )
        .withColumn("weight", weight)
    )
    terms.write.parquet(f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")
    tier = F.when(step >= F.col("floor_0"), 0).when(step >= F.col("floor_1"), 1).otherwise(2)
    floors = short(terms.select("term", "floor_0", "floor_1"))
    scored.join(floors, "term").select("row", "doc_id", "term", "impact", tier.alias("tier")).write.partitionBy("tier").parquet(f"{folder}/tiers")
    stored = spark.read.schema("row long, doc_id long, term string, impact long, tier int").parquet(f"{folder}/tiers")
    return Index(stored, terms, total, length)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (a number of the row), item_id, term, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch, texts in (x for b in batches for x in words.few_texts(b, 1)):
            found = [terms_of(t) for t in texts]
            at = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            term = pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(at + row), batch.column(0).take(pa.array(at)), term, pa.array([c for f in found for c in f.values()], pa.int64())], ["item", "item_id", "term", "times"])
            row += len(texts)

    narrow = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "item long, item_id long, term string, times long")


def search(index: Index, asked: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score, tier (where the item was closed), for ``asked`` as from
    ``item_terms``, stored."""
    spark = asked.sparkSession
    folder = f"{shared_folder(spark)}/search-{uuid.uuid4()}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    # what a term gives an item's score for each unit of impact
    terms = asked.join(index.terms.where("weight > 0"), "term").withColumn("gives", F.col("times") * F.col("weight"))
    terms = kept(terms.select("item", "item_id", "term", "gives", *(f"residual_{t}" for t in range(TIERS))), "terms")
    of_item = Window.partitionBy("item").orderBy(F.desc("low"), F.asc("doc_id"), F.asc("row"))
    exact = []
    for t in range(TIERS):
        bound = F.col("gives") * F.col(f"residual_{t}")
        met = index.postings.where(F.col("tier") <= t).join(short(terms), "term")
        docs = met.groupBy("item", "item_id", "row", "doc_id").agg(F.sum(F.col("gives") * F.col("impact")).alias("low"), F.sum(bound).alias("met"))
        if t == TIERS - 1:
            exact.append(docs.select("item", "item_id", "row", "doc_id", F.col("low").alias("score"), F.lit(t).alias("tier")))
            break
        docs = kept(docs, f"met-{t}")
        mark = docs.withColumn("place", F.row_number().over(of_item)).where(F.col("place") <= top)
        mark = mark.groupBy("item").agg(F.when(F.count("*") == top, F.min("low")).alias("mark"))
        unmet = terms.groupBy("item").agg(F.sum(bound).alias("unmet"))
        # a score over 0 is 1 or more, so 1 is a mark as long as fewer than `top` are met
        proof = unmet.join(mark, "item", "left").select("item", "unmet", F.greatest(F.coalesce("mark", F.lit(1)), F.lit(1)).alias("mark"))
        proof = kept(proof.withColumn("closed", F.col("unmet") < F.col("mark")), f"proof-{t}")
        done = docs.join(short(proof.where("closed")), "item").where(F.col("low") + F.col("unmet") - F.col("met") >= F.col("mark"))
        done = kept(done.select("item", "item_id", "row", "doc_id", "low"), f"left-{t}")
        below = index.postings.where(F.col("tier") > t).join(short(done.select("item", "row")), "row")
        below = below.join(short(terms.select("item", "term", "gives")), ["item", "term"]).groupBy("item", "row").agg(F.sum(F.col("gives") * F.col("impact")).alias("more"))
        exact.append(done.join(below, ["item", "row"], "left").select("item", "item_id", "row", "doc_id", (F.col("low") + F.coalesce("more", F.lit(0))).alias("score"), F.lit(t).alias("tier")))
        terms = kept(terms.join(short(proof.where("NOT closed").select("item")), "item", "left_semi"), f"terms-{t}")
    found = exact[0]
    for more in exact[1:]:
        found = found.unionByName(more)
    ranked = found.where("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"), F.asc("row"))))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score", "tier")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, first: int = FIRST, second: int = SECOND) -> DataFrame:
    """The ``top`` documents of each item: an index of the items' terms over all documents, searched."""
    asked = item_terms(items)
    folder = f"{shared_folder(docs.sparkSession)}/items-{uuid.uuid4()}"
    asked.write.parquet(folder)
    asked = docs.sparkSession.read.parquet(folder)
    return search(build(docs, asked=asked, first=first, second=second), asked, top)

"""Exact vector search that skips blocks: rows lie in blocks around centres, and a block's angle
to its farthest row bounds what any of its rows can score.

Centres are fitted on a bounded sample (``SAMPLE`` rows at most), every row lies in the block
of its nearest centre, and the bound holds for all rows of a block, so the rows found are
those of a full scan, whatever the centres are. How much is skipped depends on the data:
vectors without any grouping have wide blocks, of which few can be skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import matrix

SAMPLE = 20_000
ROUNDS = 8
#: Slack of a bound, in radians, for rounding.
SLACK = 1e-6


def fit_centres(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """``n`` unit centres (fewer if there are fewer rows): rows far from each other to begin
    with, then means of the nearest rows."""
    rows = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    chosen, near = [0], rows @ rows[0]
    while len(chosen) < min(n, len(rows)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-12:
            break
        chosen.append(far)
        near = np.maximum(near, rows @ rows[far])
    centres = rows[chosen]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


@dataclass
class Index:
    """Rows (block, id, codes) as Parquet in folders by block; of each block its centre, the least cosine of a row to it and the greatest length of a row."""

    path: str
    centres: np.ndarray
    blocks: np.ndarray
    least_cosine: np.ndarray
    longest: np.ndarray
    rows: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """[query, block]: no row of the block scores more."""
        length = np.linalg.norm(queries, axis=1, keepdims=True)
        apart = np.arccos(np.clip(queries @ self.centres[self.blocks].T / np.maximum(length, 1e-12), -1, 1))
        wide = np.arccos(np.clip(self.least_cosine, -1, 1))
        best = np.cos(np.maximum(0.0, apart - wide - SLACK))
        return np.where(best > 0, length * self.longest * best, 0.0) + SLACK


def build(table: DataFrame, path: str, dim: int, blocks: int, sample: int = SAMPLE) -> Index:
    """``table`` has id and codes; rows without ``dim`` numbers are left out."""
    whole = table.select("id", F.col("codes").cast("array<tinyint>").alias("codes")).where((F.size("codes") == dim) & ~F.exists("codes", lambda c: c.isNull()))
    some = whole.orderBy(F.xxhash64("id"), "id").limit(sample).select("codes").toArrow()  # `sample` rows at most
    rows = matrix(some.column("codes").combine_chunks(), dim)[1] if some.num_rows else np.zeros((1, dim))
    centres = fit_centres(rows, blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, flat = matrix(batch.column(1), dim)
            size = np.linalg.norm(flat, axis=1)
            near = flat @ centres.T
            own = near.argmax(axis=1)
            cosine = near[np.arange(len(own)), own] / np.maximum(size, 1e-12)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *batch.columns, pa.array(np.where(size > 0, cosine, 1.0)), pa.array(size)], ["block", "id", "codes", "cosine", "size"])

    dealt = whole.select(F.col("id").cast("long").alias("id"), "codes").mapInArrow(deal, "block int, id long, codes array<tinyint>, cosine double, size double")
    dealt.write.mode("overwrite").partitionBy("block").parquet(path)
    spark = table.sparkSession
    schema = "block int, id long, codes array<tinyint>, cosine double, size double"
    told = spark.read.schema(schema).parquet(path).groupBy("block").agg(F.min("cosine"), F.max("size"), F.count("*")).orderBy("block").collect()  # a row a block
    columns = [np.array([r[i] for r in told]) for i in range(4)]
    return Index(path, centres, columns[0].astype(int), columns[1].astype(float), columns[2].astype(float), columns[3])


def search(index: Index, asked: DataFrame, least: int, block_of: int = 1024) -> DataFrame:
    """(query, id, score) of every row that scores ``least`` or more against a row of ``asked``
    (id, codes). A query goes only to blocks whose bound allows it; blocks that no query needs
    are not read."""
    spark, dim = asked.sparkSession, index.centres.shape[1]
    shared = spark.sparkContext.broadcast(index)  # centres and three numbers a block

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, flat = matrix(batch.column(1), dim)
            q, b = np.nonzero(shared.value.bounds(flat) >= least)
            rows = pa.array(at[q])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(shared.value.blocks[b].astype(np.int32))], ["query", "asks", "block"])

    plain = asked.select(F.col("id").cast("long").alias("query"), F.col("codes").cast("array<tinyint>").alias("asks"))
    routed = plain.mapInArrow(route, "query long, asks array<tinyint>, block int")
    wanted = sorted(r.block for r in routed.select("block").distinct().collect())  # block numbers
    rows = spark.read.schema("block int, id long, codes array<tinyint>").parquet(index.path).where(F.col("block").isin(wanted))
    # a block is dealt over parts of bounded size; its queries go to each of them
    parts = {int(b): max(1, -(-int(n) // block_of)) for b, n in zip(index.blocks, index.rows, strict=True)}
    of = F.create_map(*[F.lit(x) for b in (wanted or [-1]) for x in (b, parts.get(b, 1))])
    left = rows.withColumn("part", F.pmod(F.xxhash64("id"), of[F.col("block")]).cast("int")).groupBy("block", "part")
    right = routed.withColumn("part", F.explode(F.sequence(F.lit(0), of[F.col("block")] - 1))).groupBy("block", "part")

    def compare(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = {"query": [], "id": [], "score": []}
        if mine.num_rows and theirs.num_rows:
            x = matrix(mine.column("codes").combine_chunks(), dim)[1]
            ids = mine.column("id").to_numpy()
            for s in range(0, theirs.num_rows, block_of):
                some = theirs.slice(s, block_of)
                score = np.rint(x @ matrix(some.column("asks").combine_chunks(), dim)[1].T).astype(np.int64)
                i, j = np.nonzero(score >= least)
                out["query"].append(some.column("query").to_numpy()[j])
                out["id"].append(ids[i])
                out["score"].append(score[i, j])
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in out.items()})

    return left.cogroup(right).applyInArrow(compare, "query long, id long, score long")


def skipped(index: Index, queries: np.ndarray, least: int) -> float:
    """Share of (query, row) pairs that are not compared."""
    met = (index.bounds(queries) >= least) @ index.rows
    return 1 - float(met.sum()) / (len(queries) * index.rows.sum())

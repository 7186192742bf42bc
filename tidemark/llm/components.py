"""Connected components of a link table: the links of a partition shrink to a forest,
alternating stars bring those of several partitions together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_SENT, ROWS_A_TASK, cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that the links reach, but the least of each component, and that least node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        i, j = root[i], root[j]
        apart = i != j
        i, j = np.maximum(i, j)[apart], np.minimum(i, j)[apart]
        np.minimum.at(root, i, j)
        while (root[root] != root).any():
            root = root[root]
    hung = root != np.arange(len(nodes))
    return nodes[hung], nodes[root[hung]]


def _forests(edges: DataFrame, most: int) -> DataFrame:
    """A forest of the links (a, b) of every partition, or of ``most`` of them after another, that joins the same nodes."""

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = forest(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if held and sum(x.num_rows for x in held) + part.num_rows > most:
                    yield told(held)
                    held = []
                held.append(part)
        if held:
            yield told(held)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """Hangs every node's larger (or smaller) neighbours on its least neighbour.
    Minima are combined before the shuffle and the join can be split by AQE, so a
    node of very many links is no one task's work. At most ``parts`` partitions."""
    if large:
        both = edges.union(edges.select("b", "a")).toDF("u", "v").coalesce(parts)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    else:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).coalesce(parts)
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).union(least.select("u", "m"))
    return out.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).coalesce(parts).distinct().coalesce(parts)


def components(edges: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``edges`` (a long, b long) -> (node, root), root the least node reachable;
    only nodes that have a link. Up to ``most`` links, as many as may be broadcast, are
    joined by one task; more of them go by rounds, each with stars over all links and a
    forest of every partition's, until they are as few or are stars. No step lets a sum
    of a and b grow, and all leave it as it is only where every node hangs on its root.
    Every round is cut, so a lost executor costs a round at most, and takes no more
    partitions than its links need."""
    # dealt before: links that come from Python leave their own worker to the forest
    edges = cut(_forests(edges.where("a != b").distinct(), most))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    before = state(edges)
    while before[0] > most:
        parts = -(-before[0] // ROWS_A_TASK)
        edges = cut(_forests(_star(_star(edges, True, parts), False, parts), most))
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        edges = cut(_forests(edges.coalesce(1), most))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())

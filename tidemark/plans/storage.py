"""Queries of the shard store: the embeddings written as shard files, read by ranges, compacted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources import shard_files
from .queries import DIM, PLACED, codes, placed
from .registered import query
from .streams import scratch
from .tables import Tables

C = F.col
#: Rows of a shard here, and bytes of a ranged read.
SHARD_ROWS, RANGE = 16, 5 * DIM


def store(t: Tables) -> str:
    """A store of the placed vectors; label 3 lacks a row, so it has a gap."""
    path = scratch(t, "store")
    held, _, _ = placed(t)
    shard_files.write_store(held.select("event_id", "row_idx", vectors.packed(C("codes").cast("array<int>")).alias("codes")), path, DIM, SHARD_ROWS)
    return path


def summed(rows: DataFrame) -> DataFrame:
    """event_id, n, row_sum, first_sum (of the first byte, signed)."""
    byte = F.conv(F.hex(F.substring("codes", 1, 1)), 16, 10).cast("int")
    signed = F.when(byte > 127, byte - 256).otherwise(byte)
    return rows.groupBy("event_id").agg(F.count("*").alias("n"), F.sum("row_idx").alias("row_sum"), F.sum(signed).cast("long").alias("first_sum"))


SUMMED = "SELECT event_id, count(*) n, cast(sum(row_idx) as bigint) row_sum, cast(sum(c[1]) as bigint) first_sum FROM hd"


@query(f"{PLACED} {SUMMED} GROUP BY 1")
def store_ranges(t):
    """All rows back from the store, five rows a read."""
    return summed(shard_files.read_store(t.spark, store(t), DIM, RANGE))


@query(f"{PLACED} {SUMMED} WHERE event_id IN (2, 5) GROUP BY 1")
def store_pruned(t):
    """Two events of the store; the filter prunes the planned reads."""
    return summed(shard_files.read_store(t.spark, store(t), DIM).where("event_id in (2, 5)"))


@query(f"{PLACED}, g AS (SELECT *, row_idx // 16 s, row_idx - row_number() OVER (PARTITION BY event_id, row_idx // 16 ORDER BY row_idx) r FROM hd) SELECT event_id, cast(min(row_idx) as bigint) row_base, count(*) row_count FROM g GROUP BY event_id, s, r")
def store_directory(t):
    """The published directory: shards of 16 rows, cut where row numbers leave a gap."""
    return shard_files.listed(t.spark, store(t)).select("event_id", "row_base", "row_count")


@query(f"{PLACED}, k AS (SELECT event_id, count(*) n, max(event_id = 3) gap FROM hd GROUP BY 1) SELECT event_id, 'before' AS phase, if(gap, 'not_contiguous', if(n > 16, 'ok', 'single')) state, n row_count FROM k UNION ALL SELECT event_id, 'after', if(gap, 'not_contiguous', 'single'), n FROM k")
def store_compaction(t):
    """States before and after compaction to shards of 4,096 rows, old files deleted."""
    path = store(t)
    before = shard_files.compact_store(t.spark, path, DIM, 4096, delete_old=True)
    after = shard_files.compact_store(t.spark, path, DIM, 4096, dry_run=True)
    out = [df.select("event_id", F.lit(name).alias("phase"), "state", C("row_count").cast("long")) for name, df in (("before", before), ("after", after))]
    return out[0].unionByName(out[1])

"""Vector shards: raw files of one signed byte a dimension, their directory, and tables made of them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mutations import contiguity
from ..session import cut

# Fixed values.
SHORTCUT = "application/vnd.google-apps.shortcut"
IMAGE_MIMES = ("image/jpeg", "image/jpg", "image/png", "image/webp", "image/heic", "image/heif")
STRETCH = 8192
SEGMENT = 4 * 1024 * 1024
KEY = r"^index/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"


def segment_plan(shards: DataFrame, dim: int, segment_bytes: int = SEGMENT) -> DataFrame:
    """event_id, shard_key, offset, length: reads of at most ``segment_bytes``."""
    total = (F.col("row_count") * dim).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), total - 1, F.lit(segment_bytes).cast("long"))
    each = shards.where("row_count > 0").withColumn("total", total).withColumn("offset", F.explode(starts))
    return each.select("event_id", "shard_key", "offset", F.least(F.lit(segment_bytes).cast("long"), F.col("total") - F.col("offset")).alias("length"))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """shard_key (the file's name without ending) and content of raw shard files."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(name.alias("shard_key"), "content")


def explode_shards(files: DataFrame, shards: DataFrame, dim: int) -> DataFrame:
    """event_id, row_idx, codes of every row that the directory places and the
    files hold; rows of missing or short files are absent."""
    joined = files.join(shards, "shard_key").select("event_id", "row_base", "row_count", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for event, base, count, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                codes = np.frombuffer(content, np.int8)[: count * dim]
                rows = len(codes) // dim
                for at in range(0, rows, 4096):
                    part = codes[at * dim : min(rows, at + 4096) * dim]
                    n = len(part) // dim
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)), pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array([event] * n, pa.int64()), pa.array(base + at + np.arange(n)), lists], ["event_id", "row_idx", "codes"])

    return joined.mapInArrow(run, "event_id long, row_idx long, codes array<tinyint>")


def read_segments(files: DataFrame, plan: DataFrame) -> DataFrame:
    """event_id, shard_key, offset, length, bytes of the planned reads of ``files``
    (shard_key, content): a short file gives what it has, a missing one nothing."""
    part = F.substring(F.col("content"), F.col("offset").cast("int") + 1, F.col("length").cast("int"))
    read = plan.join(files, "shard_key").withColumn("bytes", part).where(F.length("bytes") > 0)
    return read.select("event_id", "shard_key", "offset", "length", "bytes")


def encode_shard(rows: DataFrame) -> DataFrame:
    """event_id, shard_key, content from (event_id, shard_key, row_idx, packed): a
    file's bytes in row order. A shard is one batch of photos, so a row of it."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "packed"))), lambda r: F.hex(r["packed"]))
    return rows.groupBy("event_id", "shard_key").agg(F.unhex(F.array_join(each, "")).alias("content"))


def write_vectors(vectors: DataFrame, path: str, mode: str = "append") -> None:
    """The table form: a folder per event, rows in order inside a file."""
    vectors.repartition("event_id").sortWithinPartitions("event_id", "row_idx").write.mode(mode).partitionBy("event_id").parquet(path)


def compact(vectors: DataFrame, shards: DataFrame, faces: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors, directory) with one shard for each event whose shards tile its
    rows; with ``faces``, without vectors that no face row owns any more."""
    sound = contiguity(shards).where("state = 'ok'")
    kept = vectors.join(sound.select("event_id"), "event_id", "left_semi")
    if faces is not None:
        kept = kept.join(faces.select("event_id", "row_idx"), ["event_id", "row_idx"], "left_semi")
    whole = sound.select("event_id", F.concat(F.lit("compact-"), F.col("row_count")).alias("shard_key"), F.lit(0).cast("long").alias("row_base"), "row_count")
    return kept, whole.unionByName(shards.join(sound.select("event_id"), "event_id", "left_anti").select(*whole.columns))


def shard_states(vectors: DataFrame, shards: DataFrame) -> DataFrame:
    """Per event: shards, row_count, state. Beside the states of ``contiguity``:
    'single' (nothing to merge) and 'bad_shards' (a shard has other than its number
    of rows in ``vectors``)."""
    # rows meet shards in stretches of STRETCH rows, so a large event is no one task's work
    held = vectors.select(F.col("event_id").alias("v_event"), "row_idx", F.floor(F.col("row_idx") / STRETCH).alias("v_at"))
    spans = shards.withColumn("at", F.explode(F.sequence(F.floor(F.col("row_base") / STRETCH), F.floor((F.col("row_base") + F.greatest(F.col("row_count"), F.lit(1)) - 1) / STRETCH))))
    place = (F.col("event_id") == F.col("v_event")) & (F.col("at") == F.col("v_at")) & (F.col("row_idx") >= F.col("row_base")) & (F.col("row_idx") < F.col("row_base") + F.col("row_count"))
    counts = spans.join(held, place, "left").groupBy("event_id", "shard_key", "row_count").agg(F.count("row_idx").alias("held"))
    bad = counts.where("held != row_count").select("event_id").distinct().withColumn("bad_", F.lit(True))
    told = contiguity(shards).join(bad, "event_id", "left")
    state = F.when(F.col("shards") == 1, "single").when(F.col("state") != "ok", F.col("state")).when(F.col("bad_"), "bad_shards").otherwise("ok")
    return told.select("event_id", "shards", "row_count", state.alias("state"))


def compact_checked(vectors: DataFrame, shards: DataFrame, faces: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``compact``, for events whose shards hold all the rows they declare; the
    others keep their shards and their vectors."""
    sound = cut(shard_states(vectors, shards).where("state = 'ok'"))
    some = shards.join(sound.select("event_id"), "event_id", "left_semi")
    moved, whole = compact(vectors, some, faces)
    rest = lambda df: df.join(sound.select("event_id"), "event_id", "left_anti")
    return moved.unionByName(rest(vectors)), whole.unionByName(rest(shards).select(*whole.columns))


def images_in(files: DataFrame, folders: DataFrame) -> DataFrame:
    """file_id, name, folder of the images that lie in ``folders`` (folder). files:
    parent, file_id, name, mime, target_id, target_mime; a shortcut stands for its target."""
    short = (F.col("mime") == SHORTCUT) & F.col("target_id").isNotNull()
    told = files.withColumns({"file_id": F.when(short, F.col("target_id")).otherwise(F.col("file_id")), "mime": F.when(short, F.col("target_mime")).otherwise(F.col("mime"))})
    return told.where(F.col("mime").isin(*IMAGE_MIMES)).join(folders.select(F.col("folder").alias("parent")), "parent", "left_semi").select("file_id", "name", F.col("parent").alias("folder"))


def walk_bounded(edges: DataFrame, root: str, most_folders: int = 500) -> tuple[DataFrame, DataFrame]:
    """(folders, one row: folders, truncated): the walk, cut after ``most_folders``
    in order of depth and name, and whether it was."""
    walked = cut(walk_edges(edges, root))
    kept = walked.orderBy("depth", "folder").limit(most_folders)
    total = walked.agg(F.count("*").alias("n"))
    return kept, total.select(F.least("n", F.lit(most_folders)).alias("folders"), (F.col("n") > most_folders).alias("truncated"))


def key_ok(column: str) -> Column:
    return F.coalesce(F.col(column).rlike(KEY), F.lit(False))


def walk_edges(edges: DataFrame, root: str) -> DataFrame:
    """Folders reachable from ``root`` in (parent, child), each once with its
    depth; a level is one join, cycles end."""
    seen = front = edges.sparkSession.createDataFrame([(root, 0)], "folder string, depth int")
    for depth in count(1):
        following = edges.join(front, F.col("parent") == F.col("folder"), "left_semi").select(F.col("child").alias("folder")).distinct()
        front = cut(following.join(seen, "folder", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % 16 == 0:
            seen = cut(seen)
    return seen


def log_rows(entries: DataFrame, now: Column) -> DataFrame:
    """Journal rows as stored: level 'info' by default, messages of 500 characters at most."""
    return entries.select(
        "event_id", "job_id", "source_id", F.coalesce("level", F.lit("info")).alias("level"), "code", F.substring("message", 1, 500).alias("message"), "file_id", now.alias("created_at")
    )


def append_log(entries: DataFrame, path: str, now: Column) -> None:
    log_rows(entries, now).write.mode("append").parquet(path)


def event_rules(events: DataFrame) -> DataFrame:
    """Settings with their defaults."""
    return events.select(
        "event_id",
        F.coalesce("bibs_enabled", F.lit(False)).alias("bibs_enabled"),
        F.coalesce("bib_min_digits", F.lit(3)).alias("bib_min_digits"),
        F.coalesce("bib_max_digits", F.lit(5)).alias("bib_max_digits"),
        F.coalesce("bib_prefixes", F.lit("")).alias("bib_prefixes"),
        F.coalesce("bib_prefix_required", F.lit(False)).alias("bib_prefix_required"),
    )

"""Shard files as a data source: ranged reads by plan, and a sink that publishes its directory last.

A store is a folder with ``index/<event>/<name>.bin`` (rows of ``dim`` signed bytes) and
``directory.parquet``, which lists the shards that exist: event_id, shard_key, row_base,
row_count. Only what the directory lists is there; files beside it are leftovers.

Reading: planned ranges of at most ``segment`` bytes (whole rows); a task opens their files,
seeks and reads those ranges and no more. A partition is one range, or with ``together``
neighbours in the directory up to so many bytes, so that small shards share tasks. A filter on event_id or
shard_key prunes the plan. A missing file gives no rows, a short one the whole rows it has.

Writing: rows are dealt by event and stretch of ``rows`` row numbers, so a shard is one
task's work however large the event is. A file's name tells its place and its bytes, so
a retried task writes the same files again. Tasks only add files; the driver writes a new
directory beside the old one and renames it when all have ended. A failed job deletes
what its ended tasks wrote unless the directory lists it, and changes nothing else.

Defined cases: an empty table publishes nothing; a null event, row number or vector and
rows of another length than ``dim`` are refused (ValueError), as are two rows of one place.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..session import cut
from .shards import SEGMENT, shard_states

ROWS = 8192
#: What opening a file or a range is worth in bytes when ranges share a task, and rows of a batch of theirs.
OPENING, BATCH = 4096, 8192
DIRECTORY = pa.schema([("event_id", pa.int64()), ("shard_key", pa.string()), ("row_base", pa.int64()), ("row_count", pa.int64())])
SCHEMA = "event_id long, row_idx long, codes binary"


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A path or URI of any store that Arrow knows."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def exists(fs: pyarrow.fs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type == pyarrow.fs.FileType.File


def shard_path(root: str, shard: dict) -> str:
    return f"{root}/index/{shard['event_id']}/{shard['shard_key']}.bin"


def delete_shard(path: str, shard: dict) -> None:
    fs, root = filesystem(path)
    if exists(fs, shard_path(root, shard)):
        fs.delete_file(shard_path(root, shard))


def directory(path: str) -> pa.Table:
    """The shards that are published in the store: one small row a shard."""
    fs, root = filesystem(path)
    at = f"{root}/directory.parquet"
    return pyarrow.parquet.read_table(at, filesystem=fs, schema=DIRECTORY) if exists(fs, at) else DIRECTORY.empty_table()


def publish(path: str, shards: pa.Table) -> None:
    """Makes ``shards`` the store's directory in one step: written beside it, then renamed."""
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    ordered = shards.sort_by([("event_id", "ascending"), ("row_base", "ascending"), ("shard_key", "ascending")])
    pyarrow.parquet.write_table(ordered, f"{root}/directory.next", filesystem=fs)
    fs.move(f"{root}/directory.next", f"{root}/directory.parquet")


@dataclass
class Range(InputPartition):
    """Rows first .. first + rows - 1 of a shard's file."""

    event_id: int
    shard_key: str
    row_base: int
    first: int
    rows: int

    def __post_init__(self) -> None:
        super().__init__((self.event_id, self.shard_key, self.first))


@dataclass
class Ranges(InputPartition):
    """Ranges of several shards: (event_id, shard_key, row_base, first, rows) of each stretch, read range by range."""

    of: list[tuple[int, str, int, int, int]]

    def __post_init__(self) -> None:
        super().__init__(tuple(self.of[0]))


class ShardReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.dim = options["path"], int(options["dim"])
        self.rows = max(1, int(options.get("segment", SEGMENT)) // self.dim)
        self.together = int(options.get("together", 0))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column == "event_id":
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Range] | list[Ranges]:
        plan, held, size = [], [], 0
        for s in directory(self.path).to_pylist():
            if not all(s[c] in values for c, values in self.wanted.items()):
                continue
            place = (s["event_id"], s["shard_key"], s["row_base"])
            for at in range(0, s["row_count"], self.rows):
                rows = min(self.rows, s["row_count"] - at)
                if not self.together:
                    plan.append(Range(*place, at, rows))
                    continue
                if held and size + rows * self.dim + OPENING > self.together:
                    plan.append(Ranges(held))
                    held, size = [], 0
                if held and held[-1][:3] == place:  # goes on
                    held[-1] = (*place, held[-1][3], held[-1][4] + rows)
                else:
                    held.append((*place, at, rows))
                size += rows * self.dim + OPENING
        return plan + [Ranges(held)] if held else plan

    def read(self, partition: Range | Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty plan
            return
        if isinstance(partition, Range):
            yield from self._stretch(partition.event_id, partition.shard_key, partition.row_base, partition.first, partition.rows)
            return
        held: list[pa.RecordBatch] = []
        for stretch in partition.of:
            for batch in self._stretch(*stretch):
                held.append(batch)
                if batch.num_rows >= BATCH or len(held) >= BATCH // 8:
                    yield pa.concat_batches(held)
                    held = []
        if held:
            yield pa.concat_batches(held)

    def _stretch(self, event_id: int, shard_key: str, row_base: int, first: int, rows: int) -> Iterator[pa.RecordBatch]:
        """A batch of every range of ``self.rows`` rows from row ``first`` of a shard."""
        fs, root = filesystem(self.path)
        at = shard_path(root, {"event_id": event_id, "shard_key": shard_key})
        if not exists(fs, at):
            return
        with fs.open_input_file(at) as file:
            size = file.size()
            for begin in range(first, first + rows, self.rows):
                wanted = min(self.rows, first + rows - begin) * self.dim
                data = file.read_at(min(wanted, max(0, size - begin * self.dim)), begin * self.dim)
                n = len(data) // self.dim
                if n:
                    codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.dim), n, [None, pa.py_buffer(data[: n * self.dim])]).cast(pa.binary())
                    idx = row_base + begin + np.arange(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, event_id)), pa.array(idx), codes], ["event_id", "row_idx", "codes"])


@dataclass
class Written(WriterCommitMessage):
    shards: list[dict]


class ShardWriter(DataSourceArrowWriter):
    """Takes rows in order of event and place; a file ends where a stretch of ``rows`` numbers ends."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.dim, self.rows = options["path"], int(options["dim"]), int(options.get("rows", ROWS))
        self.overwrite, self.name = overwrite, options.get("name", "s")
        if not re.fullmatch("[A-Za-z0-9_.-]+", self.name):
            raise ValueError(f"a shard's name has letters, digits, '_', '.' and '-' only, not {self.name!r}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        done: list[dict] = []
        held: list[bytes] = []
        place: tuple[int, int] | None = None

        def close() -> None:
            if not held:
                return
            event, first = place
            data = b"".join(held)
            key = f"{self.name}{first:012d}-{hashlib.sha256(data).hexdigest()[:16]}"
            folder = f"{root}/index/{event}"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{key}.bin") as out:
                out.write(data)
            done.append({"event_id": event, "shard_key": key, "row_base": first, "row_count": len(held)})
            held.clear()

        def take(event: int | None, idx: int | None, codes: bytes | None) -> None:
            nonlocal place
            if event is None or idx is None or codes is None or len(codes) != self.dim:
                raise ValueError(f"row {idx} of event {event} has no vector of {self.dim} bytes")
            same = bool(held) and place[0] == event
            if same and idx < place[1] + len(held):
                raise ValueError(f"two rows at {idx} of event {event}, or out of order")
            if not same or idx > place[1] + len(held) or idx % self.rows == 0:
                close()
                place = (event, idx)
            held.append(codes)

        try:
            for batch in iterator:
                for row in zip(*(batch.column(c).to_pylist() for c in ("event_id", "row_idx", "codes")), strict=True):
                    take(*row)
            close()
        except BaseException:
            self._forget(done)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        new = [s for m in messages if m for s in m.shards]
        if not new and not self.overwrite:
            return
        of_event: dict[int, list[dict]] = {}
        for s in new:
            of_event.setdefault(s["event_id"], []).append(s)
        end = lambda s: s["row_base"] + s["row_count"]
        for shards in of_event.values():
            shards.sort(key=lambda n: n["row_base"])  # no two share a place
        ends = {event: [end(n) for n in shards] for event, shards in of_event.items()}
        kept = []
        for s in [] if self.overwrite else directory(self.path).to_pylist():
            # rows that are written again replace the shards that held them
            again, of = 0, of_event.get(s["event_id"], [])
            for i in range(bisect_right(ends.get(s["event_id"], []), s["row_base"]), len(of)):
                if of[i]["row_base"] >= end(s):
                    break
                again += min(end(s), end(of[i])) - max(s["row_base"], of[i]["row_base"])
            if 0 < again < s["row_count"]:
                raise ValueError(f"shard {s['shard_key']} of event {s['event_id']} would be replaced in part")
            kept += [] if again else [s]
        publish(self.path, pa.Table.from_pylist(kept + new, DIRECTORY))

    def abort(self, messages: list[Written | None]) -> None:
        self._forget([s for m in messages if m for s in m.shards])

    def _forget(self, shards: list[dict]) -> None:
        """Deletes files of ``shards`` that the directory does not list."""
        known = {(s["event_id"], s["shard_key"]) for s in directory(self.path).to_pylist()}
        for s in shards:
            if (s["event_id"], s["shard_key"]) not in known:
                delete_shard(self.path, s)


class ShardStore(DataSource):
    """Options: path, dim; to read: segment (bytes of a range), together (bytes of the ranges of a task); to write: rows (of a shard), name."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options)

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShardStore)
    return spark


def read_store(spark: SparkSession, path: str, dim: int, segment: int = SEGMENT) -> DataFrame:
    """event_id, row_idx, codes (binary) of all rows that the store's directory lists; a task
    reads ranges of ``segment`` bytes at most, as many as come to ``SEGMENT`` bytes."""
    return registered(spark).read.format("tidemark_shards").option("dim", dim).option("segment", segment).option("together", SEGMENT).load(path)


def write_store(rows: DataFrame, path: str, dim: int, per_shard: int = ROWS, mode: str = "append", name: str = "s") -> None:
    """Adds ``rows`` (event_id, row_idx, codes as binary) to the store in shards of ``per_shard``
    row numbers; mode 'overwrite' makes them all that it lists."""
    registered(rows.sparkSession)
    plain = rows.select(F.col("event_id").cast("long"), F.col("row_idx").cast("long"), "codes").withColumn("shard_", F.floor(F.col("row_idx") / per_shard))
    dealt = plain.repartition("event_id", "shard_").sortWithinPartitions("event_id", "row_idx").drop("shard_")
    dealt.write.format("tidemark_shards").option("dim", dim).option("rows", per_shard).option("name", name).mode(mode).save(path)


def listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(directory(path).to_pandas(), "event_id long, shard_key string, row_base long, row_count long")


def compact_store(spark: SparkSession, path: str, dim: int, per_shard: int = 1 << 17, dry_run: bool = False, delete_old: bool = False) -> DataFrame:
    """Merges each event's shards into ones of ``per_shard`` rows where they tile the event's
    rows and their files are whole: the new files first, the directory last, then with
    ``delete_old`` the old files. Returns event_id, shards, row_count, state ('ok' is what is
    or would be merged) as it was before. An event whose shards are as large already is 'single'."""
    before = directory(path)
    rows = read_store(spark, path, dim)
    states = shard_states(rows.select("event_id", "row_idx"), listed(spark, path))
    small = listed(spark, path).groupBy("event_id").agg((F.count("*") > F.ceil(F.sum("row_count") / per_shard)).alias("small_"))
    told = cut(states.join(small, "event_id").withColumn("state", F.when((F.col("state") == "ok") & ~F.col("small_"), "single").otherwise(F.col("state"))).drop("small_"))
    sound = told.where("state = 'ok'").select("event_id")
    if dry_run or sound.isEmpty():
        return told
    write_store(rows.join(sound, "event_id", "left_semi"), path, dim, per_shard, name="compact-")
    if delete_old:
        now = {(s["event_id"], s["shard_key"]) for s in directory(path).to_pylist()}
        old = [s for s in before.to_pylist() if (s["event_id"], s["shard_key"]) not in now]
        if old:
            gone = spark.createDataFrame(pa.Table.from_pylist(old, DIRECTORY).to_pandas()).repartition("shard_key")
            gone.foreachPartition(lambda rows: [delete_shard(path, s.asDict()) for s in rows] and None)
    return told

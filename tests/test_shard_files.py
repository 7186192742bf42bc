"""The shard store: what tasks read, what is visible after failures, retries and compaction."""

from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.sources import shard_files, shards

DIM = 4
ROWS = "event_id long, row_idx long, codes binary"


def code(event, idx):
    return np.array([event, idx % 100, -idx % 7, idx // 100], np.int8).tobytes()


def table(spark, places):
    return spark.createDataFrame([(e, i, bytearray(code(e, i))) for e, i in places], ROWS).repartition(3)


def stored(spark, path, **more):
    return sorted((r.event_id, r.row_idx, bytes(r.codes)) for r in shard_files.read_store(spark, path, DIM, **more).collect())


def rows_of(places):
    return sorted((e, i, code(e, i)) for e, i in places)


def files(path):
    return sorted(p.name for p in Path(path).rglob("*.bin"))


def test_round_trip_in_shards_of_fixed_size(spark, tmp_path):
    path = f"{tmp_path}/store"
    places = [(1, i) for i in range(250)] + [(2, i) for i in range(40)] + [(3, i) for i in (5, 6, 7, 90)]
    shard_files.write_store(table(spark, places), path, DIM, per_shard=100)
    assert stored(spark, path) == rows_of(places)
    sizes = [(s["event_id"], s["row_base"], s["row_count"]) for s in shard_files.directory(path).to_pylist()]
    assert sizes == [(1, 0, 100), (1, 100, 100), (1, 200, 50), (2, 0, 40), (3, 5, 3), (3, 90, 1)]
    frame = shard_files.listed(spark, path)
    assert frame.select(F.concat(F.lit("index/e/"), "shard_key").alias("key")).where(~shards.key_ok("key")).count() == 0
    # the same rows again change nothing, others are added
    before = (files(path), shard_files.directory(path))
    shard_files.write_store(table(spark, places), path, DIM, per_shard=100)
    assert (files(path), shard_files.directory(path)) == before
    shard_files.write_store(table(spark, [(9, 0)]), path, DIM)
    assert stored(spark, path) == rows_of([*places, (9, 0)])
    shard_files.write_store(table(spark, [(9, 1)]), path, DIM, mode="overwrite")
    assert stored(spark, path) == rows_of([(9, 1)])


class Counting:
    """A store that notes what is read of its files."""

    def __init__(self, fs):
        self.fs, self.read = fs, Counter()

    def __getattr__(self, name):
        return getattr(self.fs, name)

    def open_input_file(self, at):
        outer, file = self, self.fs.open_input_file(at)

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                file.close()

            def size(self):
                return file.size()

            def read_at(self, n, begin):
                data = file.read_at(n, begin)
                outer.read["bytes"] += len(data)
                return data

        return File()


@pytest.mark.parametrize("segment", [1 << 22, 64, 10, 1])
def test_a_task_reads_its_range_only(spark, tmp_path, monkeypatch, segment):
    path = f"{tmp_path}/store"
    shard_files.write_store(table(spark, [(e, i) for e in (1, 2) for i in range(150)]), path, DIM, per_shard=100)
    reader = shard_files.ShardReader({"path": path, "dim": str(DIM), "segment": str(segment)})
    parts, got = reader.partitions(), []
    fs, root = shard_files.filesystem(path)
    for part in parts:
        counting = Counting(fs)
        monkeypatch.setattr(shard_files, "filesystem", lambda _, c=counting: (c, root))
        for batch in reader.read(part):
            got += zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        assert counting.read["bytes"] <= max(segment, DIM)
    assert sorted(got) == rows_of([(e, i) for e in (1, 2) for i in range(150)])
    assert len(parts) == {1 << 22: 4, 64: 2 * (7 + 4), 10: 150, 1: 300}[segment]


def test_largest_range_is_four_mebibytes(tmp_path):
    shard_files.publish(f"{tmp_path}", pa.Table.from_pylist([{"event_id": 1, "shard_key": "big", "row_base": 7, "row_count": 20_000}], shard_files.DIRECTORY))
    parts = shard_files.ShardReader({"path": str(tmp_path), "dim": "512"}).partitions()
    assert [(p.first, p.rows) for p in parts] == [(0, 8192), (8192, 8192), (16384, 3616)] and all(p.rows * 512 <= 4 << 20 for p in parts)


def test_filters_prune_the_plan(spark, tmp_path):
    path = f"{tmp_path}/store"
    shard_files.write_store(table(spark, [(e, i) for e in range(6) for i in range(10)]), path, DIM)
    some = shard_files.read_store(spark, path, DIM)
    for where, events in (("event_id = 3", [3]), ("event_id in (1, 4)", [1, 4]), ("event_id = 3 and event_id = 4", []), ("event_id = 2 and row_idx < 5", [2])):
        found = some.where(where)
        assert sorted({r.event_id for r in found.collect()}) == events
        assert found.rdd.getNumPartitions() <= max(1, len(events))
    pushed = shard_files.ShardReader({"path": path, "dim": str(DIM)})
    assert list(pushed.pushFilters([shard_files.EqualTo(("event_id",), 3), shard_files.EqualTo(("row_idx",), 1)])) == [shard_files.EqualTo(("row_idx",), 1)]
    assert {p.event_id for p in pushed.partitions()} == {3}


def test_missing_and_short_files(spark, tmp_path):
    path = f"{tmp_path}/store"
    shard_files.write_store(table(spark, [(1, i) for i in range(30)]), path, DIM, per_shard=10)
    gone, short, _ = sorted(Path(path).rglob("*.bin"))
    gone.unlink()
    short.write_bytes(short.read_bytes()[: 3 * DIM + 2])
    assert stored(spark, path, segment=2 * DIM) == rows_of([(1, i) for i in (10, 11, 12, *range(20, 30))])


def test_a_failed_job_publishes_nothing(spark, tmp_path):
    path = f"{tmp_path}/store"
    shard_files.write_store(table(spark, [(1, i) for i in range(20)]), path, DIM, per_shard=10)
    before = (files(path), shard_files.directory(path))

    def late(batches):
        for batch in batches:
            yield batch
        raise RuntimeError("lost")

    broken = table(spark, [(2, i) for i in range(500)]).mapInArrow(late, ROWS)
    with pytest.raises(Exception, match="lost"):
        shard_files.write_store(broken, path, DIM, per_shard=10)
    assert (files(path), shard_files.directory(path)) == before
    for bad in ([(3, 0, None)], [(3, 0, bytearray(b"abc"))], [(3, 0, bytearray(DIM)), (3, 0, bytearray(DIM))], [(None, 0, bytearray(DIM))]):
        rows = spark.createDataFrame([(4, i, bytearray(code(4, i))) for i in range(30)] + bad, ROWS)
        with pytest.raises(Exception, match="no vector|two rows"):
            shard_files.write_store(rows, path, DIM, per_shard=10)
        assert shard_files.directory(path) == before[1] and stored(spark, path) == rows_of([(1, i) for i in range(20)])
    with pytest.raises(Exception, match="in part"):
        shard_files.write_store(table(spark, [(1, 5)]), path, DIM)
    assert shard_files.directory(path) == before[1]


def test_a_retried_task_writes_the_same_files(tmp_path):
    """An attempt that dies after its files leaves them unseen; the next one's are the same."""
    batch = pa.RecordBatch.from_pydict({"event_id": [1] * 25, "row_idx": list(range(25)), "codes": [code(1, i) for i in range(25)]})
    writer = shard_files.ShardWriter({"path": str(tmp_path), "dim": str(DIM), "rows": "10"}, False)
    first = writer.write(iter([batch]))  # its message is lost with its executor
    assert shard_files.directory(str(tmp_path)).num_rows == 0
    left = files(tmp_path)
    second = writer.write(iter([batch.slice(0, 7), batch.slice(7)]))
    assert second.shards == first.shards and files(tmp_path) == left
    writer.commit([second, None])
    assert [s["row_count"] for s in shard_files.directory(str(tmp_path)).to_pylist()] == [10, 10, 5]
    writer.abort([second])  # listed files stay
    assert files(tmp_path) == left


def test_compaction(spark, tmp_path):
    path = f"{tmp_path}/store"
    places = [(1, i) for i in range(95)] + [(2, i) for i in range(8)] + [(3, i) for i in range(30) if i != 17] + [(4, i) for i in range(30)]
    shard_files.write_store(table(spark, places), path, DIM, per_shard=10)
    cut_file = next(p for p in sorted(Path(f"{path}/index/4").iterdir()))
    cut_file.write_bytes(cut_file.read_bytes()[:-DIM])
    places.remove((4, 9))
    before = (files(path), shard_files.directory(path))
    dry = shard_files.compact_store(spark, path, DIM, 40, dry_run=True)
    states = {r.event_id: r.state for r in dry.collect()}
    assert states == {1: "ok", 2: "single", 3: "not_contiguous", 4: "bad_shards"} and (files(path), shard_files.directory(path)) == before
    shard_files.compact_store(spark, path, DIM, 40)
    assert stored(spark, path) == rows_of(places)
    assert [(s["row_base"], s["row_count"]) for s in shard_files.directory(path).to_pylist() if s["event_id"] == 1] == [(0, 40), (40, 40), (80, 15)]
    assert set(before[0]) < set(files(path))
    shard_files.write_store(table(spark, [(5, i) for i in range(20)]), path, DIM, per_shard=10)
    told = shard_files.compact_store(spark, path, DIM, 40, delete_old=True)
    assert {r.event_id: r.state for r in told.collect()} == {1: "single", 2: "single", 3: "not_contiguous", 4: "bad_shards", 5: "ok"}
    assert len([f for f in Path(f"{path}/index/5").iterdir()]) == 1 and stored(spark, path) == rows_of(places + [(5, i) for i in range(20)])


def test_an_empty_table(spark, tmp_path):
    path = f"{tmp_path}/store"
    shard_files.write_store(table(spark, [(1, 0)]).where("false"), path, DIM)
    assert stored(spark, path) == [] and shard_files.compact_store(spark, path, DIM).count() == 0


def test_small_ranges_share_tasks(spark, tmp_path):
    """Many shards of ten rows, read five rows at a time: few tasks, the same rows and ranges."""
    path = f"{tmp_path}/store"
    places = [(e, i) for e in (1, 2) for i in range(400)]
    shard_files.write_store(table(spark, places), path, DIM, per_shard=10)
    found = shard_files.read_store(spark, path, DIM, 5 * DIM)
    assert found.rdd.getNumPartitions() == 1 and stored(spark, path, segment=5 * DIM) == rows_of(places)
    reader = shard_files.ShardReader({"path": path, "dim": str(DIM), "segment": str(7 * DIM), "together": str(3 * (7 * DIM + shard_files.OPENING))})
    parts = reader.partitions()
    assert len(parts) < 80 and sorted(r for p in parts for b in reader.read(p) for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)) == rows_of(places)

"""Several tables from one stream: killed anywhere, run again, equal to an unbroken run."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import ingest

SCHEMA = "photo long, vector int, bib string"


def feed(spark, folder, batches=4):
    for k in range(batches):
        rows = [(10 * k + i, i * k, f"B-{i}" if i % 2 else None) for i in range(6)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{k}")
        time.sleep(0.02)


class Lost(Exception):
    pass


def tables(fail_at=None, tries=None):
    """The sinks vectors, bibs, done; the ``fail_at``-th write of all is lost, before or after it wrote."""
    calls = [0]

    def sink(columns, where):
        def work(df):
            calls[0] += 1
            out = df.where(where).select(*columns)
            if fail_at is not None and calls[0] == fail_at[0]:
                if fail_at[1]:  # half of it is there already
                    out.limit(1).write.mode("overwrite").parquet(fail_at[1])
                raise Lost("lost")
            return out

        return work

    return [("vectors", sink(["photo", "vector"], "true")), ("bibs", sink(["photo", "bib"], "bib is not null")), ("done", sink(["photo"], "true"))]


def seen(spark, target):
    return {n: sorted(map(str, ingest.committed(spark, target, n).collect())) for n in ("vectors", "bibs", "done")}


@pytest.fixture(scope="module")
def unbroken(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    feed(spark, f"{folder}/in")
    ingest.run_ordered(spark, f"{folder}/in/*", SCHEMA, f"{folder}/out", f"{folder}/state", tables())
    assert len(list((folder / "out" / "committed").iterdir())) == 2  # marks do not pile up
    return folder, seen(spark, f"{folder}/out")


@pytest.mark.parametrize("at", [1, 2, 3, 5, 6, 9, 12])
def test_killed_between_any_two_tables(spark, tmp_path, unbroken, at):
    source, whole = f"{unbroken[0]}/in/*", unbroken[1]
    target, state = f"{tmp_path}/out", f"{tmp_path}/state"
    half = f"{target}/{('vectors', 'bibs', 'done')[(at - 1) % 3]}/batch={(at - 1) // 3}"
    with pytest.raises(Exception, match="lost"):
        ingest.run_ordered(spark, source, SCHEMA, target, state, tables((at, half if at % 2 else None)))
    if at > 3:  # the batches before are whole, this one is in no table
        part = {n: [r for r in rows if int(r.split("batch=")[1].split(",")[0]) < (at - 1) // 3] for n, rows in whole.items()}
        if at >= 6 or (tmp_path / "out" / "done").exists():
            assert seen(spark, target) == part
    ingest.run_ordered(spark, source, SCHEMA, target, state, tables())
    assert seen(spark, target) == whole


def test_the_mark_itself_is_lost(spark, tmp_path, unbroken, monkeypatch):
    source, whole = f"{unbroken[0]}/in/*", unbroken[1]
    real, calls = ingest.F.lit, [0]

    def lit(value):
        calls[0] += value == 2 and not isinstance(value, bool)
        if calls[0] == 1 and value == 2:
            raise Lost("lost")
        return real(value)

    monkeypatch.setattr(ingest.F, "lit", lit)
    with pytest.raises(Exception, match="lost"):
        ingest.run_ordered(spark, source, SCHEMA, f"{tmp_path}/out", f"{tmp_path}/state", tables())
    monkeypatch.setattr(ingest.F, "lit", real)
    assert all("batch=2" not in r for rows in seen(spark, f"{tmp_path}/out").values() for r in rows)
    ingest.run_ordered(spark, source, SCHEMA, f"{tmp_path}/out", f"{tmp_path}/state", tables())
    assert seen(spark, f"{tmp_path}/out") == whole
    assert F.lit is real

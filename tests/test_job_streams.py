"""Streams with state against their batch forms and against a plain fold, whatever the batches."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reports
from tidemark.streaming import jobs

NEWS = "job_id long, status string, updated_at timestamp"
LOG = "job_id long, seq long, kind string, value long"
NOON = datetime.datetime(2024, 3, 1, 12)


def files(spark, rows, schema, folder, parts):
    """One file a part, taken one a batch in order of time."""
    for k, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.parquet(f"{folder}/{k:03d}")
        time.sleep(0.02)


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def told(df):
    return sorted(tuple(r) for r in df.collect())


def news(rng, jobs_=6, n=120):
    """In order of time but for swaps of a few minutes."""
    at, rows = 0, []
    for _ in range(n):
        at += rng.choice([10, 30, 90, 400])
        rows.append((rng.randrange(jobs_), rng.choice(["queued", "running", "running", "done", None]), NOON + datetime.timedelta(seconds=at - rng.choice([0, 0, 200]))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_stalls_by_event_time(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = news(rng)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    files(spark, rows, NEWS, f"{tmp_path}/in", [range(a, b) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)])
    found = jobs.stalls(source(spark, f"{tmp_path}/in", NEWS), 20 * 60_000)
    jobs.drained(found, f"{tmp_path}/out", f"{tmp_path}/state")
    got = told(spark.read.parquet(f"{tmp_path}/out"))
    table = spark.createDataFrame(rows, NEWS)
    assert got == told(jobs.stalls_so_far(table)) and got
    # each is what the batch check of the same moment says of the job
    for job, status, since in got:
        last = table.where((F.col("job_id") == job) & (F.col("updated_at") <= since + datetime.timedelta(minutes=20))).orderBy(F.desc("updated_at"), F.desc("status")).limit(1)
        state = reports.stale(last, F.lit(since + datetime.timedelta(minutes=20, seconds=1)))
        assert [(r.status, r.updated_at, r.stalled) for r in state.collect()] == [(status, since, True)]


def test_stalls_by_the_clock_and_after_a_restart(spark, tmp_path):
    """Told once, not again without news, again after news; a restart knows what was told."""
    folder, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    put = lambda k, rows: spark.createDataFrame([(j, s, NOON) for j, s in rows], NEWS).coalesce(1).write.parquet(f"{folder}/{k}")
    put(0, [(1, "running"), (2, "done"), (3, "queued")])

    def start():
        found = jobs.stalls(source(spark, folder, NEWS), 3_000, by_event_time=False).select("job_id", "status")
        return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="500 milliseconds").start()

    def wait_for(n):
        for _ in range(120):
            time.sleep(0.5)
            got = told(spark.read.schema("job_id long, status string").parquet(out)) if (tmp_path / "out" / "_spark_metadata").exists() else []
            if len(got) >= n:
                time.sleep(4)  # nothing more comes of itself
                return told(spark.read.schema("job_id long, status string").parquet(out))
        raise AssertionError(got)

    query = start()
    try:
        assert wait_for(2) == [(1, "running"), (3, "queued")]
        query.stop()
        query = start()
        put(1, [(1, "running"), (3, "done"), (2, "running")])
        assert wait_for(4) == [(1, "running"), (1, "running"), (2, "running"), (3, "queued")]
    finally:
        query.stop()


def history(rng, jobs_=5, n=150):
    rows = []
    for job in range(jobs_):
        kinds = rng.choices(jobs.KINDS, weights=[1, 8, 1 if job else 0, 6 if job else 40], k=n)
        rows += [(job, i, k, rng.choice([None, 0, 3, 9]) if k == "progress" else None) for i, k in enumerate(kinds)]
    # one job that reaches the bound of attempts
    rows += [(99, i, "progress" if i % 2 == 0 else "end", 5 if i % 2 == 0 else None) for i in range(140)]
    return rows


def folded(rows):
    out, state = [], {}
    for job, seq, kind, value in sorted(rows, key=lambda r: r[:2]):
        state[job], decision = jobs.fold(state.get(job, (0, 0, False)), kind, value)
        if decision:
            out.append((job, seq, *decision))
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_whatever_the_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = history(rng)
    order = list(range(len(rows)))
    rng.shuffle(order)
    order += rng.sample(order, 60)  # repeated
    cuts = sorted(rng.sample(range(1, len(order)), 3))
    files(spark, rows, LOG, f"{tmp_path}/in", [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True)])
    stream = jobs.rounds(source(spark, f"{tmp_path}/in", LOG))
    jobs.drained(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=lambda r: r[:2])
    assert got == folded(rows) and {r[3] for r in got} >= {None, "stop_requested", "no_progress", "max_attempts"}
    batch = jobs.rounds_so_far(spark.createDataFrame([rows[i] for i in order], LOG))
    assert sorted((tuple(r) for r in batch.collect()), key=lambda r: r[:2]) == got


def test_rounds_wait_for_a_missing_row_over_a_restart(spark, tmp_path):
    rows = [(1, 0, "start", None), (1, 2, "end", None), (1, 1, "progress", 4), (1, 3, "end", None)]
    files(spark, rows[:2], LOG, f"{tmp_path}/in", [range(2)])
    run = lambda: jobs.drained(jobs.rounds(source(spark, f"{tmp_path}/in", LOG)), f"{tmp_path}/out", f"{tmp_path}/state")
    run()
    assert spark.read.schema(jobs.Rounds.OUT).parquet(f"{tmp_path}/out").count() == 0
    spark.createDataFrame(rows[2:], LOG).coalesce(1).write.parquet(f"{tmp_path}/in/later")
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 2, True, None, "queued", 1), (1, 3, False, "no_progress", "partial", 1)]


def test_the_fold_agrees_with_the_batch_rule(spark):
    cases = [(done, attempts, stop) for done in (0, 1, None) for attempts in (0, 59, 60, 61) for stop in (0, 1)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "job_id int, done int, attempts int, stop_requested int")
    for r in reports.continuation(df).collect():
        done, attempts, stop = cases[r.job_id]
        assert tuple(r)[1:] == jobs.fold((done or 0, attempts, bool(stop)), "end", None)[1]

"""What the state of the job streams holds: little for many rows."""

import datetime

from tidemark.streaming import jobs

NOON = datetime.datetime(2024, 3, 1, 12)


def state_rows(spark, tmp_path, rows, schema, work):
    """The most rows that the state held while the stream took ``rows``."""
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    found = work(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    run = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return max(s.numRowsTotal for p in run.recentProgress for s in p.stateOperators)


def test_stalls_hold_a_session_not_its_news(spark, tmp_path):
    rows = [(1, "running", NOON + datetime.timedelta(seconds=s)) for s in range(400)]
    assert state_rows(spark, tmp_path, rows, "job_id long, status string, updated_at timestamp", jobs.stalls) <= 2


def test_rounds_hold_early_rows_by_stretches(spark, tmp_path):
    rows = [(1, s, "progress", s) for s in range(1, 400)]  # the first row is missing
    assert state_rows(spark, tmp_path, rows, "job_id long, seq long, kind string, value long", jobs.rounds) <= 4

"""Queries of streams with state: a user's events are the news and the log of a job."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import ingest, jobs
from .registered import query
from .tables import Tables

STATUS = "element_at(array('queued', 'running', 'done'), cast(event_id % 3 + 1 as int))"


def scratch(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{np.random.default_rng().integers(1 << 60)}"


def replayed(t: Tables, parts: list[DataFrame], work, name: str) -> DataFrame:
    """What the stream ``work`` tells of ``parts``, which come one after the other; the
    stream stops in between and goes on from its state. A part is as many files as its tasks make."""
    folder = scratch(t, name)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        found = work(t.spark.readStream.schema(part.schema).parquet(f"{folder}/in"))
        jobs.drained(found, f"{folder}/out", f"{folder}/state")
    return t.spark.read.schema(found.schema).parquet(f"{folder}/out")


NEWS = "SELECT user_id job_id, epoch_ms(ts) ms, max(ts) ts, arg_max((['queued', 'running', 'done'])[event_id % 3 + 1], ts) status FROM events GROUP BY ALL"


@query(f""", n AS ({NEWS}), q AS (SELECT *, lead(ms) OVER (PARTITION BY job_id ORDER BY ms) later, (SELECT max(epoch_ms(ts)) FROM events) - 600000 mark FROM n)
SELECT job_id, status, ts quiet_since FROM q WHERE status <> 'done' AND coalesce(later > ms + 1200000, true) AND ms + 1200000 < mark""")
def stall_alerts(t):
    """Every stretch of over 20 minutes without news of an active job, told by the stream as its watermark passes it."""
    news = t.raw("events").selectExpr("user_id job_id", f"{STATUS} status", "cast(ts as timestamp) updated_at")
    ends = news.agg(F.min("updated_at").alias("a"), F.max("updated_at").alias("b")).first()  # a row
    half = F.lit(ends.a + (ends.b - ends.a) / 2) if ends.a else F.lit(None).cast("timestamp")
    found = replayed(t, [news.where(F.col("updated_at") <= half), news.where(F.col("updated_at") > half)], jobs.stalls, "stalls")
    return found.withColumn("quiet_since", F.col("quiet_since").cast("timestamp_ntz"))


KIND = "case when event_id % 23 = 0 then 'start' when event_id % 19 = 0 then 'stop' when event_id % 4 = 0 then 'end' else 'progress' end"
DONE = "case when event_id % 5 > 0 then cast(event_id % 3 as bigint) end"


@query(f""", lg AS (SELECT user_id job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 seq, {KIND} kind, {DONE} "value" FROM events),
a AS (SELECT *, sum(cast(kind = 'start' as int)) OVER j life, coalesce(sum(cast(kind = 'end' as int)) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) round FROM lg WINDOW j AS (PARTITION BY job_id ORDER BY seq)),
b AS (SELECT *, max(kind = 'stop') OVER (PARTITION BY job_id, life ORDER BY seq) stop, coalesce(last_value(if(kind = 'progress', "value", null) IGNORE NULLS) OVER (PARTITION BY job_id, life, round ORDER BY seq), 0) done FROM a),
c AS (SELECT *, least(60, coalesce(sum(cast(NOT stop AND done <> 0 as int)) OVER (PARTITION BY job_id, life ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) tried FROM b WHERE kind = 'end'),
d AS (SELECT *, case when stop then 'stop_requested' when done = 0 then 'no_progress' when tried >= 60 then 'max_attempts' end reason FROM c)
SELECT job_id, seq, reason IS NULL dispatched, reason, case when reason IS NULL then 'queued' when stop then 'stopped' else 'partial' end next_status, cast(tried + cast(reason IS NULL as int) as int) attempts FROM d""")
def job_rounds(t):
    """Decisions at the end of every round, from logs whose rows come out of order and partly twice."""
    log = t.raw("events").selectExpr("user_id job_id", "row_number() over (partition by user_id order by ts, event_id) - 1 seq", f"{KIND} kind", f"{DONE} value")
    log = log.withColumn("seq", F.col("seq").cast("long"))
    twice = log.unionByName(log.where("seq % 7 = 3")).withColumn("part", F.pmod(F.xxhash64("job_id", "seq"), F.lit(3)))
    log_at = scratch(t, "log")
    twice.write.parquet(log_at)
    return replayed(t, [t.spark.read.parquet(log_at).where(F.col("part") == k).drop("part") for k in range(3)], jobs.rounds, "rounds")


@query("SELECT event_type, count(*) n, count(\"value\") valued, (SELECT count(*) FROM events e WHERE e.event_type = events.event_type AND e.event_id % 3 = 0) thirds FROM events GROUP BY event_type")
def ordered_commit(t):
    """The events taken into three tables at once, batch by batch, and what is committed of each."""
    folder, events = scratch(t, "ordered"), t.raw("events").repartitionByRange(3, "ts")
    events.write.parquet(f"{folder}/in")
    sinks = [("all", lambda df: df.select("event_type", "event_id")), ("valued", lambda df: df.where("value is not null").select("event_type", "value")), ("thirds", lambda df: df.where("event_id % 3 = 0").select("event_type"))]
    ingest.run_ordered(t.spark, f"{folder}/in", events.schema, f"{folder}/out", f"{folder}/state", sinks)
    counts = [ingest.committed(t.spark, f"{folder}/out", name).groupBy("event_type").agg(F.count("*").alias(n)) for name, n in (("all", "n"), ("valued", "valued"), ("thirds", "thirds"))]
    return counts[0].join(counts[1], "event_type", "left").join(counts[2], "event_type", "left").na.fill(0)

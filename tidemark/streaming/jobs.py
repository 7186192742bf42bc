"""Jobs watched as streams with state: stalls told once, and rounds that go on by themselves.

Both have a batch form over a table of the same rows. What a stream tells hangs on the
rows only, not on the batches in which they come, nor on repeated or early ones.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.reports import MOST_ATTEMPTS, STALE_MINUTES

ACTIVE = ("queued", "running")
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """Timers and several kinds of state need the store that keeps them on disk."""
    spark.conf.set(_STORE, _ROCKS)


class StallWatch(StatefulProcessor):
    """By the machine's clock. State of a job: its last news. Each piece of news has a timer; when
    it is due and nothing newer came until then, the job is told as stalled."""

    OUT = "job_id long, status string, quiet_us long"

    def __init__(self, quiet_ms: int) -> None:
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.news = handle.getMapState("news", "at long", "us long, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at = timerValues.getCurrentProcessingTimeInMs()
        last = max((at * 1000, r.status) for r in rows)
        if self.news.containsKey((at,)):
            last = max(last, tuple(self.news.getValue((at,))))
        else:
            self.handle.registerTimer(at + self.quiet)
        self.news.updateValue((at,), last)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs() - self.quiet
        us, status = self.news.getValue((at,))
        newer = any(at < k[0] <= at + self.quiet for k in self.news.keys())  # noqa: SIM118  a state's keys
        self.news.removeKey((at,))
        return iter(() if newer or status not in ACTIVE else [Row(job_id=key[0], status=status, quiet_us=us)])

    def close(self) -> None:
        pass


def stalls(news: DataFrame, quiet_ms: int = STALE_MINUTES * 60_000, late: str = "10 minutes", by_event_time: bool = True) -> DataFrame:
    """job_id, status, quiet_since: a row each time a job that is queued or running has no
    news for longer than ``quiet_ms``, once for each such time. ``news`` is a stream of
    job_id, status, updated_at; of news of one millisecond the last counts (ties: by status).
    By event time a stall is known when the watermark has passed it and news may come
    ``late``; otherwise news counts when it comes, by the machine's clock."""
    with_state(news.sparkSession)
    told = news.select("job_id", F.coalesce("status", F.lit("")).alias("status"), "updated_at")
    if by_event_time:
        return _stalls_by_event_time(told.where("updated_at is not null"), quiet_ms, late)
    told = told.withColumn("us", F.unix_micros("updated_at"))
    found = told.groupBy("job_id").transformWithState(StallWatch(quiet_ms), StallWatch.OUT, "Append", "ProcessingTime")
    return found.select("job_id", "status", F.timestamp_micros("quiet_us").alias("quiet_since"))


def _stalls_by_event_time(told: DataFrame, quiet_ms: int, late: str) -> DataFrame:
    """News of a job that follow each other within ``quiet_ms`` are one session, and every session
    ends with a silence: the state holds a row a session, whatever the number of news in it."""
    timed = told.withColumn("at", F.timestamp_millis(F.unix_millis("updated_at"))).withWatermark("at", late)
    # a microsecond more: news that comes just when the time is over still counts
    session = F.session_window("at", f"{quiet_ms * 1000 + 1} microseconds").alias("session")
    last = timed.groupBy("job_id", session).agg(F.max(F.struct("updated_at", "status")).alias("last"))
    return last.where(F.col("last.status").isin(*ACTIVE)).select(F.col("job_id").cast("long").alias("job_id"), "last.status", F.col("last.updated_at").alias("quiet_since"))


def stalls_so_far(news: DataFrame, quiet_ms: int = STALE_MINUTES * 60_000, late_ms: int = 600_000) -> DataFrame:
    """What ``stalls`` has told by event time when a stream of this table's rows is at its end."""
    last = F.broadcast(news.agg((F.unix_millis(F.max("updated_at")) - late_ms).alias("mark")))  # a row
    one = news.where("updated_at is not null").withColumn("at", F.unix_millis("updated_at")).groupBy("job_id", "at")
    one = one.agg(F.max(F.struct("updated_at", F.coalesce("status", F.lit("")).alias("status"))).alias("last"))
    after = F.lead("at").over(Window.partitionBy("job_id").orderBy("at"))
    due = F.col("at") + quiet_ms
    quiet = one.withColumn("next", after).join(last).where(F.coalesce(F.col("next") > due, F.lit(True)) & (due < F.col("mark")))
    return quiet.where(F.col("last.status").isin(*ACTIVE)).select("job_id", "last.status", F.col("last.updated_at").alias("quiet_since"))


#: What a job's log holds: 'start' (by hand), 'progress' (value photos done in this round), 'stop' (asked for), 'end' (of a round).
KINDS = ("start", "progress", "stop", "end")


def fold(state: tuple, kind: str, value: int | None) -> tuple[tuple, tuple | None]:
    """(next state, decision) of one log row. State: done, attempts, stop. A decision is
    (dispatched, reason, next_status, attempts)."""
    done, attempts, stop = state
    if kind == "start":
        return (0, 0, False), None
    if kind == "progress":
        return (done if value is None else value, attempts, stop), None
    if kind == "stop":
        return (done, attempts, True), None
    if kind != "end":
        return state, None
    reason = "stop_requested" if stop else "no_progress" if not done else "max_attempts" if attempts >= MOST_ATTEMPTS else None
    attempts += reason is None
    status = {None: "queued", "stop_requested": "stopped"}.get(reason, "partial")
    return (0, attempts, stop), (reason is None, reason, status, attempts)


#: Row numbers whose early rows share one entry of the state.
STRETCH = 1024


class Rounds(StatefulProcessor):
    """State of a job: how far its log is read, what it says so far, and rows that came before
    their turn, by stretches of row numbers: an entry is read and written once a batch at most."""

    OUT = "job_id long, seq long, dispatched boolean, reason string, next_status string, attempts int"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "next long, done long, attempts int, stop boolean, waiting long")
        self.early = handle.getMapState("early", "stretch long", "seqs array<long>, kinds array<string>, vals array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, *state, waiting = self.known.get() or (0, 0, 0, False, 0)
        state, out, held, stored = tuple(state), [], {}, set()

        def opened(stretch: int) -> dict[int, tuple]:
            if stretch not in held:
                held[stretch] = {}
                if waiting and self.early.containsKey((stretch,)):
                    stored.add(stretch)
                    seqs, kinds, values = self.early.getValue((stretch,))
                    held[stretch] = {q: (k, v) for q, k, v in zip(seqs, kinds, values, strict=True)}
            return held[stretch]

        for r in rows:
            if r.seq >= at:
                opened(r.seq // STRETCH)[r.seq] = (r.kind, r.value)
        while at in opened(at // STRETCH):
            state, decision = fold(state, *held[at // STRETCH].pop(at))
            if decision:
                out.append(Row(job_id=key[0], seq=at, dispatched=decision[0], reason=decision[1], next_status=decision[2], attempts=decision[3]))
            at += 1
        for stretch, early in held.items():
            if early:
                self.early.updateValue((stretch,), (list(early), *(list(c) for c in zip(*early.values(), strict=True))))
            elif stretch in stored:
                self.early.removeKey((stretch,))
        left = sum(bool(early) for early in held.values()) - len(stored)
        self.known.update((at, *state, waiting + left))
        return iter(out)

    def close(self) -> None:
        pass


def rounds(log: DataFrame) -> DataFrame:
    """Rounds.OUT, a row for each round that ended: whether the job goes on by itself, and
    why not. ``log`` is a stream of job_id, seq, kind, value; seq counts a job's rows from
    0. Rows are taken in that order however they come: an early one waits in the state, a
    repeated one changes nothing."""
    with_state(log.sparkSession)
    plain = log.select(F.col("job_id").cast("long"), F.col("seq").cast("long"), "kind", F.col("value").cast("long"))
    return plain.where("seq >= 0").groupBy("job_id").transformWithState(Rounds(), Rounds.OUT, "Append", "None")


def rounds_so_far(log: DataFrame) -> DataFrame:
    """What ``rounds`` has told when all rows of this table have come, by windows."""
    once = log.where("seq >= 0").groupBy("job_id", "seq").agg(F.min("kind").alias("kind"), F.min("value").alias("value"))
    of = Window.partitionBy("job_id").orderBy("seq")
    before = of.rowsBetween(Window.unboundedPreceding, -1)
    read = once.withColumn("place", F.row_number().over(of) - 1).where("place = seq")  # up to the first gap
    is_ = lambda k: F.col("kind") == k
    read = read.withColumn("life", F.sum(is_("start").cast("int")).over(of)).withColumn("round", F.coalesce(F.sum(is_("end").cast("int")).over(before), F.lit(0)))
    life = Window.partitionBy("job_id", "life").orderBy("seq")
    this = Window.partitionBy("job_id", "life", "round").orderBy("seq")
    read = read.withColumn("stop", F.max(is_("stop")).over(life)).withColumn("done", F.coalesce(F.last(F.when(is_("progress"), F.col("value")), ignorenulls=True).over(this), F.lit(0)))
    ended = read.where(is_("end")).withColumn("good", (~F.col("stop") & (F.col("done") != 0)).cast("int"))
    # attempts only grow while none is refused for their number
    tried = F.least(F.coalesce(F.sum("good").over(life.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(MOST_ATTEMPTS))
    told = ended.withColumn("tried", tried)
    reason = F.when(F.col("stop"), "stop_requested").when(F.col("done") == 0, "no_progress").when(F.col("tried") >= MOST_ATTEMPTS, "max_attempts")
    status = F.when(reason.isNull(), "queued").when(reason == "stop_requested", "stopped").otherwise("partial")
    return told.select("job_id", "seq", reason.isNull().alias("dispatched"), reason.alias("reason"), status.alias("next_status"), (F.col("tried") + reason.isNull().cast("int")).cast("int").alias("attempts"))


def drained(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Runs a stream over all there is, adding its rows to the Parquet table ``target``."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

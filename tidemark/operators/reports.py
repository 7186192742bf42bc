"""Coverage, quality and progress reports; tables as in ``search``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..session import cut

# Fixed values.
STALE_MINUTES, MOST_ATTEMPTS = 20, 60
#: Keys of a sample up to which their list is broadcast.
MOST_SAMPLE = 100_000


def _counts(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def coverage(sources: DataFrame, photos: DataFrame, faces: DataFrame, bibs: DataFrame) -> DataFrame:
    """source_id, photos, no_face, no_bib."""
    has = lambda df, name: df.select("photo_id").distinct().withColumn(name, F.lit(1))
    told = photos.select("photo_id", "source_id").join(has(faces, "face"), "photo_id", "left").join(has(bibs, "number"), "photo_id", "left")
    per = told.groupBy("source_id").agg(F.count("*").alias("photos"), F.count("face").alias("faces"), F.count("number").alias("numbers"))
    joined = sources.select("source_id").join(per, "source_id", "left")
    less = lambda part: F.greatest(F.lit(0), F.coalesce(F.col("photos") - F.col(part), F.lit(0)))
    return joined.select("source_id", _count("photos"), less("faces").alias("no_face"), less("numbers").alias("no_bib"))


def quality(photos: DataFrame, faces: DataFrame, bibs: DataFrame) -> DataFrame:
    """One row: photos, faces, bib_rows, with_face, with_bib, no_face, no_bib."""
    own = photos.select("photo_id")
    on = lambda df: df.join(own, "photo_id", "left_semi")
    one = own.agg(F.count("*").alias("photos"))
    f = on(faces).agg(F.count("*").alias("faces"), F.count_distinct("photo_id").alias("with_face"))
    b = on(bibs).agg(F.count("*").alias("bib_rows"), F.count_distinct("photo_id").alias("with_bib"))
    rows = one.join(F.broadcast(f)).join(F.broadcast(b))  # a row each
    return rows.withColumn("no_face", F.col("photos") - F.col("with_face")).withColumn("no_bib", F.col("photos") - F.col("with_bib"))


def log_summary(log: DataFrame, most: int = 40) -> DataFrame:
    return log.groupBy("level", "code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level", "code").limit(most)


def top_bibs(bibs: DataFrame, most: int = 12) -> DataFrame:
    """bib, label (as on its first photo), photos."""
    per = bibs.groupBy("bib").agg(F.min_by("label", F.struct("photo_id", "label")).alias("label"), F.count("*").alias("photos"))
    return per.orderBy(F.desc("photos"), "bib").limit(most)


def owner_stats(events: DataFrame) -> DataFrame:
    published = F.sum(F.when(F.col("status").isin("ready", "partial"), 1).otherwise(0))
    return (
        events.where("owner_email is not null")
        .groupBy(F.lower("owner_email").alias("email"))
        .agg(F.count("*").alias("events"), F.coalesce(F.sum("photo_count"), F.lit(0)).alias("photos"), published.alias("published"), F.max("event_id").alias("last_event"))
    )


def roster(organizers: DataFrame, events: DataFrame, own_email: str) -> DataFrame:
    """Organizers and event owners together, without oneself."""
    joined = organizers.join(owner_stats(events), "email", "full").where(F.col("email") != own_email)
    return joined.select("email", "added_at", "banned_at", _count("events"), _count("photos"), _count("published"), "last_event")


def shortfall(sources: DataFrame, photos: DataFrame) -> DataFrame:
    """Live sources with fewer photos than were found; nothing found means unknown."""
    joined = sources.where("not removed and discovered > 0").join(_counts(photos, "source_id", "photos"), "source_id", "left")
    return joined.select("event_id", "source_id", "discovered", _count("photos")).where("discovered > photos")


def totals(sources: DataFrame, photos: DataFrame) -> DataFrame:
    """Per event: live sources, discovered (null unless known for every one), photos, complete."""
    joined = sources.where("not removed").join(_counts(photos, "source_id", "photos"), "source_id", "left")
    known = F.every(F.col("discovered") > 0)
    per = joined.groupBy("event_id").agg(
        F.count("*").alias("sources"),
        F.when(known, F.sum("discovered")).alias("discovered"),
        F.coalesce(F.sum("photos"), F.lit(0)).alias("photos"),
        F.every((F.col("discovered") > 0) & (F.coalesce("photos", F.lit(0)) >= F.col("discovered"))).alias("complete"),
    )
    return per


def box_audit(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """Per event, from photos (photo_id, event_id, width, height) and faces
    (photo_id, bbox as JSON): how far boxes reach."""
    box = faces.select("photo_id", geometry.parse_box(F.col("bbox")).alias("b"))
    reach = box.select("photo_id", (F.col("b.x") + F.col("b.w")).alias("right"), (F.col("b.y") + F.col("b.h")).alias("bottom"))
    per = reach.groupBy("photo_id").agg(F.count("*").alias("faces"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))
    known = (F.col("width") > 0) & (F.col("height") > 0)
    edge = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.greatest("width", "height"))
    over = lambda part: known & ((F.col("right") > F.col("width") + edge * part) | (F.col("bottom") > F.col("height") + edge * part))
    large = (F.col("faces") >= 5) & (edge > 4000)
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return (
        photos.join(per, "photo_id")
        .groupBy("event_id")
        .agg(
            F.count("*").alias("photos_with_faces"),
            yes(over(0.25)).alias("overflowing"),
            yes(over(0.02)).alias("edge_faces"),
            yes(~F.coalesce(known, F.lit(False))).alias("unmeasurable"),
            F.round(F.avg(F.when(large, F.col("right") / F.col("width"))), 3).alias("reach_big_frames"),
            yes(large).alias("big_frames"),
        )
    )


def usage_share(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, total, mean, largest, share (percent of all, one decimal)."""
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("largest"))
    whole = per.agg(F.sum("total").alias("whole"))
    joined = per.join(F.broadcast(whole))  # one row
    return joined.withColumn("share", F.round(100 * F.col("total") / F.col("whole"), 1)).drop("whole")


def systematic_sample(df: DataFrame, rows: int, k: int, key: str) -> DataFrame:
    """Every (rows // k)-th row in key order, k at most. Only keys are dealt into
    ranges and counted; the ranges are stored, so that counting and placing see the
    same ones whatever is re-planned in between. Rows come by their keys, of which
    k at most are chosen; of rows that share a key any may stand for another."""
    step = max(1, rows // k)
    dealt = cut(df.select(key).repartitionByRange(key).withColumn("range_", F.spark_partition_id()))
    sizes = dealt.groupBy("range_").agg(F.count("*").alias("n_"))  # a row per partition
    before = F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("range_", before.alias("before_"))
    placed = dealt.join(F.broadcast(starts), "range_").withColumn("place_", F.col("before_") + F.row_number().over(Window.partitionBy("range_").orderBy(key)) - 1)
    chosen = placed.where(f"place_ % {step} = 0 and place_ < {step * k}").groupBy(F.col(key).alias("key_")).agg(F.count("*").alias("times_"))
    hit = df.join(F.broadcast(chosen) if k <= MOST_SAMPLE else chosen, F.col(key).eqNullSafe(F.col("key_")))
    nth = F.row_number().over(Window.partitionBy("key_").orderBy("key_"))
    return hit.withColumn("nth_", nth).where("nth_ <= times_").drop("nth_", "times_", "key_")


def compare_modes(results: DataFrame) -> DataFrame:
    """mode, photos, bytes, faces, distinct_bibs, mb_each from (mode, photo_id, bytes, faces, bib)."""
    per = results.groupBy("mode").agg(
        F.count_distinct("photo_id").alias("photos"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("faces"), F.lit(0)).alias("faces"),
        F.count_distinct("bib").alias("distinct_bibs"),
    )
    return per.withColumn("kb_each", F.round(F.col("bytes") / F.col("photos") / 1000, 1))


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def stale(jobs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Jobs with a flag: active, and without news for so long."""
    active = F.col("status").isin("queued", "running")
    return jobs.withColumn("stalled", active & (F.col("updated_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")))


def continuation(jobs: DataFrame) -> DataFrame:
    """Whether a job that ended early goes on by itself: job_id, dispatched, reason, next_status, attempts."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    reason = F.when(n("stop_requested") == 1, "stop_requested").when(n("done") == 0, "no_progress").when(n("attempts") >= MOST_ATTEMPTS, "max_attempts")
    goes = reason.isNull()
    status = F.when(goes, "queued").when(reason == "stop_requested", "stopped").otherwise("partial")
    return jobs.select("job_id", goes.alias("dispatched"), reason.alias("reason"), status.alias("next_status"), (n("attempts") + goes.cast("int")).alias("attempts"))


def latest(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last row's columns for each key, ties by all columns."""
    last = F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("last")
    return df.groupBy(key).agg(last).select(key, "last.*")

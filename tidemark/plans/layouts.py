"""Queries of bucketed changes, sorted pages, wide suppression and the read chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import boxes, layout, mutations, tokens
from ..streaming import ingest
from .queries import BOTH, BOXES, GREEDY, REJOIN, TOKEN, scored_boxes
from .registered import query
from .streams import scratch
from .tables import Tables

C = F.col


def photo_table(t: Tables) -> DataFrame:
    return t.photos.selectExpr("event_id", "photo_id", "concat('t', photo_id) thumb", "width")


@query("""SELECT event_id, photo_id, if(new, concat('n', photo_id), concat('t', photo_id)) thumb, if(new AND photo_id % 2 = 0, 77, if(fresh, null, width)) width FROM (
SELECT event_id, photo_id, width, photo_id BETWEEN 1000 AND 1999 new, false fresh FROM ph UNION ALL SELECT event_id, -photo_id, null, true, true FROM ph WHERE photo_id BETWEEN 1000 AND 1100)""")
def bucket_change(t):
    """Photos 1,000 to 1,999 sent again and a few new ones, put into a table of 64 buckets."""
    table = layout.Buckets(t.spark, scratch(t, "buckets"), lambda: F.struct("event_id", F.floor(C("photo_id") / 4096)), 64)
    table.write(photo_table(t))
    again = t.photos.where("photo_id between 1000 and 1999").selectExpr("event_id", "photo_id", "concat('n', photo_id) thumb", "if(photo_id % 2 = 0, 77, null) width")
    fresh = t.photos.where("photo_id between 1000 and 1100").selectExpr("event_id", "-photo_id photo_id", "concat('n', -photo_id) thumb", "if(photo_id % 2 = 0, 77, null) width")
    rules = {"thumb": mutations.take_new, "width": mutations.new_or_old}
    for _ in range(2):  # a repeated change changes nothing
        table.change(again.unionByName(fresh), lambda old, new: layout.upsert_few(old, new, ["event_id", "photo_id"], rules))
    return table.read()


@query("""SELECT n page, photo_id, taken FROM (SELECT photo_id, taken, row_number() OVER (ORDER BY taken NULLS FIRST, photo_id) - 1 k FROM ph), (VALUES (0), (1), (2)) v(n) WHERE k // 60 = n""")
def sorted_pages(t):
    """Three pages of 60 photos by time and id, each after the last row of the one before."""
    pages, out, after = layout.Pages(t.spark, scratch(t, "pages"), ["taken", "photo_id"]), [], None
    pages.write(t.photos.select("taken", "photo_id"), 16)
    for n in range(3):
        rows = pages.page(60, after).collect()  # a page
        out += [(n, r.photo_id, r.taken) for r in rows]
        after = rows[-1].asDict() if rows else after
    return t.spark.createDataFrame(out, "page int, photo_id long, taken timestamp_ntz")


@query(BOXES + GREEDY.format(order="score DESC, box_id", free="", both=BOTH))
def nms_wide(t):
    """Suppression without a photo in one task; the same rows as ``nms``."""
    return boxes.suppress_wide(scored_boxes(t), "photo_id")


PADDED = f"SELECT * REPLACE (if(regexp_matches(text, '^[0-9]+$'), lpad(text, 4, '0'), text) AS text) FROM ({TOKEN.format(s='varchar', t='lineitem')})"
CHAIN = f""", tk AS ({PADDED}){REJOIN}, ac AS (SELECT crop_id, replace(trim(text), ' ', '') raw, conf FROM rj WHERE x2 - x1 >= 0.01 * 2000 AND conf >= 0.7 AND regexp_matches(replace(trim(text), ' ', ''), '(?i)^(?:(?:A|N)[-\\s]?)?[0-9]{{2,4}}$')),
nm AS (SELECT crop_id, upper(regexp_extract(raw, '^[A-Za-z]*')) l, cast(cast(regexp_extract(raw, '[0-9]+$') as int) as varchar) d, conf, raw FROM ac), hit AS (SELECT crop_id, if(l = '', d, concat(l, '-', d)) bib, d, l, conf, raw FROM nm),
pr AS (SELECT crop_id, bib, conf, raw FROM hit WHERE l <> '' OR NOT EXISTS (SELECT 1 FROM hit p WHERE p.crop_id = hit.crop_id AND p.l <> '' AND p.d = hit.d))"""


def chain(t: Tables) -> DataFrame:
    lines = t.raw("lineitem")
    shown = t.spark.sql(TOKEN.format(s="string", t="{lines}"), lines=lines)
    padded = shown.withColumn("text", F.when(C("text").rlike("^[0-9]+$"), F.lpad("text", 4, "0")).otherwise(C("text"))).withColumn("frame_width", F.lit(2000))
    return tokens.read_crops(padded, 2, ["A", "N"], 4)


@query(f"{CHAIN} SELECT * FROM pr")
def read_chain(t):
    """Tokens to stored numbers: rejoined, accepted, normalised, the prefixed preferred."""
    return chain(t)


@query(f"{CHAIN} SELECT crop_id, bib, conf FROM pr QUALIFY row_number() OVER (PARTITION BY crop_id ORDER BY conf DESC, bib) = 1")
def crop_read(t):
    """The surest number of every crop."""
    return tokens.surest_read(chain(t)).select("crop_id", "bib", "conf")


@query("""SELECT email, added_by FROM (SELECT concat('owner', s_suppkey, '@example.org') email, 'ops' added_by FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL
SELECT DISTINCT concat('owner', s_suppkey % 8, '@example.org'), 'event' FROM supplier WHERE s_suppkey % 8 NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0))""")
def people_ignored(t):
    """Owners added where they are not known yet; known ones stay as they are."""
    known = t.raw("supplier").where("s_suppkey % 2 = 0").selectExpr("concat('owner', s_suppkey, '@example.org') email", "'ops' added_by")
    rows = t.raw("supplier").selectExpr("concat('owner', s_suppkey % 8, '@example.org') email", "'event' added_by", "s_suppkey seq")
    return mutations.insert_ignore(known, rows, ["email"])


@query("SELECT n, least(1.0, greatest(0.2, v)) threshold, (SELECT count(*) FROM part WHERE p_partkey % 1000 / 1000.0 >= least(1.0, greatest(0.2, v))) parts FROM (VALUES (0, 0.38), (1, 0.0), (2, 0.38), (3, 0.5), (4, 7.0), (5, -1.0)) x(n, v)")
def clamped_thresholds(t):
    """Thresholds as asked for, brought into their bounds, and what passes them."""
    asked = [None, "", "much", "0.5", "7", -1]
    bounds = t.spark.createDataFrame([(n, vectors.clamp_threshold(a)) for n, a in enumerate(asked)], "n int, threshold double")
    per = t.raw("part").select((C("p_partkey") % 1000 / 1000.0).alias("score"))
    return bounds.join(per, C("score") >= C("threshold"), "left").groupBy("n", "threshold").agg(F.count("score").alias("parts"))


@query("SELECT 'stopped' outcome, (SELECT count(*) FROM events) n UNION ALL SELECT 'time', (SELECT count(*) FROM events)")
def stopped_and_resumed(t):
    """An intake that is stopped, one that runs out of time after its first batch, and what both have when run again."""
    out = []
    for outcome, stop, deadline in (("stopped", lambda: True, None), ("time", lambda: False, 0.0)):
        folder, rows = scratch(t, "stops"), t.raw("events").select("event_id").repartition(3)
        rows.write.parquet(f"{folder}/in")
        args = (t.spark, f"{folder}/in", rows.schema, f"{folder}/out", f"{folder}/state")
        if ingest.run_stream(*args, stop=stop, deadline=deadline) not in (outcome, "done"):
            raise RuntimeError("the run did not end as it was told to")
        ingest.run_stream(*args)
        out.append(ingest.committed(t.spark, f"{folder}/out").agg(F.lit(outcome).alias("outcome"), F.count("*").alias("n")))
    return out[0].unionByName(out[1])

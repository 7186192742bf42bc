"""Queries of directories, row numbers, rules and folders over rows of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mutations
from ..sources import folders, shards
from .registered import query
from .tables import Tables

C = F.col

#: A shard for every source of an event in order of its id, with one row a photo; each event's place of the next one.
SHARDS = """, per AS (SELECT event_id, source_id, count(*) row_count FROM ph GROUP BY 1, 2),
dr AS (SELECT event_id, concat('s', source_id) shard_key, cast(sum(row_count) OVER (PARTITION BY event_id ORDER BY source_id) - row_count as bigint) row_base, row_count FROM per)"""


def source_shards(t: Tables) -> DataFrame:
    per = t.photos.groupBy("event_id", "source_id").agg(F.count("*").alias("row_count"))
    base = F.expr("sum(row_count) over (partition by event_id order by source_id) - row_count")
    return per.select("event_id", F.concat(F.lit("s"), "source_id").alias("shard_key"), base.alias("row_base"), "row_count")


@query(f"""{SHARDS} SELECT event_id, count(*) shards, cast(sum(row_count) as bigint) row_count, if(event_id % 4 = 3 AND count(*) > 0 AND bool_or(row_base > 0), 'not_contiguous', 'ok') state FROM dr GROUP BY event_id""")
def source_contiguity(t):
    """Shards of all sources; those of every fourth event begin a row late but for the first."""
    late = F.when((C("event_id") % 4 == 3) & (C("row_base") > 0), C("row_base") + 1).otherwise(C("row_base"))
    return mutations.contiguity(source_shards(t).withColumn("row_base", late))


@query(f"""{SHARDS} SELECT event_id, shard_key, o AS "offset", least(4096, row_count * 512 - o) length FROM dr, lateral (SELECT unnest(range(0, row_count * 512, 4096)) o)""")
def source_segments(t):
    """Reads of at most 4,096 bytes of every source's shard."""
    return shards.segment_plan(source_shards(t), 512, 4096)


@query(f"""{SHARDS}, req AS (SELECT event_id, concat(if(source_id % 3 > 0, 's', 'n'), source_id) shard_key, row_count + if(source_id % 2 = 0, 2, 0) row_count, source_id seq FROM per),
j AS (SELECT req.*, d.row_base old_base, coalesce(d.row_count >= req.row_count, false) reused, t.top FROM req LEFT JOIN dr d USING (event_id, shard_key) LEFT JOIN (SELECT event_id, max(row_base + row_count) top FROM dr GROUP BY 1) t USING (event_id))
SELECT event_id, shard_key, cast(if(reused, old_base, coalesce(top, 0) + coalesce(sum(if(reused, 0, row_count)) OVER (PARTITION BY event_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) as bigint) row_base, row_count, reused FROM j""")
def source_rows(t):
    """Row numbers asked for again by every source, a third under a new key, half with two rows more."""
    per = t.photos.groupBy("event_id", "source_id").agg(F.count("*").alias("row_count"))
    asked = per.selectExpr("event_id", "concat(if(source_id % 3 > 0, 's', 'n'), source_id) shard_key", "row_count + if(source_id % 2 = 0, 2, 0) row_count", "source_id seq")
    return mutations.allocate(source_shards(t), asked)


@query(f"""{SHARDS}, n AS (SELECT event_id, concat(if(source_id % 2 = 0, 's', 't'), source_id) shard_key, source_id * 100 + 2 b, source_id + 2 c FROM per WHERE source_id % 5 = 0)
SELECT event_id, shard_key, cast(coalesce(b, row_base) as bigint) row_base, cast(coalesce(c, row_count) as bigint) row_count FROM dr FULL JOIN n USING (event_id, shard_key)""")
def source_directory(t):
    """The directory after every fifth source has sent its shard's row twice, half under a new key."""
    own = t.photos.where("source_id % 5 = 0").select("event_id", "source_id").distinct()
    delta = own.selectExpr("event_id", "concat(if(source_id % 2 = 0, 's', 't'), source_id) shard_key", "source_id", "explode(array(1, 2)) seq")
    return mutations.write_directory(source_shards(t), delta.selectExpr("event_id", "shard_key", "source_id * 100 + seq row_base", "source_id + seq row_count", "seq"))


FACE_ROWS = "SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY photo_id, part, x, y, w) - 1 row_idx, concat('p', photo_id) owner FROM fc JOIN ph USING (photo_id)"


@query(f""", f AS ({FACE_ROWS}) SELECT event_id, row_idx, if(event_id = 4 AND row_idx BETWEEN 5 AND 24, 'new', owner) AS "owner" FROM f""")
def face_range(t):
    """The faces of an event with rows 5 to 24 written anew, twice over."""
    box = F.expr("from_json(bbox, 'array<int>')")
    own = t.faces.withColumn("b", box).join(t.photos.select("photo_id", "event_id"), "photo_id")
    rows = own.selectExpr("event_id", "cast(row_number() over (partition by event_id order by photo_id, part, b[0], b[1], b[2]) - 1 as bigint) row_idx", "concat('p', photo_id) owner")
    new = rows.where("event_id = 4 and row_idx < 40").withColumn("owner", F.lit("new"))
    once = mutations.write_faces(rows, new, 4, 5, 20)
    return mutations.write_faces(once, new, 4, 5, 20)


@query("SELECT source_id event_id, source_id % 3 = 1 bibs_enabled, if(source_id % 2 = 0, 3, 2) bib_min_digits, if(source_id % 7 = 0, 4, 5) bib_max_digits, if(source_id % 4 = 1, segment, '') bib_prefixes, coalesce(removed AND source_id % 2 = 0, false) bib_prefix_required FROM sr")
def source_rules(t):
    """Every source's rule with the defaults for what it does not say."""
    rows = t.sources.selectExpr("source_id event_id", "if(source_id % 3 = 1, true, null) bibs_enabled", "if(source_id % 2 = 0, null, 2) bib_min_digits", "if(source_id % 7 = 0, 4, null) bib_max_digits", "if(source_id % 4 = 1, segment, null) bib_prefixes", "if(source_id % 2 = 0, removed, null) bib_prefix_required")
    return shards.event_rules(rows)


@query("""SELECT cast(n as varchar) folder, cast(min(d) as bigint) depth FROM (WITH RECURSIVE
e AS (SELECT p_partkey c, if(p_partkey % 7 < 5, p_partkey - 1, p_partkey // 2) p FROM part UNION ALL SELECT p_partkey, p_partkey - 13 FROM part WHERE p_partkey % 29 = 0),
w(n, d) AS (SELECT 0, 0 UNION SELECT e.c, w.d + 1 FROM w JOIN e ON e.p = w.n WHERE e.p <> e.c) SELECT * FROM w) GROUP BY 1""")
def folder_depths(t):
    """Depths of folders that hang in short chains below one another, some with two parents."""
    one = t.raw("part").selectExpr("cast(if(p_partkey % 7 < 5, p_partkey - 1, p_partkey div 2) as string) parent", "cast(p_partkey as string) child")
    two = t.raw("part").where("p_partkey % 29 = 0").selectExpr("cast(p_partkey - 13 as string) parent", "cast(p_partkey as string) child")
    return folders.walk_doubling(one.unionByName(two), "0")[0]

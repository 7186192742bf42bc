"""The operators' tables, made of the star schema: nations are events, customers
sources, orders photos, order lines faces and numbers. ``VIEWS`` says the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parts_for(df: DataFrame, rows: int = 1 << 18) -> int:
    """Partitions of at most about ``rows`` rows, so that a task's memory does not grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "cast(n_nationkey as bigint) event_id",
            "n_name name",
            "element_at(array('ready','partial','draft','processing'), n_nationkey % 4 + 1) status",
            "case when n_regionkey > 0 then concat('Owner', n_regionkey, '@Example.org') end owner_email",
            "cast(n_nationkey * 10 as bigint) photo_count",
            "case when n_nationkey % 3 > 0 then concat('2024-0', n_nationkey % 9 + 1, '-11') end event_date",
            "concat('2023-0', n_nationkey % 7 + 1, '-02T00:00:00Z') created_at",
        )

    @property
    def sources(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey source_id", "cast(c_nationkey as bigint) event_id", "c_name name", "c_acctbal < 0 removed", "c_custkey % 25 discovered", "c_mktsegment segment"
        )

    @property
    def photos(self) -> DataFrame:
        own = self.raw("orders").selectExpr(
            "o_orderkey photo_id",
            "o_custkey source_id",
            "case when o_orderkey % 50 > 0 then cast(2000 + o_orderkey % 5000 as int) end width",
            "cast(1500 + o_orderkey % 3000 as int) height",
            "o_orderstatus = 'F' faces_done",
            "o_orderdate taken",
        )
        return own.join(self.raw("customer").selectExpr("c_custkey source_id", "cast(c_nationkey as bigint) event_id"), "source_id")

    @property
    def bib_parts(self) -> int:
        return parts_for(self.raw("lineitem"))

    @property
    def bibs(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .selectExpr("l_orderkey photo_id", "concat(l_returnflag, '-', l_partkey % 400) bib", "1 - l_discount conf", "concat(l_returnflag, ' ', lpad(l_partkey % 400, 4, '0')) bib_raw", "case when l_linestatus = 'F' then 'ocr' else 'manual' end source")
            .repartition(self.bib_parts, "photo_id", "bib")
            .groupBy("photo_id", "bib")
            .agg(F.max("conf").alias("conf"), F.min("bib_raw").alias("bib_raw"), F.min("source").alias("source"))
        )

    @property
    def faces(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey photo_id",
            "l_suppkey supplier",
            "l_partkey part",
            "concat('[', l_partkey * 7 % 4000, ',', l_suppkey * 13 % 3000, ',', 20 + cast(l_quantity as int) * 9, ',', 30 + cast(l_quantity as int) * 11, ']') bbox",
        )

    @property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings")


VIEWS = """WITH ev AS (SELECT cast(n_nationkey as bigint) event_id, n_name AS name,
  (['ready','partial','draft','processing'])[n_nationkey % 4 + 1] status,
  case when n_regionkey > 0 then concat('Owner', n_regionkey, '@Example.org') end owner_email,
  cast(n_nationkey * 10 as bigint) photo_count,
  case when n_nationkey % 3 > 0 then concat('2024-0', n_nationkey % 9 + 1, '-11') end event_date,
  concat('2023-0', n_nationkey % 7 + 1, '-02T00:00:00Z') created_at FROM nation),
sr AS (SELECT c_custkey source_id, cast(c_nationkey as bigint) event_id, c_name AS name, c_acctbal < 0 removed,
  c_custkey % 25 discovered, c_mktsegment segment FROM customer),
ph AS (SELECT o_custkey source_id, o_orderkey photo_id,
  case when o_orderkey % 50 > 0 then cast(2000 + o_orderkey % 5000 as int) end width,
  cast(1500 + o_orderkey % 3000 as int) height, o_orderstatus = 'F' faces_done, o_orderdate taken,
  cast(c_nationkey as bigint) event_id FROM orders JOIN customer ON o_custkey = c_custkey),
bb AS (SELECT photo_id, bib, max(conf) conf, min(bib_raw) bib_raw, min(source) source FROM (
  SELECT l_orderkey photo_id, concat(l_returnflag, '-', l_partkey % 400) bib, 1 - l_discount conf,
  concat(l_returnflag, ' ', lpad(cast(l_partkey % 400 as varchar), 4, '0')) bib_raw,
  case when l_linestatus = 'F' then 'ocr' else 'manual' end source FROM lineitem) GROUP BY ALL),
fc AS (SELECT l_orderkey photo_id, l_suppkey supplier, l_partkey part, l_partkey * 7 % 4000 x, l_suppkey * 13 % 3000 y,
  20 + cast(l_quantity as int) * 9 w, 30 + cast(l_quantity as int) * 11 h FROM lineitem),
live AS (SELECT ph.* FROM ph JOIN sr USING (source_id) WHERE NOT removed),
codes AS (SELECT vec_id, label, list_transform(embedding, lambda x: cast(round_even(cast(x as double) * 127, 0) as int)) c FROM embeddings)
"""

"""Tables laid out for what is asked of them: changed bucket by bucket, paged by sorted files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


class Buckets:
    """A Parquet table in folders ``bucket=k``. A change reads and rewrites only the buckets
    that its rows fall into; the others' files are not opened.

    ``place`` gives a row's bucket key, made of key columns: rows of one key must fall
    together. Keys that lie near each other (an event and a stretch of its photos) make the
    rows of one batch touch few buckets, and a hot event still has many. Spark renames the
    buckets of a change one after another; a job that dies in between is repeated, which the
    changes here allow.
    """

    def __init__(self, spark: SparkSession, path: str, place: Callable[[], Column], n: int) -> None:
        self.spark, self.path, self.place, self.n = spark, path, place, n

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.place()), F.lit(self.n)).cast("int"))

    def write(self, rows: DataFrame) -> None:
        self._placed(rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.path)

    def read(self, touched: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return (rows if touched is None else rows.where(F.col("bucket").isin(touched))).drop("bucket")

    def touched(self, delta: DataFrame) -> list[int]:
        """The buckets of a change: numbers below ``n``."""
        return sorted(r.bucket for r in self._placed(delta).select("bucket").distinct().collect())

    def change(self, delta: DataFrame, work: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Puts ``work(old rows of the buckets that delta touches, delta)`` in their place; returns the buckets."""
        delta = cut(delta)
        touched = self.touched(delta)
        if touched:
            rows = self._placed(work(self.read(touched), delta))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return touched


class Pages:
    """A Parquet table in files that are ranges of the order of pages, with a list of the files
    (one row a file: its place, rows, least and greatest key). A page reads the files that can hold
    its rows, which is one or two wherever it lies.

    ``keys`` are the order, ascending; their values are compared as Spark compares structs,
    nulls first. Rows of equal keys stay in one file.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path, keys

    def write(self, rows: DataFrame, files: int) -> None:
        dealt = rows.withColumn("key_", F.struct(*self.keys)).repartitionByRange(files, "key_").withColumn("file_", F.spark_partition_id())
        dealt.sortWithinPartitions("key_").write.mode("overwrite").partitionBy("file_").parquet(f"{self.path}/rows")
        stored = self.spark.read.parquet(f"{self.path}/rows")
        stored.groupBy("file_").agg(F.count("*").alias("n"), F.min("key_").alias("low"), F.max("key_").alias("high")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/files")

    def chosen(self, after: Column | None, most: int) -> list[int]:
        """Files of a page of ``most`` rows: from the one that holds the cursor on, until enough rows lie behind it."""
        files = self.spark.read.parquet(f"{self.path}/files")
        behind = files if after is None else files.where(F.col("high") > after)
        whole = F.lit(True) if after is None else F.col("low") > after
        rows = behind.select("file_", "n", whole.alias("whole")).orderBy("low").limit(most + 2).collect()  # each has a row at least
        out, have = [], 0
        for r in rows:
            if have >= most:
                break
            out.append(r.file_)
            have += r.n if r.whole else 0
        return out

    def page(self, most: int, after: dict | None = None) -> DataFrame:
        """The first ``most`` rows behind the cursor (the keys of the last row seen)."""
        types = self.spark.read.parquet(f"{self.path}/files").schema["low"].dataType
        cursor = None if after is None else F.struct(*[F.lit(after[k]).cast(types[k].dataType).alias(k) for k in self.keys])
        rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col("file_").isin(self.chosen(cursor, most)))
        rows = rows if cursor is None else rows.where(F.col("key_") > cursor)
        return rows.orderBy("key_").limit(most).drop("key_", "file_")


def upsert_few(base: DataFrame, delta: DataFrame, keys: list[str], rules: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """As ``mutations.upsert`` for a change that is small enough to be sent to every task (a
    batch; the caller knows its size): the base is not shuffled, only scanned."""
    small = cut(delta)
    new = F.broadcast(small.select(F.struct(*small.columns).alias("n_"), *[F.col(k).alias(f"j_{k}") for k in keys]))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"j_{k}"))
    joined = base.join(new, on, "left")
    changed = [F.when(F.col("n_").isNotNull(), rules[c](F.col(c), F.col("n_")[c])).otherwise(F.col(c)).alias(c) if c in rules else F.col(c) for c in base.columns]
    there = base.join(new, on, "left_semi").select(*keys)  # as many rows as the change at most, keys being unique
    fresh = small.join(F.broadcast(there), keys, "left_anti")
    given = [F.col(c) if c in small.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns]
    return joined.select(*changed).unionByName(fresh.select(*given))

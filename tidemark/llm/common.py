"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_folder

__all__ = ["HOT_SHARE", "MOST_SENT", "ROWS_A_TASK", "WORD", "beside", "cut", "documents", "fitted", "join_hot", "shared_folder", "short", "shuffle_partitions", "text_or_empty"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key that holds over one in so many of all rows is hot; fewer than so many keys can be.
HOT_SHARE = 10_000
#: Rows (of a few numbers) up to which a list is broadcast; a longer one is shuffled.
MOST_SENT = 1 << 18
#: Rows (of a few numbers) that are worth a task.
ROWS_A_TASK = 1 << 16


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def short(df: DataFrame) -> DataFrame:
    """``df``, which has been cut, marked for broadcast if it has at most MOST_SENT rows."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def beside(rows: DataFrame, table: DataFrame, column: str, how: str = "inner") -> tuple[DataFrame, bool]:
    """``rows`` joined with ``table``, which has been cut, and whether the rows stayed in their
    partitions, in order, as they do where the table is short and sent to them."""
    few = table.count() <= MOST_SENT
    return rows.join(F.broadcast(table) if few else table, column, how), few


def fitted(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """``df``, which has been cut, in no more partitions than one for ``rows`` rows: each
    partition of a table writes files of its own in every later shuffle, however few rows it has."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def join_hot(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and, as ``n``, how many
    of the ``total`` rows have it. Rows of hot keys meet them by broadcast and are
    not dealt by key, so that none of them is one task's work. Both have been cut."""
    is_hot = F.col(n) > total // HOT_SHARE
    hot = F.broadcast(table.where(is_hot))  # under HOT_SHARE rows
    cold = rows.join(hot.select(key), key, "left_anti").join(table.where(~is_hot), key)
    return rows.join(hot, key).unionByName(cold)

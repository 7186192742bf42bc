"""Depths of all folders below a root by path doubling: rounds as the logarithm of the depth."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def walk_doubling(edges: DataFrame, root: str) -> tuple[DataFrame, int]:
    """(folder, depth of all that are reachable from ``root`` in (parent, child); rounds that it took).

    A folder with one parent points at it; each round every pointer takes the pointer of
    where it points, so it spans twice as much, until it ends at the root, at a folder with
    several parents or without one. What still moves after log2(folders) rounds goes round
    in a circle. Folders with several parents are few and are settled among themselves:
    each parent lies a known way below such a folder or the root, and the shortest sum wins,
    a round for every such folder on the way. Loops at one folder and edges into the root
    change nothing; nulls are no folders.
    """
    spark = edges.sparkSession
    plain = edges.select(F.col("parent").cast("string"), F.col("child").cast("string")).dropna()
    plain = cut(plain.where((F.col("parent") != F.col("child")) & (F.col("child") != root)).distinct())
    per = plain.groupBy("child").agg(F.min("parent").alias("up"), F.count("*").alias("n"))
    one = per.where("n = 1").select(F.col("child").alias("folder"), "up", F.lit(1).cast("long").alias("way"))
    several = cut(per.where("n > 1").select(F.col("child").alias("folder")))
    tops = plain.select(F.col("parent").alias("folder")).unionByName(several).unionByName(spark.createDataFrame([(root,)], "folder string")).distinct()
    tops = tops.join(one.select("folder"), "folder", "left_anti")
    done = cut(tops.select("folder", F.col("folder").alias("up"), F.lit(0).cast("long").alias("way")))
    moving, rounds = cut(one), 0
    most = 1 + math.ceil(math.log2(max(2, moving.count())))
    while rounds <= most and not moving.isEmpty():
        rounds += 1
        ended = done.select(F.col("folder").alias("at"), F.col("up").alias("next"), F.col("way").alias("more"), F.lit(True).alias("end"))
        going = moving.select(F.col("folder").alias("at"), F.col("up").alias("next"), F.col("way").alias("more"), F.lit(False).alias("end"))
        jumped = cut(moving.join(ended.unionByName(going), F.col("up") == F.col("at")).select("folder", F.col("next").alias("up"), (F.col("way") + F.col("more")).alias("way"), "end"))
        done = done.unionByName(jumped.where("end").drop("end"))
        moving = jumped.where("not end").drop("end")
    done = cut(done)
    # among the root and the folders with several parents
    parents = plain.join(several, F.col("child") == F.col("folder")).select("parent", "child")
    links = cut(parents.join(done, F.col("parent") == F.col("folder")).groupBy(F.col("up").alias("from"), F.col("child").alias("to")).agg((F.min("way") + 1).alias("way")))
    known = spark.createDataFrame([(root, 0)], "folder string, depth long")
    front = known
    while not front.isEmpty():
        rounds += 1
        found = front.join(links, F.col("folder") == F.col("from")).groupBy("to").agg(F.min(F.col("depth") + F.col("way")).alias("depth")).withColumnRenamed("to", "folder")
        old = known.select("folder", F.col("depth").alias("before"))
        front = cut(found.join(old, "folder", "left").where("before is null or depth < before").select("folder", "depth"))
        known = cut(known.unionByName(front).groupBy("folder").agg(F.min("depth").alias("depth")))
    base = known.select(F.col("folder").alias("top"), "depth")
    return done.join(base, F.col("up") == F.col("top")).select("folder", (F.col("depth") + F.col("way")).alias("depth")), rounds

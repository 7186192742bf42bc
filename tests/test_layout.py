"""Bucketed changes and sorted pages: results as before, and only what is needed is read and written."""

import os
import random
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import boxes, layout, mutations

PHOTO = "event_id long, photo_id long, thumb string, width int"


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_a_change_touches_its_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    base = spark.range(40_000).selectExpr("id % 5 event_id", "id photo_id", "concat('old', id) thumb", "if(id % 3 = 0, null, 100) width")
    table = layout.Buckets(spark, path, lambda: F.struct("event_id", F.floor(F.col("photo_id") / 4096)), 64)
    table.write(base)
    delta = spark.range(1000).selectExpr("2 event_id", "cast(12000 + id * 7 as bigint) photo_id", "'new' thumb", "if(id % 2 = 0, 50, null) width").withColumn("event_id", F.col("event_id").cast("long"))
    rules = {"thumb": mutations.take_new, "width": mutations.new_or_old}
    before = {f: os.stat(f).st_mtime_ns for f in Path(path).rglob("*.parquet")}
    for work in (layout.upsert_few, mutations.upsert):
        touched = table.change(delta, lambda old, new, w=work: w(old, new, ["event_id", "photo_id"], rules))
        assert 0 < len(touched) <= 4
        same = {f for f in before if int(f.parent.name.split("=")[1]) not in touched}
        assert same and all(os.stat(f).st_mtime_ns == before[f] for f in same)
        assert not any(f.exists() for f in before if f not in same)
        assert rows_of(table.read()) == rows_of(mutations.upsert(base, delta, ["event_id", "photo_id"], rules))
        before = {f: os.stat(f).st_mtime_ns for f in Path(path).rglob("*.parquet")}
    assert table.change(delta.where("false"), layout.upsert_few) == []


def test_the_base_is_not_shuffled(spark, tmp_path):
    spark.range(1000).selectExpr("id k", "id v").write.parquet(f"{tmp_path}/b")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        delta = spark.range(5).selectExpr("id * 300 k", "-id v")
        out = layout.upsert_few(spark.read.parquet(f"{tmp_path}/b"), delta, ["k"], {"v": mutations.take_new})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
        assert rows_of(out) == sorted(str((i, -i // 300 if i % 300 == 0 else i)) for i in [*range(1000), 1200])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_pages_read_few_files(spark, tmp_path):
    rng = random.Random(4)
    data = [(rng.choice([None, "2024-01-01", "2024-02-01", "2024-03-01"]), i) for i in range(3000)]
    frame = spark.createDataFrame(data, "taken string, id long")
    pages = layout.Pages(spark, f"{tmp_path}/p", ["taken", "id"])
    pages.write(frame, 20)
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    seen, after = [], None
    for _ in range(6):
        page = pages.page(170, after)
        read = page.select(F.input_file_name().alias("f")).distinct().count()  # of the rows shown
        cursor = None if after is None else F.struct(F.lit(after["taken"]).cast("string").alias("taken"), F.lit(after["id"]).cast("long").alias("id"))
        chosen = pages.chosen(cursor, 170)
        scanned = page._jdf.queryExecution().executedPlan().toString()
        assert 1 <= read <= len(chosen) <= 3 and "file_#" in scanned and "PartitionFilters: [" in scanned
        rows = [tuple(r) for r in page.collect()]
        seen += rows
        after = {"taken": rows[-1][0], "id": rows[-1][1]}
    assert seen == order[: 6 * 170]
    assert pages.page(10, {"taken": "2025", "id": 0}).collect() == []


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    return both / max((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both, 1e-6)


def greedy(rows, most):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        if all(overlap(r[3:], k[3:]) <= most for k in kept if k[0] == r[0]):
            kept.append(r)
    return sorted(r[1] for r in kept)


BOX = "photo_id int, box_id int, score double, x1 double, y1 double, x2 double, y2 double"


def test_suppression_equals_the_greedy_order(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(500):
        x, y = rng.integers(-60, 160, 2).tolist()
        w, h = (rng.choice([0, 8, 20, 21, 50, 130]) + rng.random() for _ in range(2))
        rows.append((k % 3, k, float(k * 7 % 40), float(x), float(y), float(x + w), float(y + h) if k % 50 else float(y)))
    df = spark.createDataFrame(rows, BOX)
    for most in (0.4, 0.7):
        assert sorted(r.box_id for r in boxes.suppress_wide(df, "photo_id", most).collect()) == greedy(rows, most)


def test_one_photo_over_many_tasks(spark):
    """A hundred thousand boxes of one photo; the greedy order is found by a grid of its own."""
    rng = np.random.default_rng(8)
    n = 100_000
    xy, wh = rng.integers(0, 9000, (n, 2)).astype(float), rng.integers(30, 50, (n, 2)).astype(float)
    table = np.concatenate([np.zeros((n, 1)), np.arange(n)[:, None], rng.integers(0, 1 << 30, (n, 1)), xy, xy + wh], axis=1)
    kept, cells = [], {}
    for i in np.lexsort((np.arange(n), -table[:, 2])).tolist():
        b = tuple(table[i, 3:])
        near = [c for gx in range(int(b[0]) // 50, int(b[2]) // 50 + 1) for gy in range(int(b[1]) // 50, int(b[3]) // 50 + 1) for c in cells.get((gx, gy), ())]
        if all(overlap(b, c) <= 0.4 for c in near):
            kept.append(i)
            for gx in range(int(b[0]) // 50, int(b[2]) // 50 + 1):
                for gy in range(int(b[1]) // 50, int(b[3]) // 50 + 1):
                    cells.setdefault((gx, gy), []).append(b)
    df = spark.createDataFrame(pd.DataFrame(table, columns=[c.split()[0] for c in BOX.split(", ")])).selectExpr("cast(photo_id as int) photo_id", "cast(box_id as int) box_id", "score", "x1", "y1", "x2", "y2")
    got = boxes.suppress_wide(df.repartition(8), "photo_id")
    assert sorted(r.box_id for r in got.select("box_id").collect()) == sorted(kept)

"""Searches that owe every query."""

import numpy as np
from pyspark.sql import functions as F
from tidemark.operators import search
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_hundredth_id_asks(spark):
    due = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").select("vec_id").collect()}
    asked = {r["query"] for r in QUERIES["face_due_queries"](spark, SF).select("query").distinct().collect()}
    assert asked == due and len(due) > 2


def test_blocks_lose_no_pair(spark):
    codes = np.random.default_rng(2).integers(-127, 128, (60, 8))
    table = spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(codes)], "id long, codes array<int>")
    got = {(r["query"], r["id"]): r["score"] for r in search.scores_of_many(table, table.where("id % 5 = 0"), 0, block=7).collect()}
    score = codes @ codes.T
    assert got == {(q, i): score[q, i] for q in range(0, 60, 5) for i in range(60) if score[q, i] >= 0}
    assert search.scores_of_many(table, table.where(F.lit(False)), 0).count() == 0

"""Block search against all scores."""

import re

import numpy as np
import pytest

from tidemark.operators import blocks


def table(spark, rows, ids=None):
    return spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids if ids is not None else range(len(rows)), rows, strict=True)], "id long, codes array<int>").repartition(4)


def grouped(rng, groups, each, dim, noise):
    middle = rng.normal(size=(groups, dim))
    rows = np.repeat(middle, each, axis=0) / np.sqrt(dim) + rng.normal(size=(groups * each, dim)) * noise / np.sqrt(dim)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return np.rint(rows * 127).astype(int)


@pytest.mark.parametrize(("noise", "least"), [(0.3, 6000), (0.3, 1), (3.0, 5000), (0.3, 17000)])
def test_same_rows_as_a_full_scan(spark, tmp_path, noise, least):
    rng = np.random.default_rng(5)
    rows = grouped(rng, 12, 40, 16, noise)
    rows[7] = 0
    index = blocks.build(table(spark, rows), f"{tmp_path}/i", 16, 12)
    queries = np.concatenate([rows[::25], rng.integers(-127, 128, (3, 16))])
    got = {(r.query, r.id): r.score for r in blocks.search(index, table(spark, queries), least, block_of=10).collect()}
    scores = queries @ rows.T
    assert got == {(int(q), int(i)): int(scores[q, i]) for q, i in zip(*np.nonzero(scores >= least), strict=True)}
    assert index.rows.sum() == len(rows)


def test_blocks_are_skipped_where_rows_form_groups(spark, tmp_path):
    rows = grouped(np.random.default_rng(6), 20, 50, 64, 0.25)
    index = blocks.build(table(spark, rows), f"{tmp_path}/i", 64, 20)
    least = int(0.6 * 127 * 127)
    assert blocks.skipped(index, rows[::50], least) > 0.8
    found = blocks.search(index, table(spark, rows[:1]), least)
    assert found.count() == int((rows[0] @ rows.T >= least).sum())
    assert (index.bounds(rows[:1].astype(float)) >= least).sum() < 6
    assert re.search(r"PartitionFilters: \[[^\]]*block#\d+ (IN|=)", found._jdf.queryExecution().executedPlan().toString())


def test_bad_rows_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, 0]), (2, None), (3, [1]), (4, [None, 1]), (5, [0, 0])], "id long, codes array<int>")
    index = blocks.build(rows, f"{tmp_path}/i", 2, 4)
    got = blocks.search(index, rows, 0).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (1, 5, 0), (5, 1, 0), (5, 5, 0)]
    none = blocks.build(rows.where("false"), f"{tmp_path}/e", 2, 4)
    assert blocks.search(none, rows, 0).collect() == []
    assert blocks.search(index, rows.where("false"), 0).collect() == []

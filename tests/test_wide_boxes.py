"""Suppression in photos of any size: the same rows by tasks and by rounds, little shuffled for small photos."""

import random

from tidemark.operators import boxes, tokens

SCHEMA = "photo_id long, box_id long, score double, x1 double, y1 double, x2 double, y2 double"


def some(spark):
    rng = random.Random(4)
    rows = []
    for photo in (1, 1, 1, 1, 2, 3, 3):
        for _ in range(30):
            x, y = rng.randrange(60), rng.randrange(60)
            rows.append((photo, len(rows), rng.random(), float(x), float(y), float(x + rng.randrange(5, 50)), float(y + rng.randrange(5, 50))))
    return spark.createDataFrame(rows, SCHEMA)


def told(df):
    return sorted(map(tuple, df.collect()))


def test_both_ways_agree(spark):
    df = some(spark)
    expect = told(tokens.suppress(df, "photo_id"))
    assert len(expect) < df.count()
    for few in (0, 40, 70, 1000):  # all by rounds, some, all by tasks
        assert told(boxes.suppress_wide(df, "photo_id", few=few)) == expect


def test_small_photos_need_no_grid(spark, monkeypatch):
    monkeypatch.setattr(boxes, "conflicts", lambda *_: 1 / 0)
    assert told(boxes.suppress_wide(some(spark), "photo_id")) == told(tokens.suppress(some(spark), "photo_id"))
    odd = spark.createDataFrame([(None, 1, 0.5, 0.0, 0.0, 9.0, 9.0), (None, 2, 0.4, 0.0, 0.0, 9.0, 9.0), (1, 3, None, 0.0, 0.0, 9.0, 9.0), (1, 4, 0.3, 0.0, 0.0, 9.0, 9.0), (1, 5, 0.2, 5.0, 5.0, 5.0, 9.0)], SCHEMA)
    assert boxes.suppress_wide(odd, "photo_id").count() == 5

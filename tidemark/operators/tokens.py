"""Read tokens and detections: rejoining, preferring and suppressing, per crop or photo."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Fixed values.
LEAST_CONF, LEAST_WIDTH = 0.7, 0.01
GAP_BACK, GAP_AHEAD, ROW_SHARE, SUPPRESS = 0.8, 1.5, 0.5, 0.4


def accept(tokens: DataFrame, pattern: str) -> DataFrame:
    """Wide enough, sure enough, and a number by the event's rule: tokens has text,
    conf, width, frame_width. A read whose box is not known passes for its width."""
    wide = F.coalesce(F.col("width") >= LEAST_WIDTH * F.col("frame_width"), F.lit(True))
    return tokens.where(wide & (F.col("conf") >= LEAST_CONF) & text.read_token(F.col("text")).rlike(pattern))


def rejoin_prefixes(tokens: DataFrame, prefixes: list[str]) -> DataFrame:
    """tokens (crop_id, text, conf, x1, y1, x2, y2) and, beside them, every letter
    of ``prefixes`` (with or without its dash) joined to the number that follows it
    on its line: the letter begins and ends before the number does, near to it."""
    box = ["x1", "y1", "x2", "y2"]
    side = lambda p: tokens.select("crop_id", *[F.col(c).alias(f"{p}_{c}") for c in ("text", "conf", *box)])
    letter = F.rtrim(F.upper(text.stripped(F.col("l_text"))), F.lit("-"))
    letters = side("l").withColumn("l_text", letter).where(F.col("l_text").isin(*[p.upper() for p in prefixes]))
    digits = side("d").withColumn("d_text", text.stripped(F.col("d_text"))).where(F.col("d_text").rlike(r"^\p{Nd}+$"))
    extent = lambda p, c: F.greatest(F.col(f"{p}_{c}2") - F.col(f"{p}_{c}1"), F.lit(1.0))
    w, h, dh = extent("l", "x"), extent("l", "y"), extent("d", "y")
    gap = F.col("d_x1") - F.col("l_x2")
    row = F.least("l_y2", "d_y2") - F.greatest("l_y1", "d_y1")
    leads = (F.col("l_x1") < F.col("d_x1")) & (F.col("l_x2") < F.col("d_x2"))
    near = leads & gap.between(-GAP_BACK * w, GAP_AHEAD * F.greatest(w, h)) & (row >= ROW_SHARE * F.least(h, dh))
    whole = letters.join(digits, "crop_id").where(near).select(
        "crop_id",
        F.concat_ws("-", "l_text", "d_text").alias("text"),
        F.least("l_conf", "d_conf").alias("conf"),
        *[(F.least if c[1] == "1" else F.greatest)(f"l_{c}", f"d_{c}").alias(c) for c in box],
    )
    return tokens.select("crop_id", "text", "conf", *box).unionByName(whole)


def prefer_prefixed(hits: DataFrame) -> DataFrame:
    """hits (crop_id, bib as stored, ...) without bare numbers that the crop also shows with a prefix."""
    same = Window.partitionBy("crop_id", text.bib_digits(F.col("bib")))
    full = text.bib_prefix(F.col("bib")) != ""
    # one pass: hits may be the end of a long plan
    shown = hits.withColumn("full_", full).withColumn("any_full_", F.max("full_").over(same) & F.col("crop_id").isNotNull())
    return shown.where(F.col("full_") | ~F.col("any_full_")).drop("full_", "any_full_")


def read_crops(tokens: DataFrame, least: object, prefixes: list[str], most: object = None, required: bool = False) -> DataFrame:
    """crop_id, bib (as stored), conf, raw of the numbers that crops show, by an event's rule.
    tokens: crop_id, text, conf, x1, y1, x2, y2, frame_width (of the crop's photo). A prefix is
    rejoined first, since alone it is too narrow to be a number; what passes is brought to its
    stored form, and only then a bare number gives way to the same digits under a prefix."""
    whole = rejoin_prefixes(tokens, prefixes) if prefixes else tokens.select("crop_id", "text", "conf", "x1", "y1", "x2", "y2")
    frames = tokens.groupBy("crop_id").agg(F.max("frame_width").alias("frame_width"))
    sized = whole.join(frames, "crop_id").withColumn("width", F.col("x2") - F.col("x1"))
    taken = accept(sized, text.bib_rule(least, prefixes, most, required)[0]).withColumn("raw", text.read_token(F.col("text")))
    named = taken.withColumn("bib", text.normalize_bib(F.col("raw"))).where("bib != ''")
    return prefer_prefixed(named.select("crop_id", "bib", "conf", "raw"))


def surest_read(reads: DataFrame) -> DataFrame:
    """One number a crop: the surest, the first number on a tie."""
    return best_by(reads, "crop_id")


def best_by(hits: DataFrame, *keys: str) -> DataFrame:
    """The surest row of each key, the first number on a tie."""
    order = Window.partitionBy(*keys).orderBy(F.desc("conf"), "bib")
    return hits.withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def photo_reads(torso: DataFrame, tiles: DataFrame) -> DataFrame:
    """Numbers of a photo (photo_id, bib, bib_raw, conf) from both passes: the surest
    of each torso crop (``torso`` has crop_id), the surest of each number over all
    tiles; the same number may come from both, a later upsert folds it."""
    out = ["photo_id", "bib", "bib_raw", "conf"]
    return best_by(torso, "photo_id", "crop_id").select(*out).unionByName(best_by(tiles, "photo_id", "bib").select(*out))


def largest_box(boxes: DataFrame, group: str) -> DataFrame:
    """The box of largest area in each group, the first box_id on a tie."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    order = Window.partitionBy(group).orderBy(area.desc(), "box_id")
    return boxes.withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def _kept(group: np.ndarray, box: np.ndarray, most: float, sure: np.ndarray) -> np.ndarray:
    """Which boxes stay, in order inside each group: the ``sure`` ones, and those that
    overlap no box kept before by over ``most``. A round takes the next kept box of
    all groups at once and drops what it overlaps."""
    area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    kept, rest = np.zeros(len(group), bool), np.arange(len(group))
    while len(rest):
        own = group[rest]
        new = np.concatenate([[True], own[1:] != own[:-1]])
        lead = rest[new]
        kept[lead] = True
        lead, rest = lead[np.cumsum(new) - 1][~new], rest[~new]
        side = np.clip(np.minimum(box[lead, 2:], box[rest, 2:]) - np.maximum(box[lead, :2], box[rest, :2]), 0, None)
        both = side[:, 0] * side[:, 1]
        rest = rest[sure[rest] | (both / np.maximum(area[lead] + area[rest] - both, 1e-6) <= most)]
    return kept


def _in_groups(boxes: DataFrame, group: str, order: list[Column], most: float, sure: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """The kept rows of each group, see ``_kept``. Groups are photos: small, and many
    of them share a task and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def chosen(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = table.column(group).to_numpy()
            box = np.stack([table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1).astype(float)
            yield from table.filter(pa.array(_kept(key, box, most, sure(table)))).combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            key = table.column(group).to_numpy()
            done = int(np.flatnonzero(key == key[-1])[0])
            if done:
                yield from chosen(table.slice(0, done))
            rest = table.slice(done)
        if rest is not None and rest.num_rows:
            yield from chosen(rest)

    return boxes.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, boxes.schema)


def suppress(boxes: DataFrame, group: str, most: float = SUPPRESS) -> DataFrame:
    """boxes (group, box_id, score, x1, y1, x2, y2) without those that overlap a
    better one, in order of score."""
    return _in_groups(boxes, group, [F.desc("score"), F.asc("box_id")], most, lambda table: np.zeros(table.num_rows, bool))


def merge_scales(boxes: DataFrame, group: str, most: float = SUPPRESS) -> DataFrame:
    """boxes with ``scale`` 1 or 2: all of the first scale, and those of the second
    that no kept box overlaps."""

    order = [F.asc("scale"), F.desc("score"), F.asc("box_id")]
    return _in_groups(boxes, group, order, most, lambda table: table.column("scale").to_numpy() == 1)

"""Suppression of overlapping boxes whatever the number in one photo, by grid cells and rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tokens import SUPPRESS, suppress

#: Boxes of a photo that one task may hold, and photos in a list that is broadcast.
FEW, LISTED = 1024, 262_144


def conflicts(boxes: DataFrame, group: str, most: float) -> DataFrame:
    """(kept, dropped): numbers of two boxes of a group that overlap by over ``most``, the one that
    comes first in the order of score (ties: box_id) named first.

    Boxes that overlap so much have sizes within a factor of ``most`` of each other both ways,
    so they share a size class or have neighbouring ones, and they share a grid cell of that
    class's size. A box lies in at most four cells of its own class and four of the next
    larger one; two boxes are compared in the cell where their common part begins.
    """
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    step = 1 / most
    # an overlap by over `most` needs each side to be over `most` of the other's
    level = lambda v: F.floor(F.log(F.greatest(v, F.lit(1e-6))) / F.log(F.lit(step)))
    sized = boxes.where((wide > 0) & (high > 0)).select("n_", group, "score", "box_id", "x1", "y1", "x2", "y2", level(wide).alias("lx"), level(high).alias("ly"))
    classes = F.explode(F.expr("flatten(transform(sequence(lx, lx + 1), a -> transform(sequence(ly, ly + 1), b -> struct(a as cx, b as cy))))"))
    placed = sized.withColumn("c", classes).select("*", "c.cx", "c.cy").drop("c")
    size = lambda c: F.pow(F.lit(step), F.col(c) + 1)  # noqa: E731  no box of the class, or the one below, is larger
    cell = lambda lo, hi, c: F.sequence(F.floor(F.col(lo) / size(c)), F.floor(F.col(hi) / size(c)))
    celled = placed.withColumn("gx", F.explode(cell("x1", "x2", "cx"))).withColumn("gy", F.explode(cell("y1", "y2", "cy")))
    side = lambda p: celled.select("cx", "cy", "gx", "gy", F.col(group).alias("g_"), *[F.col(c).alias(f"{p}_{c}") for c in ("n_", "score", "box_id", "x1", "y1", "x2", "y2", "lx", "ly")])
    first = (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & ((F.col("a_box_id") < F.col("b_box_id")) | ((F.col("a_box_id") == F.col("b_box_id")) & (F.col("a_n_") < F.col("b_n_")))))
    # the class of the larger one, and the cell where the common part begins
    one = (F.col("cx") == F.greatest("a_lx", "b_lx")) & (F.col("cy") == F.greatest("a_ly", "b_ly"))
    begins = (F.col("gx") == F.floor(F.greatest("a_x1", "b_x1") / size("cx"))) & (F.col("gy") == F.floor(F.greatest("a_y1", "b_y1") / size("cy")))
    w, h = F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1"), F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1")
    both = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    area = lambda p: (F.col(f"{p}_x2") - F.col(f"{p}_x1")) * (F.col(f"{p}_y2") - F.col(f"{p}_y1"))
    over = both / F.greatest(area("a") + area("b") - both, F.lit(1e-6)) > most
    pairs = side("a").join(side("b"), ["g_", "cx", "cy", "gx", "gy"]).where(first & one & begins & over)
    return pairs.select(F.col("a_n_").alias("kept"), F.col("b_n_").alias("dropped"))


def suppress_wide(boxes: DataFrame, group: str, most: float = SUPPRESS, few: int = FEW) -> DataFrame:
    """As ``tokens.suppress`` (boxes in the order of score, each kept unless it overlaps one that
    was kept by over ``most``), with no photo of over ``few`` boxes held by one task: those go by
    rounds over a grid. Boxes without an area, a score, an id or a photo overlap nothing and stay."""
    large = cut(boxes.groupBy(group).count().where(F.col(group).isNotNull() & (F.col("count") > few)).select(group))
    n = large.count()
    if n == 0:
        return _few(boxes, group, most)
    listed = F.broadcast(large) if n <= LISTED else large
    small = _few(boxes.join(listed, group, "left_anti"), group, most)
    return small.unionByName(by_rounds(boxes.join(listed, group, "left_semi"), group, most))


def _few(boxes: DataFrame, group: str, most: float) -> DataFrame:
    """Photos of few boxes, many of them in a task; what has no area or order is put beside."""
    numbers = [F.col(c).cast("double") for c in ("score", "x1", "y1", "x2", "y2")]
    whole = F.col(group).isNotNull() & F.col("box_id").isNotNull() & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    for v in numbers:
        whole = whole & v.isNotNull() & ~F.isnan(v)
    told = F.coalesce(whole, F.lit(False))
    return suppress(boxes.where(told), group, most).unionByName(boxes.where(~told))


def by_rounds(boxes: DataFrame, group: str, most: float = SUPPRESS) -> DataFrame:
    """As ``suppress_wide``, without a photo in one task. Rounds: a box that no open box outranks
    is kept and drops those it overlaps, until none is open; as many as the longest chain of boxes
    that outrank each other."""
    numbered = cut(boxes.withColumn("n_", F.monotonically_increasing_id()))
    open_ = cut(conflicts(numbered, group, most))
    dropped = None
    while not open_.isEmpty():
        beaten = open_.select(F.col("dropped").alias("n_")).distinct()
        winners = open_.select(F.col("kept").alias("n_")).distinct().join(beaten, "n_", "left_anti")
        out = cut(open_.join(winners, F.col("kept") == F.col("n_")).select(F.col("dropped").alias("n_")).distinct())
        dropped = out if dropped is None else dropped.unionByName(out)
        left = open_.join(winners.unionByName(out).withColumnRenamed("n_", "gone"), F.col("kept") == F.col("gone"), "left_anti")
        open_ = cut(left.join(out.withColumnRenamed("n_", "gone"), F.col("dropped") == F.col("gone"), "left_anti"))
    kept = numbered if dropped is None else numbered.join(dropped, "n_", "left_anti")
    return kept.drop("n_")

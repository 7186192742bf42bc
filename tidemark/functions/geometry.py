"""Box expressions. A box is a struct x, y, w, h; a rectangle is x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slack in long edges; the torso in face widths and heights.
SLACK = 0.25
LEFT, RIGHT, TOP, BOTTOM = -0.75, 1.75, 1.2, 6.5


def parse_box(json: Column) -> Column:
    """'[x,y,w,h]' as a struct; null if it has not four numbers."""
    whole = lambda v: F.when(F.size(v) == 4, F.struct(*[v[i].alias(n) for i, n in enumerate("xywh")]))
    return F.transform(F.array(F.from_json(json, "array<double>")), whole)[0]  # parsed once


def finite(*values: Column) -> Column:
    ok = F.lit(True)
    for v in values:
        d = v.cast("double")
        ok = ok & d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    return ok


def _frame_known(width: Column, height: Column) -> Column:
    return F.coalesce((width > 0) & (height > 0), F.lit(False))


def box_fraction(box: Column, width: Column, height: Column) -> Column:
    """The box as fractions of its frame, clamped to 0..1; null if it cannot be told."""
    part = lambda v, of: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / of))
    inside = F.struct(
        part(box["x"], width).alias("x"), part(box["y"], height).alias("y"), part(box["w"], width).alias("w"), part(box["h"], height).alias("h")
    )
    return F.when(_frame_known(width, height) & finite(box["x"], box["y"], box["w"], box["h"]), inside)


def box_fits(box: Column, width: Column, height: Column, by_side: bool = False) -> Column:
    """Whether the box lies in its frame, give or take a quarter of the long edge. Unknown frames pass;
    ``by_side`` holds the box to the one side that is known."""
    slack = F.greatest(width, height) * SLACK  # of what is known
    inside = (
        (box["x"] >= -slack) & (box["y"] >= -slack) & (box["x"] + box["w"] <= width + slack) & (box["y"] + box["h"] <= height + slack)
    )
    sound = finite(box["x"], box["y"], box["w"], box["h"]) & (box["w"] > 0) & (box["h"] > 0)
    unknown = F.coalesce(inside, F.lit(True)) if by_side else F.lit(True)
    return F.when(~_frame_known(width, height), unknown).otherwise(sound & inside)


def iou(a: Column, b: Column) -> Column:
    """Overlap over union of two rectangles."""
    over = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    both = over("x1", "x2") * over("y1", "y2")
    return both / F.greatest(area(a) + area(b) - both, F.lit(1e-6))


def torso_rect(face: Column, width: Column, height: Column) -> Column:
    """Where a number is worn, seen from the face box; null if outside the frame."""
    whole = lambda v, top: F.greatest(F.lit(0.0), F.least(top.cast("double"), v)).cast("int")
    rect = F.struct(
        whole(face["x"] + face["w"] * LEFT, width).alias("x1"),
        whole(face["y"] + face["h"] * TOP, height).alias("y1"),
        whole(face["x"] + face["w"] * RIGHT, width).alias("x2"),
        whole(face["y"] + face["h"] * BOTTOM, height).alias("y2"),
    )
    return F.when((rect["x2"] > rect["x1"]) & (rect["y2"] > rect["y1"]), rect)


def tile_grid(width: Column, height: Column, cols: int = 2, rows: int = 2, overlap: float = 0.15) -> Column:
    """array<struct<x1,y1,x2,y2:int>> that covers a frame, tiles grown by ``overlap`` of their size."""
    tiles = []
    for r in range(rows):
        for c in range(cols):
            w, h = F.floor(width / cols), F.floor(height / rows)
            edge = lambda v, top: F.greatest(F.lit(0.0), F.least(top.cast("double"), v)).cast("int")
            tiles.append(
                F.struct(
                    edge(w * c - w * overlap, width).alias("x1"),
                    edge(h * r - h * overlap, height).alias("y1"),
                    edge(w * (c + 1) + w * overlap, width).alias("x2"),
                    edge(h * (r + 1) + h * overlap, height).alias("y2"),
                )
            )
    return F.array(*tiles)


def similarity(source: Column, target: Column) -> Column:
    """Rotation, scale and shift (a, b, tx, ty) that best maps points to points:
    x' = a x - b y + tx, y' = b x + a y + ty. Both are array<struct<x,y>>. Points
    that all lie in one place give the identity."""
    n = F.size(source).cast("double")
    total = lambda points, f: F.aggregate(F.transform(points, f), F.lit(0.0), lambda s, v: s + v)
    sx, sy = total(source, lambda p: p["x"]) / n, total(source, lambda p: p["y"]) / n
    tx, ty = total(target, lambda p: p["x"]) / n, total(target, lambda p: p["y"]) / n
    pairs = F.zip_with(source, target, lambda s, t: F.struct((s["x"] - sx).alias("x"), (s["y"] - sy).alias("y"), (t["x"] - tx).alias("u"), (t["y"] - ty).alias("v")))
    norm = total(pairs, lambda p: p["x"] * p["x"] + p["y"] * p["y"])
    some = F.nullif(norm, F.lit(0.0))
    a = total(pairs, lambda p: p["x"] * p["u"] + p["y"] * p["v"]) / some
    b = total(pairs, lambda p: p["x"] * p["v"] - p["y"] * p["u"]) / some
    fit = lambda a, b, c, d: F.struct(a.alias("a"), b.alias("b"), c.alias("tx"), d.alias("ty"))
    zero = F.lit(0.0)
    return F.when(norm == 0, fit(F.lit(1.0), zero, zero, zero)).otherwise(fit(a, b, tx - (a * sx - b * sy), ty - (b * sx + a * sy)))


def inverse(fit: Column) -> Column:
    """The similarity that takes back ``fit``; null if it maps all points to one."""
    a, b, tx, ty = (fit[c] for c in ("a", "b", "tx", "ty"))
    size = a * a + b * b
    back = F.struct((a / size).alias("a"), (-b / size).alias("b"), (-(a * tx + b * ty) / size).alias("tx"), ((b * tx - a * ty) / size).alias("ty"))
    return F.when(size > 0, back)

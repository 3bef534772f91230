"""Boxes (x0, y0, x1, y1), normalised to 0..1 with the origin at the top left, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def union_agg(b: Column) -> Column:
    """Aggregate: the least box around all."""
    return F.when(F.count(b) > 0, box(F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"])))


def union_of(boxes: Column) -> Column:
    """The least box around those of an array; null for none."""
    full = F.filter(boxes, lambda b: b.isNotNull())
    side = lambda f, name: f(F.transform(full, lambda b: b[name]))
    return F.when(F.size(full) > 0, box(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1")))


def line_box(own: Column, words: Column) -> Column:
    """A line's box, or that of its words (array of structs with bbox)."""
    return F.coalesce(own, union_of(F.transform(words, lambda w: w["bbox"])))


def same_row(a: Column, b: Column) -> Column:
    """They overlap by more than half of the lower one's height; without a height, their middles are near."""
    overlap = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    height = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return F.when(height <= 0, F.abs(a["y0"] + a["y1"] - b["y0"] - b["y1"]) < 0.01).otherwise(overlap > 0.5 * height)


def split_box(b: Column, n: Column) -> Column:
    """n equal parts, from right to left."""
    width = (b["x1"] - b["x0"]) / n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: box(b["x1"] - width * (i + 1), b["y0"], b["x1"] - width * i, b["y1"]))


def to_page(b: Column, crop: Column) -> Column:
    """A box within a crop, as a box of the page."""
    width, height = crop["x1"] - crop["x0"], crop["y1"] - crop["y0"]
    return box(crop["x0"] + b["x0"] * width, crop["y0"] + b["y0"] * height, crop["x0"] + b["x1"] * width, crop["y0"] + b["y1"] * height)


def holds(b: Column, x: Column, y: Column, slack: float = 0.0) -> Column:
    return x.between(b["x0"] - slack, b["x1"] + slack) & y.between(b["y0"] - slack, b["y1"] + slack)


def near_equal(a: Column, b: Column, off: float = 0.002) -> Column:
    close = F.lit(True)
    for side in ("x0", "y0", "x1", "y1"):
        close = close & (F.abs(a[side] - b[side]) < off)
    return close


def covers_page(b: Column, share: float = 0.8) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) >= share


def effective_dpi(asked: Column, native: Column, width_in: Column, height_in: Column, most_pixels: float = 12e6, least: int = 36) -> Column:
    """No more than asked for, than the image has, and than the pixel cap allows."""
    cap = F.sqrt(F.lit(most_pixels) / (width_in * height_in))
    return F.greatest(F.lit(least), F.floor(F.least(asked, F.coalesce(native, asked), cap))).cast("int")

"""Boxes: structs of x0, y0, x1, y1 in [0, 1], y downwards. Plain arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def centre_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def centre_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def intersection_area(a: Column, b: Column) -> Column:
    across = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    down = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), across) * F.greatest(F.lit(0.0), down)


def gap_x(a: Column, b: Column) -> Column:
    return F.greatest(a["x0"] - b["x1"], b["x0"] - a["x1"], F.lit(0.0))


def gap_y(a: Column, b: Column) -> Column:
    return F.greatest(a["y0"] - b["y1"], b["y0"] - a["y1"], F.lit(0.0))


def gap(a: Column, b: Column) -> Column:
    """The larger of the horizontal and the vertical distance; 0 where they meet."""
    return F.greatest(gap_x(a, b), gap_y(a, b))


def intersects(a: Column, b: Column) -> Column:
    return ~((a["x1"] < b["x0"]) | (b["x1"] < a["x0"]) | (a["y1"] < b["y0"]) | (b["y1"] < a["y0"]))


def expand(b: Column, x: float = 0.0, y: float | None = None) -> Column:
    y = x if y is None else y
    return box(F.greatest(F.lit(0.0), b["x0"] - x), F.greatest(F.lit(0.0), b["y0"] - y), F.least(F.lit(1.0), b["x1"] + x), F.least(F.lit(1.0), b["y1"] + y))


def contains_point(b: Column, x: Column, y: Column, margin: float = 0.0) -> Column:
    wide = expand(b, margin)
    return x.between(wide["x0"], wide["x1"]) & y.between(wide["y0"], wide["y1"])


def horizontal_overlap(a: Column, b: Column) -> Column:
    """The shared width as a part of the narrower box."""
    shared = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    narrow = F.least(a["x1"] - a["x0"], b["x1"] - b["x0"])
    return F.when((shared <= 0) | (narrow <= 0), 0.0).otherwise(shared / narrow)


def aspect(b: Column) -> Column:
    return F.when((width(b) > 0) & (height(b) > 0), width(b) / height(b))


def aspect_similarity(a: Column, b: Column) -> Column:
    known = a.isNotNull() & b.isNotNull() & (a > 0) & (b > 0)
    return F.when(known, F.greatest(F.lit(0.0), 1.2 - F.abs(a - b) / F.greatest(a, b) * 2.4)).otherwise(0.0)


def size_class(long_edge: Column, area_: Column, small: tuple[float, float], medium: tuple[float, float]) -> Column:
    return F.when((area_ <= small[0]) & (long_edge <= small[1]), "small").when((area_ <= medium[0]) & (long_edge <= medium[1]), "medium").otherwise("large")


def size_class_of_points(w: Column, h: Column) -> Column:
    return F.when(w.isNull() | h.isNull(), None).otherwise(size_class(F.greatest(w, h), w * h, (1800, 72), (12000, 180)))


def size_class_of_box(b: Column) -> Column:
    return F.when(b.isNull(), None).otherwise(size_class(F.greatest(width(b), height(b)), area(b), (0.006, 0.18), (0.04, 0.38)))


def union(b: Column) -> Column:
    """An aggregate: the box around all boxes."""
    return box(F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"]))


def union_of(a: Column, b: Column) -> Column:
    """The box around two boxes."""
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def transform(matrix: Column, x: Column, y: Column) -> Column:
    """struct<x, y>: a point under an affine matrix struct a..f."""
    return F.struct((matrix["a"] * x + matrix["c"] * y + matrix["e"]).alias("x"), (matrix["b"] * x + matrix["d"] * y + matrix["f"]).alias("y"))


def multiply(m: Column, n: Column) -> Column:
    """The affine matrix that applies m first, then n."""
    return F.struct(
        (m["a"] * n["a"] + m["b"] * n["c"]).alias("a"), (m["a"] * n["b"] + m["b"] * n["d"]).alias("b"),
        (m["c"] * n["a"] + m["d"] * n["c"]).alias("c"), (m["c"] * n["b"] + m["d"] * n["d"]).alias("d"),
        (m["e"] * n["a"] + m["f"] * n["c"] + n["e"]).alias("e"), (m["e"] * n["b"] + m["f"] * n["d"] + n["f"]).alias("f"),
    )


def from_pdf_space(b: Column, page_width: Column, page_height: Column) -> Column:
    """A box in points with y upwards, normalised with y downwards."""
    return box(b["x0"] / page_width, 1 - b["y1"] / page_height, b["x1"] / page_width, 1 - b["y0"] / page_height)


def from_page_space(b: Column, page_width: Column, page_height: Column) -> Column:
    return box(b["x0"] / page_width, b["y0"] / page_height, b["x1"] / page_width, b["y1"] / page_height)


def around_polygon(xy: Column) -> Column:
    """The box around a polygon given as x, y, x, y, ..."""
    xs, ys = F.filter(xy, lambda _, i: i % 2 == 0), F.filter(xy, lambda _, i: i % 2 == 1)
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))

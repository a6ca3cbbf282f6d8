"""A figure's box grown over the labels and drawing next to it. Whatever is near enough joins, the box becomes the union, and the larger box may reach more, until nothing
joins. A larger box never lets go of what a smaller one reaches, so the order does not matter: each round takes all that is in reach, by one join and one aggregate
for all figures at once, and a figure with very many parts is spread over tasks like any rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.functions import visual
from quillspark.session import cut

#: Fixed values, in points: (least, share of the figure's width or height) that a part may be away, by its kind; a picture has its own.
REACH_TEXT = ((42.0, 0.28), (26.0, 0.30))
REACH_PAINT = ((20.0, 0.15), (20.0, 0.20))
REACH_PICTURE = 8.0
#: A label is at most so high and so wide, or this share of the figure, and covers no more than this share of it.
LABEL_HIGH, LABEL_WIDE, LABEL_AREA = (28.0, 0.7), (180.0, 1.5), 0.7


def _at_least(bound: tuple[float, float], size: Column) -> Column:
    return F.greatest(F.lit(bound[0]), size * bound[1])


def belongs(figure: Column, part: Column, kind: Column) -> Column:
    """Whether a part of some kind (text, paint or image) is near enough to a figure to be of it."""
    one = lambda size: F.greatest(F.lit(1.0), size)
    wide, high = one(G.width(figure)), one(G.height(figure))
    across, down = G.gap_x(figure, part), G.gap_y(figure, part)
    near = lambda reach: (across <= _at_least(reach[0], wide)) & (down <= _at_least(reach[1], high))
    small = (one(G.height(part)) <= _at_least(LABEL_HIGH, high)) & (one(G.width(part)) <= _at_least(LABEL_WIDE, wide)) & (G.area(part) <= LABEL_AREA * one(G.area(figure)))
    return F.when(kind == "text", small & near(REACH_TEXT)).when(kind == "paint", near(REACH_PAINT)).otherwise((across <= REACH_PICTURE) & (down <= REACH_PICTURE))


def drawn_parts(parts: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """parts without rules and frames among the paint, unless a figure's paint is nothing else. parts: figure, kind, box, ..."""
    b, paint = F.col("box"), F.col("kind") == "paint"
    middle = parts.where(paint & (G.area(b) > 0)).groupBy("figure").agg(F.median(G.area(b)).alias("__middle"))
    parts = parts.join(middle, "figure", "left")
    frame = F.coalesce(visual.is_frame(b, F.coalesce("__middle", F.lit(0.0)), F.lit(page_width), F.lit(page_height)), F.lit(False))
    parts = parts.withColumn("__drawn", paint & ~visual.is_rule(b, F.lit(page_width), F.lit(page_height)) & ~frame)
    some = parts.where("__drawn").select("figure").distinct().withColumn("__some", F.lit(True))
    return parts.join(some, "figure", "left").where(~paint | F.col("__drawn") | F.col("__some").isNull()).drop("__middle", "__drawn", "__some")


def grown(figures: DataFrame, parts: DataFrame) -> DataFrame:
    """figure, box, joined (how many parts) of each figure when nothing more is in reach. figures: figure, box; parts: figure, kind, box. Null boxes are never in reach."""
    left = cut(parts.where("box is not null").select("figure", "kind", F.col("box").alias("__part")))
    now = cut(figures.select("figure", "box", F.lit(0).cast("long").alias("joined")))
    done = now.where(F.lit(False))
    while True:
        tried = left.join(now, "figure").withColumn("__in", F.coalesce(belongs(F.col("box"), F.col("__part"), F.col("kind")), F.lit(False)))
        tried = cut(tried.select("figure", "kind", "__part", "__in"))
        new = cut(tried.where("__in").groupBy("figure").agg(G.union(F.col("__part")).alias("__more"), F.count("*").alias("__n")))
        done = done.unionByName(now.join(new, "figure", "left_anti"))  # what nothing joined is as it will be, and is not looked at again
        if new.isEmpty():
            return done
        now = cut(now.join(new, "figure").select("figure", G.union_of(F.col("box"), F.col("__more")).alias("box"), (F.col("joined") + F.col("__n")).alias("joined")))
        left = tried.where("not __in").join(new, "figure", "left_semi").drop("__in")

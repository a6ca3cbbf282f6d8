"""Spatial joins. All are equi-joins on page (and a grid cell where a page may be crowded) before any comparison of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import geometry as G


def grown_by_images(tables: DataFrame, images: DataFrame, reach: float = 0.08) -> DataFrame:
    """tables (table_id, page, bbox) with their box grown around the images (page, bbox) whose centre lies within `reach` of it, and their number."""
    inside = G.contains_point(F.col("t.bbox"), G.centre_x(F.col("i.bbox")), G.centre_y(F.col("i.bbox")), reach)
    met = tables.alias("t").join(images.alias("i"), (F.col("t.page") == F.col("i.page")) & inside).groupBy("t.table_id").agg(F.count("*").alias("n_images"), F.min("i.bbox.x0").alias("x0"), F.min("i.bbox.y0").alias("y0"), F.max("i.bbox.x1").alias("x1"), F.max("i.bbox.y1").alias("y1"))
    b = lambda c, f: f(F.col(f"bbox.{c}"), F.coalesce(F.col(c), F.col(f"bbox.{c}")))
    joined = tables.join(met, "table_id", "left")
    grown = G.box(b("x0", F.least), b("y0", F.least), b("x1", F.greatest), b("y1", F.greatest))
    return joined.select("table_id", "page", grown.alias("bbox"), F.coalesce("n_images", F.lit(0)).cast("long").alias("n_images"))


def nearest_formula(rows: DataFrame, formulas: DataFrame) -> DataFrame:
    """row_id, formula_id, cost: for each row the formula of least cost on its page, else on the pages beside it (0.4 more). Cost: distance of the centres
    and 0.15 of what the confidence lacks; the first formula on ties. rows: row_id, page, x, y; formulas: formula_id, page, x, y, confidence."""
    distance = F.sqrt(F.pow(F.col("r.x") - F.col("f.x"), 2) + F.pow(F.col("r.y") - F.col("f.y"), 2)) + (1 - F.col("f.confidence")) * 0.15
    best = lambda df: df.groupBy("row_id").agg(F.min(F.struct("cost", "formula_id")).alias("best"))
    same = rows.alias("r").join(formulas.alias("f"), F.col("r.page") == F.col("f.page")).select("r.row_id", "f.formula_id", distance.alias("cost"))
    same = best(same)
    left = rows.join(same, "row_id", "left_anti").withColumn("near", F.explode(F.array(F.col("page") - 1, F.col("page") + 1)))
    near = left.alias("r").join(formulas.alias("f"), F.col("r.near") == F.col("f.page")).select("r.row_id", "f.formula_id", (distance + 0.4).alias("cost"))
    return same.union(best(near)).select("row_id", "best.formula_id", "best.cost")


def nearest_within(points: DataFrame, traces: DataFrame, reach: float = 2.5) -> DataFrame:
    """point_id, trace_id: the trace of least L1 distance with both differences at most `reach`; the first on ties. Both sides are dealt to grid cells of the
    reach's width, points to the nine around them, so a crowded page never becomes a product."""
    cell = lambda c: F.floor(F.col(c) / reach)
    around = F.explode(F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    p = points.withColumn("c", around).select("point_id", "page", F.col("x").alias("px"), F.col("y").alias("py"), "c.cx", "c.cy")
    t = traces.select("trace_id", "page", F.col("x").alias("tx"), F.col("y").alias("ty"), cell("x").alias("cx"), cell("y").alias("cy"))
    dx, dy = F.abs(F.col("px") - F.col("tx")), F.abs(F.col("py") - F.col("ty"))
    met = p.join(t, ["page", "cx", "cy"]).where((dx <= reach) & (dy <= reach)).select("point_id", "trace_id", (dx + dy).alias("d"))
    return met.groupBy("point_id").agg(F.min(F.struct("d", "trace_id")).alias("b")).select("point_id", "b.trace_id")

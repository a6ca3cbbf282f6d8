"""Where elements of a document stand on its pages, and small reports over items: joins within a document, first matches, and pages of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.functions import text as T
from quillspark.operators.ordered import top_per_key

#: How far down a header and how far up a footer reaches, as shares of the page.
HEADER_END, FOOTER_START = 0.22, 0.78
LAST = 10**9


def in_zone(role: str, y0: Column, y1: Column) -> Column:
    return F.coalesce(y0, F.lit(1.0)) <= HEADER_END if role == "header" else F.coalesce(y1, F.lit(0.0)) >= FOOTER_START


def repeated_parts(elements: DataFrame, blocks: DataFrame, role: str) -> DataFrame:
    """doc, block, idx: each block in the zone of headers (footers) with the first element of that role that has its text. elements: doc, idx, text, the headers or
    footers of a document, which are few; blocks: doc, block, y0, y1, text."""
    plain = lambda df: df.withColumn("__plain", T.normal_for_style("text"))
    met = (F.col("b.doc") == F.col("e.doc")) & T.same_normal(F.col("e.__plain"), F.col("b.__plain"))
    rows = plain(blocks.where(in_zone(role, F.col("y0"), F.col("y1")))).alias("b").join(plain(elements).alias("e"), met)
    return rows.groupBy("b.doc", "b.block").agg(F.min("e.idx").alias("idx"))


def table_anchors(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc, idx, page, blocks and box: each table on the page that has most of its lines, the page of the first such block on a tie. tables: doc, idx, text of lines;
    blocks: doc, block, page, box, text. A line matches a block that has its text."""
    lines = tables.select("doc", "idx", F.explode(F.split("text", "\n")).alias("line")).withColumn("__plain", T.normal_for_style("line"))
    known = blocks.withColumn("__plain", T.normal_for_style("text"))
    met = lines.alias("l").join(known.alias("b"), (F.col("l.doc") == F.col("b.doc")) & T.same_normal(F.col("l.__plain"), F.col("b.__plain")))
    met = met.select("l.doc", "l.idx", "b.block", "b.page", "b.box").dropDuplicates(["doc", "idx", "block"])
    pages = met.groupBy("doc", "idx", "page").agg(F.count("*").alias("blocks"), F.min("block").alias("first"), G.union(F.col("box")).alias("box"))
    return top_per_key(pages, ["doc", "idx"], F.col("blocks"), 1, "first").select("doc", "idx", "page", "blocks", "box")


def reading_order(sequence: Column, page: Column, reading: Column, y: Column, x: Column) -> list[Column]:
    """The sort keys of elements: what has no place comes last."""
    or_else = lambda c, value: F.coalesce(c, F.lit(value))
    return [or_else(sequence, LAST), or_else(page, 0), or_else(reading, LAST), or_else(y, 0.0), or_else(x, 0.0)]


def first_assets(items: DataFrame, parts: DataFrame) -> DataFrame:
    """items with the first of their candidate targets that has a part which isn't empty, and its size. items: id, targets array; parts: target, bytes."""
    tried = items.select("id", F.posexplode("targets").alias("place", "target")).join(parts.where("bytes > 0"), "target")
    return items.join(tried.groupBy("id").agg(F.min_by(F.struct("target", "bytes"), "place").alias("found")), "id", "left").select("id", "found.target", "found.bytes")


def changed_texts(items: DataFrame) -> DataFrame:
    """id and alt_text of the items whose text isn't what the file has: what a write-back has to touch."""
    return items.where(F.trim(T.text_or_empty("alt_text")) != F.trim(T.text_or_empty("existing_alt_text"))).select("id", "alt_text")


def sheet_cells(items: DataFrame, by: str, *order: str, columns: int = 4, per_sheet: int = 24) -> DataFrame:
    """items with number (from 1), sheet, row and column on contact sheets, filled row by row."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    cell = at % per_sheet
    return items.select("*", (at + 1).alias("number"), F.floor(at / per_sheet).alias("sheet"), F.floor(cell / columns).alias("row"), (cell % columns).alias("column"))


def list_report(runs: DataFrame) -> DataFrame:
    """doc_id, ordered, unordered and lists, of folds.list_runs()."""
    bullet = F.col("kind") == "bullet"
    return runs.groupBy("doc_id").agg(F.count_if(~bullet).alias("ordered"), F.count_if(bullet).alias("unordered"), F.countDistinct(F.when(~bullet, F.col("list_id"))).alias("lists"))


def best_figures(clusters: DataFrame) -> DataFrame:
    """item, cluster: of each item's clusters the one that covers its declared box best, then of most parts, largest, and nearest. clusters: item, cluster, box, parts,
    declared (a box or null), page_area."""
    box, declared = F.col("box"), F.col("declared")
    smaller = F.greatest(F.lit(1.0), F.least(G.area(box), G.area(declared)))
    apart = F.greatest(box["x0"] - declared["x1"], declared["x0"] - box["x1"], F.lit(0.0)) + F.greatest(box["y0"] - declared["y1"], declared["y0"] - box["y1"], F.lit(0.0))
    far = F.sqrt(F.pow(G.centre_x(box) - G.centre_x(declared), F.lit(2)) + F.pow(G.centre_y(box) - G.centre_y(declared), F.lit(2)))
    keys = [
        F.when(declared.isNotNull(), G.intersection_area(box, declared) / smaller).otherwise(0.0), F.col("parts").cast("double"), G.area(box) / F.greatest(F.lit(1.0), F.col("page_area")),
        F.when(declared.isNotNull(), -(apart + far * 0.05)).otherwise(-(G.centre_x(box) + G.centre_y(box))),
    ]
    ranked = F.struct(*[k.alias(f"k{n}") for n, k in enumerate(keys)], (-F.col("cluster")).alias("first"))
    return clusters.groupBy("item").agg(F.max_by("cluster", ranked).alias("cluster"))


def suggested(items: DataFrame, formula: Column, label: Column, read: Column, sentence: Column) -> DataFrame:
    """id and suggestion: the first that is there of the existing text, the generated one, what a formula says (equations only), a label, what was read off the
    image, and a plain sentence."""
    filled = lambda c: F.nullif(F.trim(T.text_or_empty(c)), F.lit(""))
    said = F.when(F.col("role") == "equation", filled(formula))
    return items.select("id", F.coalesce(filled(F.col("existing_alt_text")), filled(F.col("generated_alt_text")), said, filled(label), filled(read), sentence).alias("suggestion"))


def looked_up(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """The items whose ids are wanted, each once."""
    return items.join(wanted.select("id").distinct(), "id", "left_semi")

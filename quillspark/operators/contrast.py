"""Effective colours of text runs, and the repair of too little contrast.

runs: doc_id, part, run_no, color, highlight, shading, nested_shading (of cell, row, table or paragraph, the innermost), run_style, para_style, table_style; styles: doc_id,
style_id, based_on, color, shading. Styles inherit along based_on (operators/closure.py), so each style is resolved once however many runs use it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import colour
from quillspark.operators.closure import along_chain

#: Highlight names: fixed values.
HIGHLIGHTS = {
    "black": "000000", "blue": "0000FF", "cyan": "00FFFF", "darkBlue": "00008B", "darkCyan": "008B8B", "darkGray": "A9A9A9", "darkGreen": "006400", "darkMagenta": "8B008B", "darkRed": "8B0000",
    "darkYellow": "808000", "green": "00FF00", "lightGray": "D3D3D3", "magenta": "FF00FF", "none": "FFFFFF", "red": "FF0000", "white": "FFFFFF", "yellow": "FFFF00",
}


#: Among how many keys runs without a style are dealt.
DEALT = 4096


def resolved_styles(styles: DataFrame, value: str) -> DataFrame:
    """doc_id, style_id and the value it has or inherits; cycles end."""
    key = lambda c: F.when(F.col(c).isNotNull(), F.struct("doc_id", F.col(c).alias("style_id")))
    chain = along_chain(styles.select(key("style_id").alias("node"), key("based_on").alias("parent"), F.col(value).alias("value")))
    return chain.where("value is not null").select("node.doc_id", "node.style_id", F.col("value").alias(value))


def highlight(name: Column) -> Column:
    return F.create_map(*[x for k, v in HIGHLIGHTS.items() for x in (F.lit(k), F.lit(v))])[name]


def effective(runs: DataFrame, styles: DataFrame, default_color: str = "000000", default_ground: str = "FFFFFF") -> DataFrame:
    """runs with effective_color and ground. A run's own colour counts, else that of the nearest style it names, with nothing further down; the ground is the first of highlight, own shading,
    nested shading, and the shadings of the three styles."""
    colors, grounds = resolved_styles(styles, "color"), resolved_styles(styles, "shading")
    given = runs.columns
    nearest = F.coalesce("run_style", "para_style", "table_style")
    runs = runs.withColumn("style_id", nearest)
    looked_up = [("style_id", colors.withColumnRenamed("color", "__color"))]
    looked_up += [(f"{kind}_style", grounds.select("doc_id", F.col("style_id").alias(f"{kind}_style"), F.col("shading").alias(f"__{kind}"))) for kind in ("run", "para", "table")]
    for name, known in looked_up:
        # a run that names no style finds none: its rows are dealt by what they hold, or they would all meet in the task of the missing key
        runs = runs.withColumn("__deal", F.when(F.col(name).isNull(), F.xxhash64(*given) % DEALT).otherwise(0))
        runs = runs.join(known.withColumn("__deal", F.lit(0).cast("long")), ["doc_id", name, "__deal"], "left").drop("__deal")
    runs = runs.drop("style_id")
    runs = runs.withColumn("effective_color", F.coalesce("color", "__color", F.lit(default_color)))
    return runs.withColumn("ground", F.coalesce(highlight(F.col("highlight")), "shading", "nested_shading", "__run", "__para", "__table", F.lit(default_ground))).drop("__color", "__run", "__para", "__table")


def repaired(runs: DataFrame, styles: DataFrame) -> DataFrame:
    """runs with effective_color, ground, low and new_color: null where the contrast is enough, else the nearest colour that has enough, else from black."""
    rows = effective(runs, styles)
    c, g = F.col("effective_color"), F.col("ground")
    rows = rows.withColumn("low", colour.is_low_contrast(c, g))
    first = colour.accessible(c, g)
    rows = rows.withColumn("__new", F.when(F.col("low"), first))
    again = colour.accessible(F.lit("000000"), g)
    return rows.withColumn("new_color", F.when(colour.is_low_contrast(F.col("__new"), g), again).otherwise(F.col("__new"))).drop("__new")

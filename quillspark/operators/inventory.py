"""The inventory of visual items: summary, filter, and edits laid over a snapshot.

Items: id, role, existing_alt_text, generated_alt_text, alt_text, has_alt_text. Edits are an append-only log (seq, action, item_id, text)
over an unchanged snapshot; the last edit of an item wins, whatever the order in which the log is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillspark.functions.text import collapse, occurrences, text_or_empty


def filled(c: Column) -> Column:
    return F.trim(text_or_empty(c)) != ""


def summary_columns() -> list[Column]:
    role = F.lower(text_or_empty("role"))
    counts = {
        "total_items": F.count("*"),
        "images": F.count_if(role == "image"),
        "equations": F.count_if(role == "equation"),
        "with_alt_text": F.count_if(F.coalesce("has_alt_text", F.lit(False))),
        "generated_alt_text": F.count_if(filled(F.col("generated_alt_text"))),
        "with_effective_alt_text": F.count_if(filled(F.col("alt_text"))),
    }
    return [*(c.alias(name) for name, c in counts.items()), F.greatest(F.lit(0), counts["total_items"] - counts["with_effective_alt_text"]).cast("long").alias("without_alt_text")]


def summarize(items: DataFrame, *by: str) -> DataFrame:
    """The seven counts; over all items, or for each value of `by`. The first one is the original flag, which edits don't change."""
    return items.groupBy(*by).agg(*summary_columns())


def role_histogram(items: DataFrame, by: str) -> DataFrame:
    """Counts by `by` and role, with subtotals."""
    return items.rollup(by, "role").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def effective_text() -> Column:
    """What the filter looks at: the text, else the generated, else the existing one."""
    first = lambda c: F.nullif(text_or_empty(c), F.lit(""))
    return F.trim(F.coalesce(first("alt_text"), first("generated_alt_text"), first("existing_alt_text"), F.lit("")))


def visible(items: DataFrame, role: str = "all", alt: str = "all", search: str = "") -> DataFrame:
    """The items that the three filters leave: role, with-alt or without-alt, and a case-insensitive part of the text."""
    if role != "all":
        items = items.where(F.lower("role") == role)
    if alt != "all":
        items = items.where((effective_text() != "") == (alt == "with-alt"))
    return items.where(F.lower(text_or_empty("alt_text")).contains(search.lower())) if search else items


def source_of(text: Column, existing: Column) -> Column:
    return F.when(text == existing, F.when(existing != "", "existing").otherwise("missing")).when(text != "", "manual").otherwise("missing")


def overlay(items: DataFrame, edits: DataFrame) -> DataFrame:
    """items with the last edit of each laid over: alt_text, alt_source and edited. One aggregate over the log, one left join."""
    last = edits.groupBy("item_id").agg(F.max_by(F.struct(text_or_empty("text").alias("text")), "seq").alias("edit"))
    text = F.when(F.col("edit").isNotNull(), collapse(F.col("edit.text"))).otherwise(F.col("alt_text"))
    joined = items.join(last, items["id"] == last["item_id"], "left").withColumn("edited", F.col("edit").isNotNull()).withColumn("alt_text", text)
    source = F.when(F.col("edited"), source_of(F.col("alt_text"), collapse("existing_alt_text"))).otherwise(F.col("alt_source"))
    return joined.withColumn("alt_source", source).drop("item_id", "edit")


def replace(items: DataFrame, find: str, put: str, chosen: Column | None = None) -> DataFrame:
    """items with `find` replaced in the chosen ones' text: alt_text, alt_source, replaced (occurrences)."""
    n = occurrences("alt_text", F.lit(find))
    touched = (n > 0) & (chosen if chosen is not None else F.lit(True)) & F.lit(find != put)
    items = items.withColumn("replaced", F.when(touched, n).otherwise(0).cast("long"))
    items = items.withColumn("alt_text", F.when(F.col("replaced") > 0, collapse(F.replace("alt_text", F.lit(find), F.lit(put)))).otherwise(F.col("alt_text")))
    return items.withColumn("alt_source", F.when(F.col("replaced") > 0, source_of(F.col("alt_text"), collapse("existing_alt_text"))).otherwise(F.col("alt_source")))


def clear(items: DataFrame, with_generated: bool = False) -> DataFrame:
    """items without text, and cleared: whether there was any. The tagged-page variant also clears the generated text."""
    items = items.withColumn("cleared", collapse("alt_text") != "").withColumns({"alt_text": F.lit(""), "alt_source": F.lit("missing")})
    return items.withColumn("generated_alt_text", F.lit("")) if with_generated else items


def import_texts(items: DataFrame, sheet: DataFrame) -> DataFrame:
    """items with the texts of a workbook's rows (row_no, item_id, text): by item id if it has ids for all of them, of which the last row
    of an id wins; else by position. Positions are row numbers within doc_id, so no task sees more than a document."""
    expected = items.groupBy("doc_id").agg(F.count("*").alias("expected"))
    numbered = items.withColumn("__pos", F.row_number().over(_by_document("id")))
    last = sheet.where("item_id is not null").groupBy("doc_id", "item_id").agg(F.max_by("text", "row_no").alias("by_id"))
    ids = last.groupBy("doc_id").agg(F.count("*").alias("ids"))
    placed = sheet.select("doc_id", F.row_number().over(_by_document("row_no")).alias("__pos"), F.col("text").alias("by_place"))
    by_id = last.withColumnRenamed("item_id", "id")
    joined = numbered.join(expected, "doc_id").join(ids, "doc_id", "left").join(by_id, ["doc_id", "id"], "left")
    joined = joined.join(placed, ["doc_id", "__pos"], "left")
    return joined.withColumn("alt_text", collapse(F.when(F.coalesce("ids", F.lit(0)) >= F.col("expected"), F.col("by_id")).otherwise(F.col("by_place")))).drop("expected", "ids", "by_id", "by_place", "__pos")


def _by_document(order: str) -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy(order)

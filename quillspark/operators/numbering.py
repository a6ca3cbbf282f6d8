"""List numbers as a word processor renders them: counters of every level, their number formats, and the template of the item's level.

An item ends the counters of all deeper levels, so a level's segment is what follows the last shallower item, that item included. Within a segment a counter begins with its start
and grows by one with each item of its level. A template that reads a level which has had no item yet sets that level's counter to its start, so that the
first item of it goes on from there. All of this is running sums and minima within a document's list; no fold is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

LEVELS = 9


def _counters(rows: DataFrame, deepest: int, by: list[str], order: list[str]) -> DataFrame:
    """rows with __n{k}, how many items of level k the segment has up to each row, and __before{k}, whether a template read the level before the first of them. Needs level, __own and __reads, the bits of the levels
    that a row's template reads. All windows run over one order, so rows are sorted once: what a segment has is the running count less the count where it began, and as counts only grow, that is a running maximum."""
    down = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    level, counted = F.col("level"), F.col("__own")
    own = lambda k: counted & (level == k)
    read = lambda k: counted & (level != k) & (F.shiftright("__reads", k) % 2 == 1)
    most = lambda holds, c: F.coalesce(F.max(F.when(holds, c)).over(down), F.lit(0))
    levels = range(deepest)
    rows = rows.withColumns({f"__n{k}": F.count_if(own(k)).over(down) for k in levels} | {f"__r{k}": F.count_if(read(k)).over(down) for k in levels})
    shallower = lambda k: counted & (level < k)
    started = {f"__n{k}": F.col(f"__n{k}") - most(shallower(k), F.col(f"__n{k}")) for k in levels}
    since = {f"__s{k}": most(shallower(k), F.col(f"__r{k}") - read(k).cast("long")) for k in levels}  # the row that begins a segment is in it
    rows = rows.withColumns(started | since)
    first = {f"__before{k}": most(own(k) & (F.col(f"__n{k}") == 1), F.col(f"__r{k}")) > F.col(f"__s{k}") for k in levels}
    return rows.withColumns(first).drop(*[f"__{c}{k}" for c in "rs" for k in levels])


def numbered(items: DataFrame, levels: DataFrame, by: list[str], order: list[str], deepest: int = LEVELS) -> DataFrame:
    """items with prefix, the rendered number. items: by..., num_id, level (from 0) and the order's columns; levels, a document format's small table of one row for each num_id and level:
    num_id, level, template such as '%1.%2', format, start, and first (the start that an override gives, else null).

    An item without num_id has no prefix; one whose level is not defined counts for nothing and is numbered by its level. Formats are joined again after the counting, so that what is sorted is narrow; where
    Spark knows that the levels are few, it broadcasts them, so that a list that all documents share is no key of a shuffle."""
    spec = F.struct("template", "format", F.col("start").cast("long").alias("start"), F.col("first").cast("long").alias("first"))
    lists = levels.groupBy("num_id").agg(*[F.max(F.when(F.col("level") == k, spec)).alias(f"__d{k}") for k in range(deepest)])
    read = lambda k: sum((F.coalesce(F.col(f"__d{k}.template").contains(f"%{j + 1}"), F.lit(False)).cast("int") * (1 << j) for j in range(deepest)), F.lit(0))
    tokens = lists.select("num_id", *[F.when(F.col(f"__d{k}").isNotNull(), read(k)).alias(f"__t{k}") for k in range(deepest)])
    of_own = lambda c: F.coalesce(*[F.when(F.col("level") == k, F.col(f"{c}{k}")) for k in range(deepest)])
    rows = items.join(tokens, "num_id", "left").withColumn("__reads", of_own("__t")).drop(*[f"__t{k}" for k in range(deepest)])
    rows = rows.withColumn("__own", F.col("__reads").isNotNull())
    rows = _counters(rows, deepest, [*by, "num_id"], order).join(lists, "num_id", "left")
    template = of_own("__d")["template"]
    for k in range(deepest):
        d, n = F.col(f"__d{k}"), F.col(f"__n{k}")
        start = F.coalesce(d["start"], F.lit(1))
        value = F.when(n == 0, start).when(F.col(f"__before{k}"), start + n).otherwise(F.coalesce(d["first"], start) + n - 1)
        shown = T.list_number(value, F.coalesce(d["format"], F.lit("decimal")))
        template = F.replace(template, F.lit(f"%{k + 1}"), shown)
    plain = F.when(F.col("num_id").isNotNull(), F.concat((F.col("level") + 1).cast("string"), F.lit("."))).otherwise("")
    rows = rows.withColumn("prefix", F.when(F.col("__own"), F.trim(template)).otherwise(plain)).withColumnRenamed("__own", "defined")
    return rows.select(*items.columns, "prefix", "defined")


def with_prefix(text: T.Text, prefix: Column, defined: Column) -> Column:
    """The text with its number in front, unless it is typed there already; the number of an undefined level only where no list marker at all is typed."""
    typed = T.is_list_item(text) & (~defined | F.ltrim(T.text_or_empty(text)).startswith(prefix))
    return F.when((prefix == "") | typed, T.text_or_empty(text)).otherwise(F.regexp_replace(F.concat_ws(" ", prefix, T.text_or_empty(text)), r"^\s+|\s+$", ""))

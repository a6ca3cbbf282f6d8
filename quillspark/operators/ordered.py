"""Order-sensitive operators: distinct that keeps the first, islands, gaps, neighbours, counters. All are windows partitioned by a key
with an explicit order column; none sorts a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut


def dedupe_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key, in the given order; rows without a key all stay. Pre-aggregated: the winners' order is found by min(),
    which combines on the map side, so a hot key never meets in one task."""
    df = df.withColumns({"__key": key, "__order": F.struct(*order)})
    first = df.where("__key is not null").groupBy("__key").agg(F.min("__order").alias("__first")).withColumnRenamed("__key", "__k")
    joined = df.join(first, (df["__key"] == first["__k"]) & (df["__order"] == first["__first"]), "left")
    return joined.where("__key is null or __k is not null").drop("__key", "__order", "__k", "__first")


def islands(df: DataFrame, by: list[str], order: list[str], same: Column, name: str = "island") -> DataFrame:
    """df with a running number that grows where `same` (about a row and the one before it) isn't true."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn(name, F.sum("__new").over(window)).drop("__new")


def before(value: str | Column, by: list[str], order: list[str]) -> Column:
    return F.lag(value).over(Window.partitionBy(*by).orderBy(*order))


def empty_runs(lines: DataFrame, by: list[str], order: list[str], text: str = "text") -> DataFrame:
    """by..., first, length and alert of each run of empty lines: one is a single alert, more are a double one."""
    empty = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    lines = lines.withColumn("__empty", empty)
    found = islands(lines, by, order, F.col("__empty") == before("__empty", by, order))
    runs = found.where("__empty").groupBy(*by, "island").agg(F.min(order[0]).alias("first"), F.count("*").alias("length"))
    return runs.withColumn("alert", F.when(F.col("length") > 1, "double_empty_paragraph").otherwise("empty_paragraph")).drop("island")


def collapse_reflow(candidates: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Runs of reflow candidates on the same pages in the same direction become one row with their span and largest distance; a
    single one is a layout shift; other rows stay. candidates: classification, left_page, right_page, left_y, right_y, distance."""
    candidates = candidates.withColumn("__down", F.col("left_y") <= F.col("right_y"))
    like = lambda c: F.col(c).eqNullSafe(before(c, by, order))
    reflow = (F.col("classification") == "reflow-candidate") & (before("classification", by, order) == "reflow-candidate")
    found = islands(candidates, by, order, reflow & like("left_page") & like("right_page") & like("__down"))
    found = found.groupBy(*by, "island").agg(F.count("*").alias("span"), F.max("distance").alias("distance"), *[F.min(c).alias(c) for c in order], F.min("classification").alias("classification"))
    is_reflow = F.col("classification") == "reflow-candidate"
    kind = F.when(is_reflow & (F.col("span") > 1), "reflow").when(is_reflow, "layout-shift").otherwise(F.col("classification"))
    return found.withColumn("classification", kind).drop("island")


def merge_runs(df: DataFrame, by: list[str], order: list[str], kind: str, text: str) -> DataFrame:
    """Adjacent fragments of one kind joined, in order."""
    found = islands(df, by, order, F.col(kind) == before(kind, by, order))
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return found.groupBy(*by, "island").agg(F.first(kind).alias(kind), F.array_join(F.transform(parts, lambda x: x[text]), "").alias(text), F.count("*").alias("fragments"))


def gap_clusters(df: DataFrame, by: list[str], low: str, high: str, most: float, *ties: str) -> DataFrame:
    """df with a cluster number: a row opens a new cluster if it begins more than `most` beyond all that came before."""
    window = Window.partitionBy(*by).orderBy(low, *ties)
    reach = F.max(high).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__new", F.when(reach.isNull() | (F.col(low) - reach > most), 1).otherwise(0)).withColumn("cluster", F.sum("__new").over(window).cast("long")).drop("__new")


def nearest_filled(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """df with the value of the nearest row, by distance in `order`, that has one; the earlier row on ties. Two running lookups and no self-join."""
    window = Window.partitionBy(*by).orderBy(order)
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("value")))
    back = F.last(pair, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(pair, ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"__back": back, "__ahead": ahead})
    take_back = F.col("__back").isNotNull() & (F.col("__ahead").isNull() | (F.col(order) - F.col("__back.at") <= F.col("__ahead.at") - F.col(order)))
    return df.withColumn(name, F.when(take_back, F.col("__back.value")).otherwise(F.col("__ahead.value"))).drop("__back", "__ahead")


def neighbour_within(df: DataFrame, by: list[str], order: str, good: Column, value: str, reach: int, name: str) -> DataFrame:
    """df with the value of the nearest good row at most `reach` rows away, not itself; the earlier on ties. Distance counts all rows."""
    window = Window.partitionBy(*by).orderBy(order)
    df = df.withColumns({"__n": F.row_number().over(window), "__good": good})
    hit = F.when(F.col("__good"), F.struct(F.col("__n").alias("n"), F.col(value).alias("value")))
    back = F.last(hit, ignorenulls=True).over(window.rowsBetween(-reach, -1))
    ahead = F.first(hit, ignorenulls=True).over(window.rowsBetween(1, reach))
    df = df.withColumns({"__back": back, "__ahead": ahead})
    take_back = F.col("__back").isNotNull() & (F.col("__ahead").isNull() | (F.col("__n") - F.col("__back.n") <= F.col("__ahead.n") - F.col("__n")))
    return df.withColumn(name, F.when(take_back, F.col("__back.value")).otherwise(F.col("__ahead.value"))).drop("__n", "__good", "__back", "__ahead")


def fill_between(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """df with previous and next: the last value before and the first after each row."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"previous": F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1)), "next": F.first(value, ignorenulls=True).over(window.rowsBetween(1, Window.unboundedFollowing))})


def level_counters(df: DataFrame, by: list[str], order: list[str], level: str, levels: int, start: int = 1) -> DataFrame:
    """df with counter: the number of a list item at its level. An item ends the counts of all deeper levels; a segment of level L is what
    lies between items shallower than L. Exact where templates never read the counter of a level that has had no item."""
    window = Window.partitionBy(*by).orderBy(*order)
    segment = F.lit(0).cast("long")
    df = df.withColumns({f"__s{k}": F.count_if(F.col(level) < k).over(window) for k in range(levels)})
    for k in range(levels):
        segment = F.when(F.col(level) == k, F.col(f"__s{k}")).otherwise(segment)
    df = df.withColumn("__segment", segment)
    return df.withColumn("counter", F.row_number().over(Window.partitionBy(*by, level, "__segment").orderBy(*order)) + start - 1).drop("__segment", *[f"__s{k}" for k in range(levels)])


#: How far apart identifiers may be that are numbered in one task.
NUMBERED_SPAN = 10_000


def numbered(df: DataFrame, by: str, order: str, span: int = NUMBERED_SPAN) -> DataFrame:
    """df with __number, the place of each row among those of its key, by a whole number without repeats within the key. A key with very many rows is numbered in spans of identifiers: what lies
    in the spans before comes from a small table of counts, so that no task sorts a whole key. Rows whose key is null are numbered together; null identifiers come first."""
    df = df.withColumn("__span", F.floor(F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 62))) / span))
    counts = df.groupBy(by, "__span").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(by).alias("__by"), F.col("__span").alias("__of"), before.alias("__before"))
    rows = df.join(offsets, df[by].eqNullSafe(F.col("__by")) & (df["__span"] == F.col("__of")))
    at = F.row_number().over(Window.partitionBy(by, "__span").orderBy(order))
    return rows.withColumn("__number", F.col("__before") + at).drop("__span", "__by", "__of", "__before")


def ordered_distinct(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """by..., values: distinct without regard to case, in order of first appearance, as first written."""
    first = df.groupBy(*by, F.lower(value).alias("__k")).agg(F.min(F.struct(order, value)).alias("f"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x[value]).alias("values"))


def running_before(df: DataFrame, order: list[str], amount: str, name: str = "before") -> DataFrame:
    """df with the sum of `amount` over all rows that come before, in the order of columns that name each row. Rows are dealt by ranges and summed up there; between the ranges only their totals are, of which there is one for each."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("__span", F.shiftright("__at", 33)))
    totals = dealt.groupBy("__span").agg(F.sum(amount).alias("__total"))
    earlier = totals.select("__span", (F.sum("__total").over(Window.orderBy("__span")) - F.col("__total")).alias("__earlier"))
    within = F.sum(amount).over(Window.partitionBy("__span").orderBy("__at")) - F.col(amount)
    return dealt.join(earlier, "__span").withColumn(name, within + F.col("__earlier")).drop("__at", "__span", "__earlier")


def union_with_offsets(sheets: DataFrame, rows: DataFrame) -> DataFrame:
    """All rows of all sheets below one another, headers kept. sheets: file_no, sheet_no, n_rows; rows: file_no, sheet_no, row_no, ... Adds out_row."""
    offsets = running_before(sheets, ["file_no", "sheet_no"], "n_rows", "offset").select("file_no", "sheet_no", "offset")
    return rows.join(offsets, ["file_no", "sheet_no"]).withColumn("out_row", F.col("offset") + F.col("row_no")).drop("offset")


def stacked_layout(sheets: DataFrame, layout: DataFrame) -> DataFrame:
    """kind, top, left, bottom, right, size, hidden: the layout of all sheets below one another. Merged cells, rows with a height and pictures move down by what stands above their sheet; a column is as wide as in the sheet in which it is
    widest, and hidden if it is in any. layout: file_no, sheet_no, kind (merge, row, picture or column), top, left, bottom, right, size, hidden; what hangs on no cell stays so (null top)."""
    offsets = running_before(sheets, ["file_no", "sheet_no"], "n_rows", "offset").select("file_no", "sheet_no", "offset")
    moved = layout.where("kind <> 'column'").join(offsets, ["file_no", "sheet_no"])
    down = lambda c: (F.col(c) + F.col("offset")).cast("long").alias(c)
    moved = moved.select("kind", down("top"), F.col("left").cast("long").alias("left"), down("bottom"), F.col("right").cast("long").alias("right"), F.col("size").cast("double").alias("size"), F.coalesce("hidden", F.lit(False)).alias("hidden"))
    columns = layout.where("kind = 'column'").select(F.explode(F.sequence(F.col("left").cast("long"), F.col("right").cast("long"))).alias("left"), "size", "hidden")  # some thousand columns at most
    widest = columns.groupBy("left").agg(F.max("size").cast("double").alias("size"), F.coalesce(F.bool_or("hidden"), F.lit(False)).alias("hidden"))
    none = F.lit(None).cast("long")
    return moved.unionByName(widest.select(F.lit("column").alias("kind"), none.alias("top"), "left", none.alias("bottom"), F.col("left").alias("right"), "size", "hidden"))


def top_per_key(df: DataFrame, by: list[str], score: Column, k: int, *ties: str) -> DataFrame:
    """The k best rows of each key, with their place."""
    order = Window.partitionBy(*by).orderBy(score.desc(), *ties)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def without_outliers(df: DataFrame, by: list[str], size: str, times: float) -> DataFrame:
    """Rows whose size is less than `times` the exact median of their group."""
    medians = df.groupBy(*by).agg(F.coalesce(F.median(size), F.lit(0.0)).alias("__median"))
    return df.join(medians, by).where(F.col(size) < times * F.col("__median")).drop("__median")

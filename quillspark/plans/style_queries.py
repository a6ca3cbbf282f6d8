"""Registered queries over the style map: every line of a document is an element of its body, and a text block of its pages."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.operators import style_map
from quillspark.plans.page_queries import LINES_SQL, lines
from quillspark.plans.queries import query
from quillspark.plans.refinement_queries import STYLE
from quillspark.session import cut, table


def map_elements(spark: SparkSession, d: str) -> DataFrame:
    """Lines by turns as text, pictures, equations and tables; blank ones are empty. The first one is the header, the last one the footer."""
    k, line = F.col("k"), F.col("line")
    role = F.when(F.trim("line") == "", "empty").when(k % 11 == 3, "image").when(k % 11 == 5, "equation").when(k % 17 == 7, "table").otherwise("normal_text")
    no_list = lambda kind: F.lit(None).cast(f"array<{kind}>")
    body = lines(spark, d).select(
        "doc_id", F.lit("body").alias("part"), k.cast("long").alias("idx"), role.alias("role"), F.when(role == "table", F.replace(line, F.lit(". "), F.lit("\n"))).otherwise(line).alias("text"),
        F.when(k % 4 != 0, (k % 300 + 1).cast("double")).alias("width_pt"), (k % 130 + 1).cast("double").alias("height_pt"), (k % 22 == 5).alias("is_visual"), (k % 2 == 0).alias("has_alt_text"),
        (k % 2 == 1).alias("first_row"), (k % 3 == 1).alias("first_column"), (k % 5 == 1).alias("repeat_header"), F.when(k % 7 != 1, k % 7 != 2).alias("row_break"), no_list("string").alias("fonts"), no_list("double").alias("sizes"),
    )
    text = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.struct(F.lit("header").alias("part"), text[0].alias("text")), F.struct(F.lit("footer").alias("part"), F.element_at(text, -1).alias("text")))).alias("p"))
    own = F.col("doc_id") % 3
    fonts, sizes = F.when(own == 1, F.array(F.lit("Arial"))).when(own == 2, F.array(F.lit("Times New Roman"))), F.when(own == 1, F.array(F.lit(10.0))).when(own == 2, F.array(F.lit(12.0)))
    ends = docs.select("doc_id", "p.part", F.lit(0).cast("long").alias("idx"), F.col("p.part").alias("role"), "p.text", fonts.alias("fonts"), sizes.alias("sizes"))
    return body.unionByName(ends, allowMissingColumns=True)


def map_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Twelve lines to a page, some with more text or in capitals; every ninth again as a line of an equation, every tenth as a picture or drawing."""
    k, n = F.col("k"), F.col("n")
    x0, y0 = (k % 3) / 10, (k % 12) / 12.5
    box = G.box(x0, y0, x0 + F.least(F.lit(0.6), n / 100 + 0.01), y0 + 0.05)
    said = F.when(k % 5 == 1, F.concat("line", F.lit(" extra"))).when(k % 7 == 3, F.translate("line", ascii_lowercase, ascii_uppercase)).otherwise(F.col("line"))
    page = F.floor(k / 12).cast("long").alias("page")
    rows = lines(spark, d)
    none = F.lit(None).cast("long")
    text = rows.select("doc_id", F.lit("text").alias("kind"), k.cast("long").alias("n"), page, box.alias("box"), said.alias("text"), none.alias("text_blocks"), none.alias("text_chars"))
    maths = rows.where(k % 9 == 2).select("doc_id", F.lit("equation_line").alias("kind"), F.floor(k / 9).cast("long").alias("n"), page, box.alias("box"), F.col("line").alias("text"), none.alias("text_blocks"), none.alias("text_chars"))
    drawn = rows.where(k % 10 == 4).select("doc_id", F.when(k % 20 == 4, "vector").otherwise("image").alias("kind"), F.floor(k / 10).cast("long").alias("n"), page, box.alias("box"), F.lit(None).cast("string").alias("text"), (k % 5).cast("long").alias("text_blocks"), (n % 40).cast("long").alias("text_chars"))
    return text.unionByName(maths).unionByName(drawn)


NORMAL = STYLE.replace("lower(text)", "lower({})")
MAP_SQL = rf"""{LINES_SQL}, b as (select doc_id, k, {NORMAL.format(f"case when k % 5 = 1 then line || ' extra' when k % 7 = 3 then translate(line, '{ascii_lowercase}', '{ascii_uppercase}') else line end")} as s, k % 12 <= 2 as top, k % 12 >= 10 as bottom from l),
ends as (select doc_id, arg_min(line, k) as head, arg_max(line, k) as foot, count(*) as n_body from l group by doc_id), e as (select *, {NORMAL.format('head')} as hs, {NORMAL.format('foot')} as fs from ends),
heads as (select e.doc_id, b.k from e join b on b.doc_id = e.doc_id and b.top where hs <> '' and b.s <> '' and (hs = b.s or (length(hs) >= 10 and contains(b.s, hs)) or (length(b.s) >= 10 and contains(hs, b.s)))),
feet as (select e.doc_id, b.k from e join b on b.doc_id = e.doc_id and b.bottom where fs <> '' and b.s <> '' and (fs = b.s or (length(fs) >= 10 and contains(b.s, fs)) or (length(b.s) >= 10 and contains(fs, b.s)))),
h as (select e.doc_id, n_body, count(heads.k) as n_heads from e left join heads on heads.doc_id = e.doc_id group by e.doc_id, n_body),
body as (select l.doc_id, n_heads + k as map_index, k, case when trim(line) = '' then 'empty' when k % 11 = 3 then 'image' when k % 11 = 5 then 'equation' when k % 17 = 7 then 'table' else 'normal_text' end as role from l join h on h.doc_id = l.doc_id),
foot as (select feet.doc_id, n_heads + n_body + row_number() over (partition by feet.doc_id order by feet.k) - 1 as map_index from feet join h on h.doc_id = feet.doc_id)"""


@query()
def style_map_items(spark: SparkSession, d: str) -> DataFrame:
    """Every element with its place. A fold, in which each step depends on the ones before: tests/test_style_map.py holds it against plain loops over all blocks."""
    return style_map.placed_items(map_elements(spark, d), map_blocks(spark, d))


@query(f"with {MAP_SQL} select doc_id, role, count(*) as n from (select doc_id, role from body union all select doc_id, 'header' from heads union all select doc_id, 'footer' from foot) group by doc_id, role")
def style_histogram(spark: SparkSession, d: str) -> DataFrame:
    return style_map.histogram(style_map.placed_items(map_elements(spark, d), map_blocks(spark, d)))


@query(rf"""with {MAP_SQL}, runs as (select *, sum(case when role = 'empty' then 0 else 1 end) over (partition by doc_id order by k) as run from body),
words as (select doc_id, foot, regexp_extract_all(foot, '[A-Za-z][A-Za-z'']*') as w, doc_id % 3 as own, regexp_extract(foot, '[A-Za-z]') as initial from e),
told as (select doc_id, own, list_filter([case when own = 1 then 'font:Arial' end, case when own = 2 then 'size:12.0' end, case when initial <> '' and initial <> upper(initial) then 'capital' end,
    case when initial <> '' and (initial <> upper(initial) or case when len(w) = 1 then w[1] = upper(w[1]) and length(w[1]) > 1 else len(list_filter(w[2:], lambda x: x = upper(x) and length(x) > 1)) > 0 end) then 'case' end], lambda x: x is not null) as issues from words),
structure as (select *, list_filter([case when k % 2 <> 1 then 'header row' end, case when k % 3 <> 1 then 'first column' end, case when k % 5 <> 1 then 'repeat header row' end, case when k % 7 <> 2 then 'break across pages disabled' end], lambda x: x is not null) as missing from body where role = 'table')
select doc_id, min(map_index) as map_index, case when count(*) > 1 then 'double_empty_paragraph' else 'empty_paragraph' end as type, count(*)::varchar as detail from runs where role = 'empty' group by doc_id, run
union all select doc_id, map_index, 'image_missing_alt_text', '' from body where role = 'image' and k % 2 = 1
union all select doc_id, map_index, 'table_missing_structure', array_to_string(missing, ', ') from structure where len(missing) > 0
union all select foot.doc_id, map_index, 'footer_format_mismatch', array_to_string(issues, ', ') from foot join told on told.doc_id = foot.doc_id where own > 0 and len(issues) > 0""")
def style_alerts(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the elements, at their places in the map."""
    elements = map_elements(spark, d)
    items = cut(style_map.placed_items(elements, map_blocks(spark, d)))
    return style_map.alerts(items, elements).select("doc_id", "map_index", "type", "detail")

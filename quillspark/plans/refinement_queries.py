"""Registered queries over rendered list numbers, figures' boxes, and drawings that are formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import equations
from quillspark.functions import geometry as G
from quillspark.operators import figures, numbering
from quillspark.plans.equation_queries import has_any, listed
from quillspark.plans.queries import ORDER, query
from quillspark.plans.views import PHRASES_SQL, boxes, phrases
from quillspark.session import table

#: A list's levels: num_id, level, template, format, start, first.
LEVELS = (
    ("1", 0, "%1.", "decimal", 1, None), ("1", 1, "%1.%2", "lowerLetter", 3, None), ("1", 2, "(%2-%3)", "upperRoman", 1, 4),
    ("2", 0, "%1)", "upperRoman", 1, 5), ("2", 1, "%3 %2", "decimal", 2, None), ("2", 2, "%1.%2.%3", "lowerLetter", 1, None),
)
LEVELS_SQL = ", ".join("(" + ", ".join("null" if x is None else repr(x) for x in level) + ")" for level in LEVELS)
ROMAN_SQL = "repeat('C', v // 100) || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[v // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[v % 10 + 1]"
LETTERS_SQL = "case when v <= 26 then chr((96 + v)::int) else chr((96 + (v - 1) // 26)::int) || chr((97 + (v - 1) % 26)::int) end"


@query(f"""with l as (select l_orderkey // 16 as doc, row_number() over (partition by l_orderkey // 16 order by l_orderkey, {ORDER}) as rn, case when l_partkey % 7 > 0 then (l_suppkey % 2 + 1)::varchar end as num_id,
    case when l_suppkey % 11 = 0 then 3 else l_partkey % 3 end as level, case when l_returnflag = 'N' then '1. item' else 'item' end as text from lineitem),
d(num_id, level, template, format, start, first) as (values {LEVELS_SQL}), c as (select l.*, template from l join d using (num_id, level)),
s as (select c.*, k, coalesce(max(case when level < k then rn end) over (partition by doc, num_id, k order by rn), 0) as since from c, (values (0), (1), (2)) k(k)),
n as (select doc, rn, num_id, k, count(case when level = k then 1 end) over w as items, min(case when level = k then rn end) over w as own, min(case when level <> k and contains(template, '%' || (k + 1)) then rn end) over w as read
    from s window w as (partition by doc, num_id, k, since order by rn)),
v as (select n.doc, n.rn, n.k, d.format, case when items = 0 then d.start when read < own then d.start + items else coalesce(d.first, d.start) + items - 1 end as v from n join d on d.num_id = n.num_id and d.level = n.k),
w as (select doc, rn, max(shown) filter (where k = 0) as v0, max(shown) filter (where k = 1) as v1, max(shown) filter (where k = 2) as v2 from (select doc, rn, k, case format when 'decimal' then v::varchar when 'lowerLetter' then {LETTERS_SQL} else {ROMAN_SQL} end as shown from v) group by doc, rn),
p as (select l.*, d.num_id is not null as defined, case when l.num_id is null then '' when d.num_id is null then (l.level + 1) || '.' else trim(replace(replace(replace(d.template, '%1', v0), '%2', v1), '%3', v2)) end as prefix
    from l left join d on d.num_id = l.num_id and d.level = l.level left join w on w.doc = l.doc and w.rn = l.rn)
select doc, rn, prefix, case when prefix = '' or (text like '1.%' and (not defined or starts_with(text, prefix))) then text else prefix || ' ' || text end as text from p""")
def list_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as items of lists with three levels, of which some are not defined, numbered as a word processor would."""
    order = ["l_orderkey", *ORDER.split(", ")]
    doc, k = F.floor(F.col("l_orderkey") / 16).cast("long"), F.col("l_partkey")
    num_id = F.when(k % 7 > 0, (F.col("l_suppkey") % 2 + 1).cast("string"))
    level = F.when(F.col("l_suppkey") % 11 == 0, 3).otherwise(k % 3)
    rows = table(spark, d, "lineitem").select(doc.alias("doc"), *order, num_id.alias("num_id"), level.alias("level"), F.when(F.col("l_returnflag") == "N", "1. item").otherwise("item").alias("text"))
    levels = spark.sql(f"select num_id, level, template, format, int(start) as start, int(first) as first from values {LEVELS_SQL} as t(num_id, level, template, format, start, first)")  # a size that Spark knows
    from pyspark.sql import Window

    found = numbering.numbered(rows, levels, ["doc"], order, deepest=3)
    rn = F.row_number().over(Window.partitionBy("doc").orderBy(*order)).cast("long")
    return found.select("doc", rn.alias("rn"), "prefix", numbering.with_prefix("text", F.col("prefix"), F.col("defined")).alias("text"))


def figure_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Figures, the first boxes of orders in points, and the other boxes of their orders as text, paint and pictures."""
    b = F.col("bbox")
    kind = F.element_at(F.array(*map(F.lit, ("text", "paint", "image"))), (F.col("l_partkey") % 3 + 1).cast("int"))
    rows = boxes(spark, d).select(F.col("page").alias("figure"), "n", kind.alias("kind"), G.box(b["x0"] * 612, b["y0"] * 792, b["x1"] * 612, b["y1"] * 792).alias("box"), "l_partkey", "l_suppkey")
    first = rows.groupBy("figure").agg(F.min(F.struct("n", "l_partkey", "l_suppkey", "box")).alias("f")).select("figure", "f.box")
    return first, rows.where("n > 1").select("figure", "kind", "box")


@query()
def figure_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Figures grown over their labels and drawing; held against a plain loop in tests."""
    first, parts = figure_parts(spark, d)
    return figures.grown(first, figures.drawn_parts(parts, 612.0, 792.0)).select("figure", "box.*", "joined")


#: Parts of a package and types of relations that drawings of the query refer to.
TARGETS = ("word/media/image3.png", "word/embeddings/oleObject1.bin", "word/embeddings/data.xlsx", "word/media/Formula2.wmf", "media/equation.png", "", "word/embeddings/sheet.bin")
RELATIONS = ("http://x/image", "http://x/image", "http://x/oleObject", "http://x/package", "")


def _pick_sql(values: tuple[str, ...], k: str) -> str:
    return f"({listed(values)})[{k} % {len(values)} + 1]"


STYLE = r"trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'))"


def _word(text: str, values) -> str:
    return rf"regexp_matches({text}, '\b({'|'.join(values)})\b')"


@query(rf"""with {PHRASES_SQL}, x as (select item, role, text, {STYLE} as s, {_pick_sql(TARGETS, 'item')} as target, {_pick_sql(RELATIONS, 'item')} as relation, item % 300 + 1 as width, item % 130 + 1 as height from phrases),
y as (select *, len(regexp_split_to_array(s, ' +')) as n, lower(target) as path, lower(relation) as kind, {" + ".join(f"contains(s, '{w}')::int" for w in equations.READ_OUT)} as signs from x),
z as (select *, case when s = '' or (regexp_matches(s, '^[0-9]+\b') and {_word('s', ('answer', 'answers', 'chapter', 'cont', 'exercise', 'problem', 'review', 'section', 'solution', 'solutions'))}) or {_word('s', equations.PICTURE_WORDS)} then false
    when {_word('s', equations.EDITOR_WORDS)} then true when {_word('s', equations.MATH_WORDS)} then n <= 12 else n <= 12 and signs >= 4 end as reads,
    item % 101 = 0 or (starts_with(path, 'word/embeddings/') and ({has_any('kind', ('oleobject', 'package'))} or {has_any('path', equations.OBJECT_WORDS)})) or (starts_with(path, 'word/media/') and {has_any('path', equations.MEDIA_WORDS)}) as held from y),
q as (select *, held or (reads and not coalesce(width * height > 12000 or greatest(width, height) > 180, false)) as drawn from z)
select item, reads, held, drawn, item % 13 = 0 or {_word('lower(text)', equations.FIELD_WORDS)} or contains(lower(target), 'math') or contains(lower(target), 'equation') or held or (item % 2 = 0 and {has_any('lower(role)', equations.MATH_WORDS)}) as paragraph,
    role = 'equation' and (target <> '' or s = '') as visual from q""")
def drawn_equations(spark: SparkSession, d: str) -> DataFrame:
    """Whether pictures, parts and paragraphs are formulas, by their texts and what they refer to."""
    k = F.col("item")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    rows = phrases(spark, d).select(k, "role", "text", pick(TARGETS).alias("target"), pick(RELATIONS).alias("relation"), (k % 300 + 1).alias("width"), (k % 130 + 1).alias("height"))
    known = k % 101 == 0
    held = equations.target_is_equation("target", "relation", known)
    drawn = equations.drawing_is_equation("text", "target", "relation", known, F.col("width"), F.col("height"))
    paragraph = equations.paragraph_holds_equation(k % 13 == 0, "text", F.array("target"), F.array(held), k % 2 == 0, "role")
    return rows.select(k, equations.picture_reads_as_equation("text").alias("reads"), held.alias("held"), drawn.alias("drawn"), paragraph.alias("paragraph"), equations.is_visual_equation("role", "text", F.lit(None), "target", F.lit("")).alias("visual"))

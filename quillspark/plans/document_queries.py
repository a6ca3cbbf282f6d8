"""Registered queries over packages, anchors, literals and reports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import colour, equations, text
from quillspark.functions import geometry as G
from quillspark.operators import anchors, inventory, numbering
from quillspark.plans.queries import query
from quillspark.plans.views import BOXES_SQL, COLOURS_SQL, ELEMENTS_SQL, ITEMS_SQL, OPENING_PHRASES, PHRASES_SQL, _sql_list, boxes, colours, elements, items, phrases
from quillspark.session import heavy_tasks, table
from quillspark.sources import docx, docx_repairs

SPACES = " ".join(f'xmlns:{k}="{v}"' for k, v in docx.NS.items() if k != "pr")
#: Every line of a document becomes a paragraph of its package: every third has a picture, every fifth a formula; the first is the header, too.
NOT_XML = re.compile("[^\n\x20-퟿-�]")


def made_packages(spark: SparkSession, d: str, marker: Callable[[int], str] = lambda k: "") -> DataFrame:
    """path, content: a package for each document, built in the tasks; its paragraphs may have typed markers."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))

    def paragraph(k: int, line: str) -> str:
        said = "" if k % 2 else f' descr="picture {k}"'
        picture = f'<w:r><w:drawing><wp:inline><wp:extent cx="1270000" cy="635000"/><wp:docPr id="{k}" name="Picture {k}"{said}/><a:graphic><a:blip r:embed="rId{k}"/></a:graphic></wp:inline></w:drawing></w:r>' if k % 3 == 0 else ""
        formula = "<m:oMath><m:r><m:t>a=b</m:t></m:r></m:oMath>" if k % 5 == 1 else ""
        return f'<w:p><w:r><w:t xml:space="preserve">{escape(marker(k) + line)}</w:t></w:r>{picture}{formula}</w:p>'

    def package(lines: list[str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr("[Content_Types].xml", "<Types/>")
            archive.writestr("_rels/.rels", "<Relationships/>")
            archive.writestr("word/header1.xml", f"<w:hdr {SPACES}>{paragraph(1, lines[0])}</w:hdr>")
            archive.writestr("word/document.xml", f"<w:document {SPACES}><w:body>{''.join(paragraph(k, x) for k, x in enumerate(lines))}</w:body></w:document>")
        return out.getvalue()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((path.as_py(), package(NOT_XML.sub("", text.as_py()).split("\n"))) for batch in batches for path, text in zip(*batch.columns, strict=True))
        return docx.in_batches(made, MADE)

    rows = rows.repartition(heavy_tasks(spark), "path")  # a row group has many documents, each costly
    return rows.mapInArrow(build, "path string, content binary")


MADE = pa.schema([("path", pa.string()), ("content", pa.binary())])
LINES_SQL = r"""e as (select doc_id::varchar as path, i - 1 as k, lines[i] as line from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i
    from (select doc_id, string_split(regexp_replace(coalesce(text, ''), '[^\x0A\x20-\x{D7FF}\x{E000}-\x{FFFD}]', '', 'g'), chr(10)) as lines from documents)))"""


@query(rf"""with {LINES_SQL} select path, count(*) as total_items, count(*) as images, 0::bigint as equations, count(*) filter (where k % 2 = 0) as with_alt_text, 0::bigint as generated_alt_text,
    count(*) filter (where k % 2 = 0) as with_effective_alt_text, count(*) filter (where k % 2 = 1) as without_alt_text from e where k % 3 = 0 group by path""")
def package_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Packages read, their visual items told from remains, and summed up."""
    return inventory.summarize(docx.inventory(made_packages(spark, d)), "path")


@query(rf"""with {LINES_SQL} select path, 'word/document.xml' as source_part, k::varchar as docpr_id, 'written ' || k as alt_text from e where k % 6 = 0
    union all select path, 'word/document.xml', k::varchar, '' from e where k % 6 = 3""")
def package_write_back(spark: SparkSession, d: str) -> DataFrame:
    """Texts written to packages and read again; empty ones take the old text away."""
    made = made_packages(spark, d)
    found = docx.inventory(made)
    new = found.select("path", "source_part", "docpr_id", F.when(F.col("docpr_id").cast("int") % 6 == 0, F.concat(F.lit("written "), "docpr_id")).otherwise("").alias("alt_text"))
    again = docx.inventory(docx.with_texts(made, new).select("path", "content"))
    return again.select("path", "source_part", "docpr_id", "alt_text")


@query(rf"""with {LINES_SQL}, m as (select path, 0 as part, k, line, k = 0 as head from e where k = 0 union all select path, 1, k, line, false from e),
r as (select path, case when head then 'header' else 'body' end as zone, unnest(case when head then (case when trim(line) <> '' then ['text', 'formula'] else ['formula'] end)
    else list_concat(case when trim(line) <> '' or (k % 3 <> 0 and k % 5 <> 1) then ['text'] else [] end, list_concat(case when k % 3 = 0 then ['drawing'] else [] end, case when k % 5 = 1 then ['formula'] else [] end)) end) as kind from m)
select path, zone, kind, count(*) as n from r group by path, zone, kind""")
def package_elements(spark: SparkSession, d: str) -> DataFrame:
    """What headers and bodies of packages hold."""
    return docx.style_map(made_packages(spark, d)).groupBy("path", "zone", "kind").agg(F.count("*").alias("n"))


@query(rf"with {LINES_SQL} select path, count(*) filter (where k % 5 = 1) + 1 as formulas, 0::bigint as objects, '' as programs from e group by path")
def package_formulas(spark: SparkSession, d: str) -> DataFrame:
    return docx.formula_storage(made_packages(spark, d)).withColumn("programs", F.array_join("programs", ","))


def typed_marker(k: int) -> str:
    """Of six lines: an item, one below it, another, one below that, a bullet, and plain text."""
    return (f"{k // 6 * 2 + 1}. ", "    (a) ", f"{k // 6 * 2 + 2}. ", "    (b) ", "- ", "then ")[k % 6]


@query(rf"""with {LINES_SQL} select path, k as idx, k % 6 not in (4, 5) as numbered, case k % 6 when 0 then (k // 6 * 2 + 1) || '.' when 2 then (k // 6 * 2 + 2) || '.' when 1 then '(a)' when 3 then '(b)' else '{docx_repairs.BULLET}' end as prefix,
    md5(regexp_replace(line, '^\s+', '')) as digest from e where k % 6 < 5
    union all select path, max(k) + 1, true, '(a)', md5(regexp_replace(arg_min(line, k), '^\s+', '')) from e group by path""")
def package_lists(spark: SparkSession, d: str) -> DataFrame:
    """Typed markers become lists of the word processor; read again, their rendered numbers are what was typed."""
    made = made_packages(spark, d, marker=typed_marker).repartition(heavy_tasks(spark), "path")  # as they are dealt for writing, so that they are made once for both readers
    again = docx_repairs.with_lists(made, docx_repairs.typed_lists(docx_repairs.paragraphs(made))).select("path", "content")
    return numbered_items(*docx_repairs.items_and_levels(again))


def rendered_lists(items: DataFrame, levels: DataFrame) -> DataFrame:
    digest = F.md5(F.col("text").cast("binary")).alias("digest")
    return numbered_items(items.where("num_id is not null").select("doc_id", "idx", "num_id", "level", digest), levels, numbering.LEVELS)


def numbered_items(items: DataFrame, levels: DataFrame, deepest: int) -> DataFrame:
    key = F.concat_ws("/", "doc_id", "num_id")
    spec = levels.select(F.concat_ws("/", "path", "num_id").alias("num_id"), F.col("ilvl").cast("int").alias("level"), F.col("lvl_text").alias("template"), F.col("num_fmt").alias("format"), "start", F.lit(None).cast("int").alias("first"))
    found = numbering.numbered(items.withColumn("num_id", key), spec, ["doc_id"], ["idx"], deepest)
    return found.select(F.col("doc_id").alias("path"), "idx", (F.col("prefix") != docx_repairs.BULLET).alias("numbered"), "prefix", "digest")


def box_key():
    """A key of the view's boxes within their page, in order of their numbers."""
    return F.col("n") * 10**9 + F.col("l_partkey") * 10**4 + F.col("l_suppkey")


BOX_KEY = "n * 1000000000 + l_partkey * 10000 + l_suppkey"


def placed_texts(spark: SparkSession, d: str, key: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, OPENING_PHRASES)), (F.col(key) % len(OPENING_PHRASES) + 1).cast("int"))
    return boxes(spark, d).select(F.col("page").alias("doc"), box_key().alias("n"), "bbox", "l_partkey", "l_suppkey", said.alias("text"))


SAME = r"(a <> '' and b <> '' and (a = b or (length(case when length(a) <= length(b) then a else b end) >= 10 and contains(case when length(a) <= length(b) then b else a end, case when length(a) <= length(b) then a else b end))))"


def _style_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'))"


PLACED_SQL = rf"""{BOXES_SQL}, p as (select page as doc, {BOX_KEY} as n, l_partkey, l_suppkey, x0, y0, x1, y1, {_style_sql(f"({_sql_list(OPENING_PHRASES)})[l_partkey % {len(OPENING_PHRASES)} + 1]")} as a, {_style_sql(f"({_sql_list(OPENING_PHRASES)})[l_suppkey % {len(OPENING_PHRASES)} + 1]")} as b from boxes)"""


@query(f"""with {PLACED_SQL}, j as (select t.doc, t.n as block, e.n as idx from (select doc, n, y0, b from p where y0 <= {anchors.HEADER_END}) t join (select doc, n, a from p) e on t.doc = e.doc and {SAME})
select doc, block, min(idx) as idx from j group by doc, block""")
def repeated_headers(spark: SparkSession, d: str) -> DataFrame:
    heads = placed_texts(spark, d, "l_partkey").select("doc", F.col("n").alias("idx"), "text")
    blocks = placed_texts(spark, d, "l_suppkey").select("doc", F.col("n").alias("block"), F.col("bbox")["y0"].alias("y0"), F.col("bbox")["y1"].alias("y1"), "text")
    return anchors.repeated_parts(heads, blocks, "header")


@query(f"""with {PLACED_SQL}, m as (select t.doc, t.n as idx, s.n as block, s.l_partkey % 2 as pg, s.x0, s.y0, s.x1, s.y1 from (select doc, n, a from p) t join (select doc, n, l_partkey, x0, y0, x1, y1, b from p) s on t.doc = s.doc and {SAME}),
g as (select doc, idx, pg as page, count(*) as blocks, min(block) as first, min(x0) as x0, max(y1) as y1 from m group by doc, idx, pg),
r as (select *, row_number() over (partition by doc, idx order by blocks desc, first) as k from g) select doc, idx, page, blocks, x0, y1 from r where k = 1""")
def table_anchors(spark: SparkSession, d: str) -> DataFrame:
    tables = placed_texts(spark, d, "l_partkey").select("doc", F.col("n").alias("idx"), "text")
    blocks = placed_texts(spark, d, "l_suppkey").select("doc", F.col("n").alias("block"), (F.col("l_partkey") % 2).alias("page"), F.col("bbox").alias("box"), "text")
    found = anchors.table_anchors(tables, blocks)
    return found.select("doc", "idx", "page", "blocks", F.col("box")["x0"].alias("x0"), F.col("box")["y1"].alias("y1"))


@query(f"""with {BOXES_SQL}, o as (select *, row_number() over (partition by page order by coalesce(case when l_partkey % 3 > 0 then l_suppkey % 5 end, {anchors.LAST}), 0, coalesce(case when l_partkey % 5 > 1 then l_partkey % 7 end, {anchors.LAST}), y0, x0, n, l_partkey) as place from boxes)
select page, n, l_partkey, place::bigint as place from o""")
def reading_places(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in order of their sequence, reading order and place; what has no order comes last."""
    from pyspark.sql import Window

    k, s, b = F.col("l_partkey"), F.col("l_suppkey"), F.col("bbox")
    keys = anchors.reading_order(F.when(k % 3 > 0, s % 5), F.lit(None).cast("long"), F.when(k % 5 > 1, k % 7), b["y0"], b["x0"])
    return boxes(spark, d).select("page", "n", "l_partkey", F.row_number().over(Window.partitionBy("page").orderBy(*keys, "n", "l_partkey")).cast("long").alias("place"))


@query("""with l as (select *, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as id from lineitem), i as (select id, unnest([l_partkey * 7 % 500, l_partkey, l_suppkey]) as target, unnest([0, 1, 2]) as place from l),
f as (select i.id, arg_min(i.target, i.place) as target, arg_min(p_size, i.place) as bytes from i join part on p_partkey = i.target where p_size > 25 group by i.id)
select l.id, f.target::varchar as target, f.bytes::bigint as bytes from l left join f on f.id = l.id""")
def first_assets(spark: SparkSession, d: str) -> DataFrame:
    """The first candidate target of each item that the package holds."""
    k = F.col("l_partkey")
    rows = table(spark, d, "lineitem").select((((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + k) * 10000 + F.col("l_suppkey")).alias("id"), F.array(k * 7 % 500, k, F.col("l_suppkey")).cast("array<string>").alias("targets"))
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("target"), F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(0).cast("long").alias("bytes"))
    return anchors.first_assets(rows, parts)


@query(f"with {ITEMS_SQL} select id, alt_text from items where trim(alt_text) <> trim(existing_alt_text)")
def changed_texts(spark: SparkSession, d: str) -> DataFrame:
    return anchors.changed_texts(items(spark, d))


@query(f"""with {BOXES_SQL}, c as (select l_returnflag, l_partkey % 50 as batch, page, n, row_number() over (partition by l_partkey % 50 order by page, n, l_suppkey, l_partkey) - 1 as z from boxes)
select batch, page, n, z + 1 as number, z // 24 as sheet, z % 24 // 4 as row, z % 24 % 4 as column from c""")
def contact_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Where each picture stands on sheets of 24 with four columns."""
    rows = boxes(spark, d).withColumn("batch", F.col("l_partkey") % 50)
    return anchors.sheet_cells(rows, "batch", "page", "n", "l_suppkey", "l_partkey").select("batch", "page", "n", F.col("number").cast("long").alias("number"), "sheet", F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"))


@query(f"""with {BOXES_SQL}, c as (select page as item, {BOX_KEY} as cluster, n % 3 as parts, round(x0 * 100) as x0, round(y0 * 100) as y0, round(x1 * 100) as x1, round(y1 * 100) as y1, page % 4 > 0 as declared from boxes),
k as (select *, (x1 - x0) * (y1 - y0) as a, greatest(0, least(x1, 60) - greatest(x0, 20)) * greatest(0, least(y1, 50) - greatest(y0, 10)) as common,
    greatest(x0 - 60, 20 - x1, 0) + greatest(y0 - 50, 10 - y1, 0) + sqrt(((x0 + x1) / 2 - 40) ** 2 + ((y0 + y1) / 2 - 30) ** 2) * 0.05 as far from c),
r as (select item, cluster, row_number() over (partition by item order by case when declared then round(common / greatest(1, least(a, 1600)), 9) else 0 end desc, parts desc, round(a / 10000, 9) desc, round(case when declared then -far else -((x0 + x1) / 2 + (y0 + y1) / 2) end, 9) desc, cluster) as k from k)
select item, cluster from r where k = 1""")
def best_figures(spark: SparkSession, d: str) -> DataFrame:
    """Of each item's clusters of drawing the one that is its figure."""
    b = F.col("bbox")
    grown = G.box(*[F.round(b[c] * 100) for c in ("x0", "y0", "x1", "y1")])
    declared = F.when(F.col("page") % 4 > 0, G.box(F.lit(20.0), F.lit(10.0), F.lit(60.0), F.lit(50.0)))
    return anchors.best_figures(boxes(spark, d).select(F.col("page").alias("item"), box_key().alias("cluster"), grown.alias("box"), (F.col("n") % 3).alias("parts"), declared.alias("declared"), F.lit(10000.0).alias("page_area")))


@query(rf"""with {PHRASES_SQL} select item as id, coalesce(nullif(case when item % 7 = 0 then trim(text) else '' end, ''), case when item % 5 = 0 then 'generated ' || item end, case when role = 'equation' then nullif(trim(regexp_replace(low, '[^a-z ]', '', 'g')), '') end,
    nullif(case when item % 2 = 0 then trim(c) else '' end, ''), 'A ' || role || '.') as suggestion from t""")
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    """The first source of a text that has one."""
    k = F.col("item")
    rows = phrases(spark, d).select(k.alias("id"), "role", "text", F.when(k % 7 == 0, F.col("text")).alias("existing_alt_text"), F.when(k % 5 == 0, F.concat(F.lit("generated "), k.cast("string"))).alias("generated_alt_text"))
    low = F.regexp_replace(F.lower(text.collapse("text")), "[^a-z ]", "")
    return anchors.suggested(rows, low, F.when(F.col("id") % 2 == 0, text.collapse("text")), F.lit(None).cast("string"), F.concat(F.lit("A "), "role", F.lit(".")))


@query(f"with {ITEMS_SQL} select id, role from items where id in (select p_partkey * 3 from part)")
def looked_up_items(spark: SparkSession, d: str) -> DataFrame:
    return anchors.looked_up(items(spark, d), table(spark, d, "part").select((F.col("p_partkey") * 3).alias("id"))).select("id", "role")


@query(rf"""with {ELEMENTS_SQL}, s as (select doc_id, idx, list_filter(regexp_split_to_array(replace(text, ' the ', chr(9)), '[\t\r\n]+'), lambda x: regexp_matches(x, '[\pL\pN]')) as s from elements)
select doc_id, idx, len(s) as n, md5(array_to_string(s, '|')) as digest from s""")
def text_segments(spark: SparkSession, d: str) -> DataFrame:
    """Lines cut at tabs, of which some are made here, without pieces that say nothing."""
    rows = elements(spark, d).select("doc_id", "idx", text.segments(F.replace("text", F.lit(" the "), F.lit("\t"))).alias("s"))
    return rows.select("doc_id", "idx", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query(f"""with {COLOURS_SQL}, h as (select p_partkey, colour, [('0x' || substr(colour, 2, 2))::int, ('0x' || substr(colour, 4, 2))::int, ('0x' || substr(colour, 6, 2))::int] as c,
    case when p_partkey % 2 = 0 then p_partkey * 37 % 256 end as up, case when p_partkey % 3 = 0 then p_partkey * 91 % 256 end as down from colours),
u as (select p_partkey, down, list_transform(c, lambda x: case when up is null then x else round_even(x + (255 - x) * (up / 255), 0) end) as c from h)
select p_partkey, array_to_string(list_transform(c, lambda x: printf('%02X', case when down is null then x else round_even(x * (down / 255), 0) end::int)), '') as tinted from u""")
def tinted_colours(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    two = lambda n: F.lpad(F.hex(n % 256), 2, "0")
    return colours(spark, d).select(k, colour.tinted(F.col("colour"), F.when(k % 2 == 0, two(k * 37)), F.when(k % 3 == 0, two(k * 91))).alias("tinted"))


@query("""select p_partkey, '' || p_partkey || ',' || p_partkey * 7 as refs, case when p_size > 10 then (p_partkey + 0.5 + p_size - 3 + 0.25)::double end as total, lower('Figure' || p_size) as name,
    (list_sum(list_transform(string_split(p_brand, ''), lambda c: unicode(c))) % 4)::bigint as variant,
    greatest(least(8, (p_size % 9 + 4 * (p_size % 3)) // 4), case when p_size % 2 = 0 then least(8, p_size % 12 - 1) else 0 end, case when p_size * 100 >= 720 then least(8, round_even((p_size * 100 - 720) / 720, 0)) else 0 end)::bigint as level_of
    from part""")
def literals(spark: SparkSession, d: str) -> DataFrame:
    """References, boxes and names of page files, wordings by code points, and levels of lists."""
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, d, "part")
    numbers = text.four_numbers(F.when(s > 10, F.concat_ws(" ", F.lit("["), k, F.lit(".5"), s, F.lit("-3"), F.lit("]"))).otherwise("[1 2 3]"))
    literal = F.concat_ws(" ", F.lit("<</A"), k, F.lit("0 R /B"), k * 7, F.lit("0 R>>"))
    leading = F.concat(F.repeat(F.lit(" "), (s % 9).cast("int")), F.repeat(F.lit("\t"), (s % 3).cast("int")))
    style = F.when(s % 2 == 0, F.concat(F.lit("List Number "), (s % 12).cast("string"))).otherwise("Body")
    return rows.select(
        k, F.array_join(text.references(literal).cast("array<string>"), ",").alias("refs"), (F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) - 0.25 + F.lit(0.5)).alias("total"),
        text.name_key(F.concat(F.lit(" /Figure"), s)).alias("name"), text.variant("p_brand", 4).alias("variant"), text.list_level(leading, style, s * 100).cast("long").alias("level_of"),
    )

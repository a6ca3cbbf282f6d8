"""Registered queries over pages: what content streams paint, and the inventory of tagged structure trees. Every document is a page; every line of it is drawn in its stream and is a node of its tree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.operators import regions, structure
from quillspark.plans.queries import query
from quillspark.plans.views import PAGE_WORDS, page_words
from quillspark.session import heavy_tasks, table
from quillspark.sources import content_streams, docx, xlsx

WIDTH, HEIGHT = 612.0, 792.0
MADE = pa.schema([("path", pa.string()), ("content", pa.binary())])


def lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, k, line, and numbers made of both."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))
    n = F.char_length("line")
    return rows.select("doc_id", "k", "line", n.alias("n"), (F.col("k") * 7 % 500).alias("x"), (n % 700).alias("y"), (n % 90 + 1).alias("w"), (F.col("k") % 50 + 1).alias("h"))


LINES_SQL = """l as (select *, length(line) as n, k * 7 % 500 as x, length(line) % 700 as y, length(line) % 90 + 1 as w, k % 50 + 1 as h
    from (select doc_id, i - 1 as k, lines[i] as line from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))))"""


def drawn_lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, part, content: a page's streams. Lines are shown as text, as a picture with the line as its text, as a rectangle behind a comment, or as a path under another matrix."""
    said = F.regexp_replace("line", r"([\\()])", r"\\$1")
    put = lambda pattern, *values: F.format_string(pattern, *values)
    k, x, y, w, h = (F.col(c) for c in "kxywh")
    drawn = (
        F.when(k % 4 == 0, put("/P <</MCID %d>> BDC BT 1 0 0 1 %d %d Tm (%s) Tj ET EMC", k, x, y, said))
        .when(k % 4 == 1, put("/Figure <</Alt (%s) /MCID %d>> BDC q %d 0 0 %d %d %d cm /Im1 Do Q EMC", said, k, w, h, x, y))
        .when(k % 4 == 2, put("%% %s\n/Figure <</MCID %d>> BDC %d %d %d %d re f EMC", F.regexp_replace("line", "\r", " "), k, x, y, w, h))
        .otherwise(put("q 2 0 0 2 10 20 cm /Span <</MCID %d>> BDC /X BMC %d %d m %d %d l %d %d l S EMC EMC Q /Form Do", k, x, y, x + w, y, x + w, y + h))
    )
    rows = lines(spark, d).select("doc_id", (k + 1).alias("part"), drawn.cast("binary").alias("content"))
    first = table(spark, d, "documents").select("doc_id", F.lit(0).alias("part"), F.lit("1 0 0 1 5 7 cm q").cast("binary").alias("content"))
    return rows.unionByName(first)


def page_content(spark: SparkSession, d: str) -> DataFrame:
    log = content_streams.paint_log(drawn_lines(spark, d), ["doc_id"])
    x, y = F.col("x") + 5.0, F.col("y") + 7.0
    shown = lines(spark, d).where("k % 4 = 0")
    traces = shown.select("doc_id", F.col("k").cast("long").alias("trace"), (x + 1).alias("x"), (y + 1).alias("y"), x.alias("x0"), y.alias("y0"), (x + F.col("w")).alias("x1"), (y + F.col("h")).alias("y1"))
    names = table(spark, d, "documents").select("doc_id", F.lit("Im1").alias("name"))
    return content_streams.components(log, ["doc_id"], traces, names)


CONTENT_SQL = """g as (select doc_id, k as trace, x + 6 as gx, y + 8 as gy, x + 5 as x0, y + 7 as y0, x + 5 + w as x1, y + 7 + h as y1 from l where k % 4 = 0),
near as (select a.doc_id, a.k, arg_min(struct_pack(x0, y0, x1, y1), (abs(gx - (a.x + 5)) + abs(gy - (a.y + 7))) * 1000000 + trace) as b from l a join g on g.doc_id = a.doc_id and abs(gx - (a.x + 5)) <= 2.5 and abs(gy - (a.y + 7)) <= 2.5 where a.k % 4 = 0 group by a.doc_id, a.k),
content as (select doc_id, k as mcid, 'text' as kind, b.x0::double as x0, b.y0::double as y0, b.x1::double as x1, b.y1::double as y1 from near
    union all select doc_id, k, case k % 4 when 1 then 'image' else 'paint' end, x + 5, y + 7, x + 5 + w, y + 7 + h from l where k % 4 in (1, 2)
    union all select doc_id, k, 'paint', 2 * x + 15, 2 * y + 27, 2 * (x + w) + 15, 2 * (y + h) + 27 from l where k % 4 = 3)"""


@query(f"with {LINES_SQL}, {CONTENT_SQL} select doc_id, mcid::int as mcid, kind, x0, y0, x1, y1 from content")
def painted_content(spark: SparkSession, d: str) -> DataFrame:
    """Streams made of every line, read, and what each marked content paints."""
    return page_content(spark, d)


#: Roles of the trees' nodes, and what documents map their own roles to.
ROLES = ("Figure", "/Pic", "Eq", "P", "Span", "Formula", "Loop")
ROLE_MAP = (("Pic", "Figure"), ("Eq", "/Maths"), ("Maths", "Formula"), ("Loop", "Loop2"), ("Loop2", "Loop"))


def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A tree over each document's lines: line k hangs below (k - 1) div 2; some nodes are no elements, some have no page or no box."""
    k, x, y, w, h = (F.col(c) for c in "kxywh")
    box: Column = F.when(k % 6 == 0, G.box(x, y, x + w * 2, y + h))
    return lines(spark, d).select(
        "doc_id", k.alias("node"), F.when(k > 0, F.floor((k - 1) / 2).cast("int")).alias("parent"), ((k + 1) % 2).alias("child_pos"),
        F.when(k % 13 != 12, F.element_at(F.array(*map(F.lit, ROLES)), k % 7 + 1)).alias("role"), F.lit(False).alias("is_element"), F.when(F.col("n") % 3 == 0, F.col("line")).alias("alt"),
        F.when(k % 10 != 9, F.lit(1)).alias("page"), F.when(k % 5 == 0, F.array(k, k + 1)).otherwise(F.array(k)).alias("mcids"), box.alias("box"),
    )


_ASPECT = "greatest({0}w, {0}h) / least({0}w, {0}h)"


@query(rf"""with recursive {LINES_SQL}, {CONTENT_SQL},
t as (select doc_id, k, case when k > 0 then (k - 1) // 2 end as parent, case when k % 13 = 12 then '' when k % 7 in (0, 1) then 'figure' when k % 7 in (2, 5) then 'formula' else 'other' end as role,
    case when k % 13 <> 12 then (['figure', 'pic', 'eq', 'p', 'span', 'formula', 'loop'])[k % 7 + 1] else '' end as raw, case when n % 3 = 0 then trim(regexp_replace(replace(line, chr(0), ''), '\s+', ' ', 'g')) else '' end as alt, case when k % 10 <> 9 then 1 end as page, x, y, w, h from l),
alive(doc_id, k) as (select doc_id, k from t where k = 0 and raw <> '' union all select t.doc_id, t.k from alive a join t on t.doc_id = a.doc_id and t.parent = a.k where t.raw <> ''),
up(doc_id, k, node) as (select doc_id, k, parent from t where role in ('figure', 'formula') and parent is not null union all select up.doc_id, up.k, t.parent from up join t on t.doc_id = up.doc_id and t.k = up.node where t.parent is not null),
outer_ as (select distinct up.doc_id, up.node as k from up join t a on a.doc_id = up.doc_id and a.k = up.k join t b on b.doc_id = up.doc_id and b.k = up.node where a.role = b.role),
items as (select t.* from t join alive using (doc_id, k) left join outer_ o on o.doc_id = t.doc_id and o.k = t.k where t.role in ('figure', 'formula') and o.k is null),
own(doc_id, item, node, depth) as (select doc_id, k, k, 0 from t where role in ('figure', 'formula') union all
    select o.doc_id, o.item, t.k, o.depth + 1 from own o join t on t.doc_id = o.doc_id and t.parent = o.node where t.role not in ('figure', 'formula') and (o.depth = 0 or t.alt = '')),
m as (select distinct doc_id, item, unnest(case when node % 5 = 0 then [node, node + 1] else [node] end) as mcid from own),
drawn as (select i.doc_id, i.k, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from items i join m on m.doc_id = i.doc_id and m.item = i.k join content c on c.doc_id = i.doc_id and c.mcid = m.mcid where i.page = 1 group by i.doc_id, i.k),
b as (select i.*, row_number() over (partition by i.doc_id order by i.k) - 1 as id, d.x0 as cx0, d.y0 as cy0, d.x1 as cx1, d.y1 as cy1, d.x0 is not null as has_drawn, i.k % 6 = 0 as has_box, i.x::double as bx0, i.y::double as by0, (i.x + 2 * i.w)::double as bx1, (i.y + i.h)::double as by1 from items i left join drawn d on d.doc_id = i.doc_id and d.k = i.k),
s as (select *, greatest(1, bx1 - bx0) as dw, greatest(1, by1 - by0) as dh, greatest(1, cx1 - cx0) as cw, greatest(1, cy1 - cy0) as ch, (bx1 - bx0) * (by1 - by0) as da, (cx1 - cx0) * (cy1 - cy0) as ca, greatest(0, least(bx1, cx1) - greatest(bx0, cx0)) * greatest(0, least(by1, cy1) - greatest(by0, cy0)) as both_ from b),
p as (select *, has_drawn and (role = 'formula' or not has_box or both_ < 0.7 * ca or dw <= cw * 0.72 or dh <= ch * 0.72 or {_ASPECT.format('d')} >= 2.5 * {_ASPECT.format('c')} or {_ASPECT.format('c')} >= 2.5 * {_ASPECT.format('d')}
    or (da / {WIDTH * HEIGHT} >= 0.4 and ca / {WIDTH * HEIGHT} <= 0.32) or (da >= 3 * ca and ca >= 250)) as better from s),
q as (select *, case when better then cx0 when has_box then bx0 end as x0, case when better then cy0 when has_box then by0 end as y0, case when better then cx1 when has_box then bx1 end as x1, case when better then cy1 when has_box then by1 end as y1 from p)
select doc_id, id, k::int as node, case role when 'formula' then 'Formula' else 'Figure' end as type, case role when 'formula' then 'equation' else 'image' end as role, raw as struct_role, role as standard_role, page::int as page, alt <> '' as has_alt_text, alt as alt_text,
    case when alt <> '' then 'existing' else 'missing' end as alt_source, case when alt <> '' then alt when role = 'formula' then 'Formula' else 'Figure' end as label,
    case when page = 1 then greatest(0, least(1, x0 / {WIDTH})) end as x0, case when page = 1 then greatest(0, least(1, 1 - y1 / {HEIGHT})) end as y0, case when page = 1 then greatest(0, least(1, x1 / {WIDTH})) end as x1, case when page = 1 then greatest(0, least(1, 1 - y0 / {HEIGHT})) end as y1 from q""")
def tagged_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The figures and formulas of every document's tree, with what its streams paint for them."""
    docs = table(spark, d, "documents").select("doc_id")
    pairs = docs.withColumn("pair", F.explode(F.array(*[F.struct(F.lit(a).alias("role"), F.lit(b).alias("to")) for a, b in ROLE_MAP]))).select("doc_id", "pair.*")
    pages = docs.select("doc_id", F.lit(1).alias("page"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    content = page_content(spark, d).withColumn("page", F.lit(1))
    found = structure.tree_inventory(tree_nodes(spark, d), pairs, content, pages)
    return found.select("doc_id", "id", "node", "type", "role", "struct_role", "standard_role", "page", "has_alt_text", "alt_text", "alt_source", "label", "preview_box.*")


@query(rf"""with recursive {LINES_SQL}, t as (select doc_id, k, case when k > 0 then (k - 1) // 2 end as parent, k % 7 in (0, 2, 5) as target, n % 3 = 0 and trim(line) <> '' as has_alt from l),
own(doc_id, item, node, depth) as (select doc_id, k, k, 0 from t where target union all select o.doc_id, o.item, t.k, o.depth + 1 from own o join t on t.doc_id = o.doc_id and t.parent = o.node where not t.target and (o.depth = 0 or not t.has_alt)),
m as (select distinct doc_id, item, unnest(case when node % 5 = 0 then [node, node + 1] else [node] end) as mcid from own)
select doc_id, item::int as item, string_agg(mcid::varchar, ',' order by mcid) as mcids from m group by doc_id, item""")
def owned_marks(spark: SparkSession, d: str) -> DataFrame:
    """The marked content that each figure and formula owns, roles taken as they stand."""
    nodes = tree_nodes(spark, d).withColumns({"role": F.element_at(F.array(*map(F.lit, ("Figure", "Pic", "Formula", "P", "Span", "Formula", "Loop"))), F.col("node") % 7 + 1), "has_alt": F.trim(F.coalesce("alt", F.lit(""))) != ""})
    return structure.owned_content(nodes).select("doc_id", "item", F.array_join(F.col("mcids").cast("array<string>"), ",").alias("mcids"))


#: Of the words that stand on the pages of the view, those that may be parts of equations; none is one by itself.
FRAGMENTS = ("x2", "=", "+", "12.5", "(", ")", "y", "37", "a")


def raw_page(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, pictures and paths: an order is a block of a page, its order lines are words of one row, a path each, and a picture if returned."""
    words = page_words(spark, d)
    unit = G.box(F.col("x0") / 300, F.col("y0") / 100, F.col("x1") / 300, F.col("y1") / 100)
    lines = words.select(F.col("item").alias("doc_id"), F.lit(1).alias("page"), F.col("line").alias("block"), (F.col("x0") / 20).cast("int").alias("line"), unit.alias("box"), "text")
    n, k = F.col("l_orderkey"), F.col("l_linenumber")
    x, y = (k - 1) * 0.1301, (n % 4) * 0.2403
    rows = table(spark, d, "lineitem").select(F.floor(n / 4).cast("long").alias("doc_id"), F.lit(1).alias("page"), ((n % 4) * 10 + k).cast("long").alias("n"), G.box(x, y, x + 0.1, y + 0.12).alias("box"), "l_returnflag")
    return lines, rows.where("l_returnflag = 'R'").select("doc_id", "page", F.col("n").alias("block"), "box"), rows.drop("l_returnflag")


_PAGE_LIST = "[" + ", ".join(f"'{w}'" for w in PAGE_WORDS) + "]"
_FRAGMENT_LIST = "[" + ", ".join(f"'{w}'" for w in FRAGMENTS) + "]"


@query(f"""with w as (select l_orderkey // 4 as doc_id, l_orderkey % 4 as block, l_linenumber as line, ({_PAGE_LIST})[l_partkey % {len(PAGE_WORDS)} + 1] as text, (l_orderkey % 4) * 0.2403 as py, (l_linenumber - 1) * 0.1301 as px, l_returnflag = 'R' as shown,
    l_linenumber * 20 / 300 as x0, ((l_orderkey % 4) * 10 + case when l_orderkey % 8 > 3 then 30 else 0 end) / 100 as y0 from lineitem),
v as (select *, (line * 20 + length(text) * 4) / 300 as x1, y0 + 0.095 as y1 from w),
t as (select doc_id, block, string_agg(text, chr(10) order by line, text) as text, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, sum(length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'))) + 0 as own from v group by doc_id, block),
s as (select *, length(trim(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'))) as chars from t),
e as (select doc_id, block, string_agg(text, ' ' order by line, text) as text, min(x0) as x0 from v where list_contains({_FRAGMENT_LIST}, text) group by doc_id, block having count(*) > 1),
g as (select v.doc_id, v.block, v.line, v.px, count(s.block) as blocks, coalesce(sum(s.chars), 0) as chars from (select distinct doc_id, block, line, px, py from v) v left join s on s.doc_id = v.doc_id and (s.x0 + s.x1) / 2 between v.px - 0.01 and least(1, v.px + 0.1) + 0.01 and (s.y0 + s.y1) / 2 between greatest(0, v.py - 0.01) and least(1, v.py + 0.12) + 0.01 group by v.doc_id, v.block, v.line, v.px),
p as (select doc_id, 'image' as kind, 0 as late, block * 10 + line as place, px as x0, null as blocks, null as chars from v where shown union all select doc_id, 'vector', 1, block * 10 + line, px, blocks, chars from g where not (blocks >= 4 and chars >= 28))
select doc_id, 'text' as kind, row_number() over (partition by doc_id order by block) - 1 as n, round(x0, 6) as x0, text, null as text_blocks, null as text_chars from s
union all select doc_id, 'equation_line', row_number() over (partition by doc_id order by block) - 1, round(greatest(0, x0 - 0.004), 6), text, null, null from e
union all select doc_id, kind, row_number() over (partition by doc_id order by late, place) - 1, round(x0, 6), null, blocks::bigint, chars::bigint from p""")
def page_regions(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks, equation lines, pictures and drawings of pages."""
    found = regions.regions(*raw_page(spark, d))
    return found.select("doc_id", "kind", "n", F.round("box.x0", 6).alias("x0"), "text", "text_blocks", "text_chars")


def picture_books(spark: SparkSession, d: str) -> DataFrame:
    """path, content: a workbook for each document, with a row for every line and, on every third, a picture of what the line says; every ninth hangs on no cell."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))

    def book(said: list[str]) -> bytes:
        placed = [(None, None, f"p{k}.png", x.encode()) if k % 9 == 0 else (k, k % 4, f"p{k}.png", x.encode()) for k, x in enumerate(said) if k % 3 == 0]
        return xlsx.pictured(xlsx.workbook_parts([(k, x) for k, x in enumerate(said)]), placed)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((path.as_py(), book(lines.as_py())) for batch in batches for path, lines in zip(*batch.columns, strict=True))
        return docx.in_batches(made, MADE)

    rows = rows.repartition(heavy_tasks(spark), "path")  # a split has many documents, each costly
    return rows.mapInArrow(build, "path string, content binary")


@query(f"""with {LINES_SQL} select doc_id::varchar as path, 'ALT Management' as sheet, (k // 3 + 1)::int as picture, case when k % 9 = 0 then 999999 else k end::int as row, case when k % 9 = 0 then 999999 else k % 4 end::int as col,
    'xl/media/p' || k || '.png' as part, md5(line) as digest from l where k % 3 = 0""")
def workbook_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Pictures written to workbooks and read again, with the cells that they hang on."""
    found = xlsx.pictures(picture_books(spark, d))
    return found.select("path", "sheet", "picture", "row", "col", "part", F.md5("content").alias("digest"))

"""The registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from quillspark.functions import colour, text
from quillspark.functions import geometry as G
from quillspark.functions.math_words import integer_words
from quillspark.functions import visual
from quillspark.operators import closure, contrast, folds, generation, inventory, ordered, spatial
from quillspark.plans import compare
from quillspark.plans.views import BOXES_SQL, COLOURS_SQL, EDITS_SQL, ELEMENTS_SQL, ITEMS_SQL, NODES_SQL, boxes, colours, edits, elements, items, nodes
from quillspark.session import TASK_ROWS, heavy_tasks, table

#: Examples that are sent to every task; more are shuffled.
BROADCAST_EXAMPLES = 50_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
COUNTS_SQL = """count(*) as total_items, count(*) filter (where role = 'image') as images, count(*) filter (where role = 'equation') as equations, count(*) filter (where has_alt_text) as with_alt_text,
    count(*) filter (where trim(generated_alt_text) <> '') as generated_alt_text, count(*) filter (where trim(alt_text) <> '') as with_effective_alt_text, count(*) - count(*) filter (where trim(alt_text) <> '') as without_alt_text"""


@query(f"with {ITEMS_SQL} select {COUNTS_SQL} from items")
def inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    return inventory.summarize(items(spark, d))


@query(f"with {ITEMS_SQL} select source, {COUNTS_SQL} from items group by source")
def inventory_by_source(spark: SparkSession, d: str) -> DataFrame:
    return inventory.summarize(items(spark, d), "source")


@query(f"with {ITEMS_SQL} select source, role, count(*) as n, grouping(source, role)::int as level from items group by rollup (source, role)")
def role_histogram(spark: SparkSession, d: str) -> DataFrame:
    return inventory.role_histogram(items(spark, d), "source")


@query(f"with {ITEMS_SQL} select id, role, source from items where role = 'image' and trim(coalesce(nullif(alt_text, ''), nullif(generated_alt_text, ''), nullif(existing_alt_text, ''), '')) <> '' and contains(lower(alt_text), 'ing the')")
def filter_with_alt_and_search(spark: SparkSession, d: str) -> DataFrame:
    return inventory.visible(items(spark, d), "image", "with-alt", "ing the").select("id", "role", "source")


@query(f"with {ITEMS_SQL} select id, role, source from items where trim(coalesce(nullif(alt_text, ''), nullif(generated_alt_text, ''), nullif(existing_alt_text, ''), '')) = ''")
def filter_without_alt(spark: SparkSession, d: str) -> DataFrame:
    return inventory.visible(items(spark, d), alt="without-alt").select("id", "role", "source")


@query(f"""with {ITEMS_SQL}, {EDITS_SQL}, last as (select item_id, arg_max(coalesce(text, ''), seq) as text from edits group by item_id),
t as (select i.id, {COLLAPSE.format('i.existing_alt_text')} as existing, l.item_id is not null as edited, case when l.item_id is null then i.alt_text else {COLLAPSE.format('l.text')} end as alt_text, i.alt_source from items i left join last l on i.id = l.item_id)
select id, edited, sha1(alt_text) as alt_sha1, case when not edited then alt_source when alt_text = existing then case when existing <> '' then 'existing' else 'missing' end when alt_text <> '' then 'manual' else 'missing' end as alt_source from t""")
def edit_overlay_last_write(spark: SparkSession, d: str) -> DataFrame:
    return inventory.overlay(items(spark, d), edits(spark, d)).select("id", "edited", F.sha1("alt_text").alias("alt_sha1"), "alt_source")


@query(f"""with {ITEMS_SQL}, t as (select id, role, alt_text, ((length(alt_text) - length(replace(alt_text, ' the ', ''))) / 5)::bigint as n from items)
select id, case when role = 'image' then n else 0 end::bigint as replaced, sha1(case when role = 'image' and n > 0 then {COLLAPSE.format("replace(alt_text, ' the ', ' this ')")} else alt_text end) as alt_sha1 from t""")
def replace_in_images(spark: SparkSession, d: str) -> DataFrame:
    return inventory.replace(items(spark, d), " the ", " this ", F.col("role") == "image").select("id", "replaced", F.sha1("alt_text").alias("alt_sha1"))


@query(f"with {ITEMS_SQL} select role, count(*) filter (where trim(alt_text) <> '') as cleared, count(*) as n from items group by role")
def clear_counts(spark: SparkSession, d: str) -> DataFrame:
    return inventory.clear(items(spark, d)).groupBy("role").agg(F.count_if("cleared").alias("cleared"), F.count("*").alias("n"))


@query(rf"""with s as (select doc_id, regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g') as t from documents)
select doc_id, sha1(trim(regexp_replace(t, '[^a-z0-9=+\-*/^().,:; ]', '', 'g'))) as alignment, sha1(trim(regexp_replace(regexp_replace(t, '[_`~|]', ' ', 'g'), '[^a-z0-9=+\-*/^().,:; ]', '', 'g'))) as comparison,
    sha1(trim(regexp_replace(t, '[^a-z0-9 ]', '', 'g'))) as style from s""")
def text_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    aligned = text.normal_for_alignment("text")
    return table(spark, d, "documents").select("doc_id", F.sha1(aligned).alias("alignment"), F.sha1(text.normal_for_comparison("text")).alias("comparison"), F.sha1(text.style_of_aligned(aligned)).alias("style"))


@query(f"with {ELEMENTS_SQL} select sha1({COLLAPSE.format('lower(text)')}) as fingerprint, count(*) as n, count(distinct doc_id) as docs from elements group by 1")
def element_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d).groupBy(text.fingerprint("text").alias("fingerprint")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(rf"""with {ELEMENTS_SQL}, t as (select doc_id, idx, text, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[_`~|]', ' ', 'g'), '[^a-z0-9=+\-*/^().,:; ]', '', 'g')) as n from elements),
u as (select *, {' + '.join(f"contains(n, '{x}')::int" for x in text.EQUATION_SIGNS)} as signs, length(regexp_replace(n, '[^0-9]', '', 'g')) as digits from t)
select doc_id, count(*) filter (where length(trim(text)) >= 5 and (idx % 4 = 0 or (idx % 41) / 40 between 0.05 and 0.95)) as valid, count(*) filter (where signs >= 3 or (signs >= 2 and digits >= 2)) as equations,
    count(*) filter (where regexp_matches(trim(text), '^(?:[0-9]+[.)]|[a-zA-Z][.)]|[ivxlcdmIVXLCDM]+\.)(?:$|\s+)')) as list_items,
    count(*) filter (where trim(replace(replace({COLLAPSE.format('text')}, '"', ''), '''', '')) = '') as empty from u group by doc_id""")
def element_predicates(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d).groupBy("doc_id").agg(
        F.count_if(text.is_valid_paragraph("text", F.when(F.col("idx") % 4 != 0, F.col("idx") % 41 / 40))).alias("valid"),
        F.count_if(text.is_equation_like("text")).alias("equations"),
        F.count_if(text.is_list_item("text")).alias("list_items"),
        F.count_if(text.is_effectively_empty("text")).alias("empty"),
    )


@query()
def numerals(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, d, "part").select(n, text.roman(n % 4000).alias("roman"), text.column_letters(n).alias("letters"), text.roman_to_number(text.roman(n % 4000)).cast("long").alias("from_roman"), F.when(n > 0, text.letters_to_number(text.column_letters(n))).alias("from_letters"), integer_words(n * 7919).alias("words"))


@query("""with w as (select l_orderkey, l_linenumber, l_quantity * 5 as w, l_quantity * (l_linenumber + 1) as h from lineitem)
select l_orderkey, l_linenumber, case when w * h <= 1800 and greatest(w, h) <= 72 then 'small' when w * h <= 12000 and greatest(w, h) <= 180 then 'medium' else 'large' end as size_class from w""")
def size_classes(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.size_class_of_points(q * 5, q * (F.col("l_linenumber") + 1)).alias("size_class"))


@query(f"with {BOXES_SQL} select page, count(*) as n, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from boxes group by page")
def box_unions(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).groupBy("page").agg(F.count("*").alias("n"), G.union(F.col("bbox")).alias("b")).select("page", "n", "b.*")


@query(f"""with {BOXES_SQL}, p as (select *, lag(x0) over w as px0, lag(y0) over w as py0, lag(x1) over w as px1, lag(y1) over w as py1 from boxes window w as (partition by page order by n, l_partkey, l_suppkey))
select page, n, l_partkey, l_suppkey, round(greatest(0, least(x1, px1) - greatest(x0, px0)) * greatest(0, least(y1, py1) - greatest(y0, py0)), 9) as shared, round(greatest(x0 - px1, px0 - x1, y0 - py1, py0 - y1, 0), 9) as gap,
    not (x1 < px0 or px1 < x0 or y1 < py0 or py1 < y0) as meets from p where px0 is not null""")
def box_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = boxes(spark, d)
    rows = rows.withColumn("last", ordered.before("bbox", ["page"], ["n", "l_partkey", "l_suppkey"])).where("last is not null")
    a, b = F.col("bbox"), F.col("last")
    return rows.select("page", "n", "l_partkey", "l_suppkey", F.round(G.intersection_area(a, b), 9).alias("shared"), F.round(G.gap(a, b), 9).alias("gap"), G.intersects(a, b).alias("meets"))


@query(f"""with {BOXES_SQL}, t as (select page * 100 + n as table_id, * from boxes where l_returnflag = 'R'), i as (select page, x0, y0, x1, y1 from boxes where l_returnflag <> 'R'),
m as (select table_id, count(*) as k, min(i.x0) as x0, min(i.y0) as y0, max(i.x1) as x1, max(i.y1) as y1 from t join i on t.page = i.page and (i.x0 + i.x1) / 2 between greatest(0, t.x0 - 0.08) and least(1, t.x1 + 0.08) and (i.y0 + i.y1) / 2 between greatest(0, t.y0 - 0.08) and least(1, t.y1 + 0.08) group by table_id)
select t.table_id, t.page, coalesce(k, 0) as n_images, least(t.x0, coalesce(m.x0, t.x0)) as x0, least(t.y0, coalesce(m.y0, t.y0)) as y0, greatest(t.x1, coalesce(m.x1, t.x1)) as x1, greatest(t.y1, coalesce(m.y1, t.y1)) as y1 from t left join m on t.table_id = m.table_id""")
def images_in_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = boxes(spark, d)
    tables = rows.where("l_returnflag = 'R'").select((F.col("page") * 100 + F.col("n")).alias("table_id"), "page", "bbox")
    return spatial.grown_by_images(tables, rows.where("l_returnflag <> 'R'").select("page", "bbox")).select("table_id", "page", "n_images", "bbox.*")


@query(f"""with {BOXES_SQL}, r as (select page * 100 + n as row_id, page, (x0 + x1) / 2 as x, (y0 + y1) / 2 as y from boxes where l_returnflag <> 'N'),
f as (select page * 100 + n as formula_id, page, (x0 + x1) / 2 as x, (y0 + y1) / 2 as y, (l_suppkey % 10) / 10 as confidence from boxes where l_returnflag = 'N'),
s as (select row_id, formula_id, sqrt(pow(r.x - f.x, 2) + pow(r.y - f.y, 2)) + (1 - confidence) * 0.15 as cost from r join f on r.page = f.page),
b as (select row_id, formula_id, sqrt(pow(r.x - f.x, 2) + pow(r.y - f.y, 2)) + (1 - confidence) * 0.15 + 0.4 as cost from r join f on f.page = r.page - 1 or f.page = r.page + 1 where row_id not in (select row_id from s)),
u as (select * from s union all select * from b), k as (select *, row_number() over (partition by row_id order by cost, formula_id) as p from u)
select row_id, formula_id, round(cost, 9) as cost from k where p = 1""")
def nearest_formulas(spark: SparkSession, d: str) -> DataFrame:
    rows = boxes(spark, d).select((F.col("page") * 100 + F.col("n")).alias("id"), "page", G.centre_x(F.col("bbox")).alias("x"), G.centre_y(F.col("bbox")).alias("y"), ((F.col("l_suppkey") % 10) / 10).alias("confidence"), "l_returnflag")
    found = spatial.nearest_formula(rows.where("l_returnflag <> 'N'").withColumnRenamed("id", "row_id"), rows.where("l_returnflag = 'N'").withColumnRenamed("id", "formula_id"))
    return found.withColumn("cost", F.round("cost", 9))


def _luminance_sql(c: str) -> str:
    part = lambda k: f"(('0x' || substr({c}, {k}, 2))::int / 255)"
    lin = lambda x: f"(case when {x} <= 0.03928 then {x} / 12.92 else pow(({x} + 0.055) / 1.055, 2.4) end)"
    return f"(0.2126 * {lin(part(2))} + 0.7152 * {lin(part(4))} + 0.0722 * {lin(part(6))})"


@query(f"""with {COLOURS_SQL}, l as (select p_partkey, {_luminance_sql('colour')} as a, {_luminance_sql('ground')} as b from colours)
select p_partkey, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 6) as contrast, (greatest(a, b) + 0.05) / (least(a, b) + 0.05) < 4.5 as low from l""")
def contrast_ratios(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("colour"), F.col("ground")
    return colours(spark, d).select("p_partkey", F.round(colour.contrast(a, b), 6).alias("contrast"), colour.is_low_contrast(a, b).alias("low"))


@query()
def repaired_colours(spark: SparkSession, d: str) -> DataFrame:
    """Colours of too little contrast, and the nearest that has enough. A grid search with early exit: held against a plain version in tests."""
    a, b = F.col("colour"), F.col("ground")
    rows = colours(spark, d).repartition(heavy_tasks(spark))  # many small rows of a file that is few splits, each costly
    return rows.where(colour.is_low_contrast(a, b)).select("p_partkey", "colour", "ground", colour.accessible(a, b).alias("repaired"))


@query("""with k as (select *, case when l_partkey % 11 = 0 then null else l_partkey % 500 end as key from lineitem),
r as (select *, row_number() over (partition by key order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) as p from k) select l_orderkey, l_linenumber, key from r where p = 1 or key is null""")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("key", F.when(F.col("l_partkey") % 11 == 0, None).otherwise(F.col("l_partkey") % 500))
    return ordered.dedupe_first(rows, F.col("key"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", "key")


@query("""with s as (select 0 as file_no, c_nationkey as sheet_no, row_number() over (partition by c_nationkey order by c_custkey) as row_no, c_name as c1 from customer union all
select 1, s_nationkey, row_number() over (partition by s_nationkey order by s_suppkey), s_name from supplier),
n as (select file_no, sheet_no, count(*) as k from s group by all), o as (select *, sum(k) over (order by file_no, sheet_no) - k as off from n)
select s.file_no, s.sheet_no, s.row_no, (off + s.row_no)::bigint as out_row, c1 from s join o on s.file_no = o.file_no and s.sheet_no = o.sheet_no""")
def union_of_sheets(spark: SparkSession, d: str) -> DataFrame:
    def sheet(name: str, file_no: int, nation: str, key: str, value: str) -> DataFrame:
        order = Window.partitionBy(nation).orderBy(key)
        return table(spark, d, name).select(F.lit(file_no).alias("file_no"), F.col(nation).alias("sheet_no"), F.row_number().over(order).cast("long").alias("row_no"), F.col(value).alias("c1"))

    rows = sheet("customer", 0, "c_nationkey", "c_custkey", "c_name").unionByName(sheet("supplier", 1, "s_nationkey", "s_suppkey", "s_name"))
    sheets = rows.groupBy("file_no", "sheet_no").agg(F.count("*").alias("n_rows"))
    return ordered.union_with_offsets(sheets, rows).select("file_no", "sheet_no", "row_no", "out_row", "c1")


@query("""with s as (select l_orderkey // 100 as file_no, l_orderkey % 100 as sheet_no, l_linenumber as n, l_partkey as k, l_suppkey as j from lineitem), z as (select file_no, sheet_no, max(n) + 2 as n_rows from s group by all),
o as (select *, sum(n_rows) over (order by file_no, sheet_no) - n_rows as off from z),
m as (select case k % 3 when 0 then 'merge' when 1 then 'row' else 'picture' end as kind, case when k % 6 <> 5 then off + n end as top, case when k % 3 <> 1 then j % 20 end as left_, case when k % 6 <> 5 then off + n + case when k % 3 = 0 then 1 else 0 end end as bottom, case when k % 3 <> 1 then j % 20 + 1 end as right_,
    case when k % 3 = 1 then (k % 40)::double end as size, coalesce(case when j % 5 > 0 then k % 7 = 0 and k % 3 = 1 end, false) as hidden from s join o using (file_no, sheet_no)),
c as (select unnest(range(j % 20 + 1, j % 20 + n + 1)) as left_, case when k % 4 > 0 then (k % 90)::double end as size, k % 97 = 0 and j % 3 = 0 as hidden from s)
select kind, top::bigint as top, left_::bigint as "left", bottom::bigint as bottom, right_::bigint as "right", size, hidden from m union all select 'column', null, left_, null, left_, max(size), bool_or(hidden) from c group by left_""")
def layout_of_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sheets of merged cells, rows of a height, pictures (some of which hang on no cell) and spans of columns, stacked below one another."""
    n, k, j = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 100).cast("long").alias("file_no"), (F.col("l_orderkey") % 100).alias("sheet_no"), n.cast("long").alias("n"), k.alias("k"), j.alias("j"))
    n, k, j = F.col("n"), F.col("k"), F.col("j")
    sheets = rows.groupBy("file_no", "sheet_no").agg((F.max("n") + 2).alias("n_rows"))
    kind, anchored = F.when(k % 3 == 0, "merge").when(k % 3 == 1, "row").otherwise("picture"), k % 6 != 5
    placed = rows.select(
        "file_no", "sheet_no", kind.alias("kind"), F.when(anchored, n).alias("top"), F.when(k % 3 != 1, j % 20).alias("left"), F.when(anchored, n + F.when(k % 3 == 0, 1).otherwise(0)).alias("bottom"), F.when(k % 3 != 1, j % 20 + 1).alias("right"),
        F.when(k % 3 == 1, (k % 40).cast("double")).alias("size"), F.when(j % 5 > 0, (k % 7 == 0) & (k % 3 == 1)).alias("hidden"),
    )
    none = F.lit(None).cast("long")
    spans = rows.select("file_no", "sheet_no", F.lit("column").alias("kind"), none.alias("top"), (j % 20 + 1).alias("left"), none.alias("bottom"), (j % 20 + n).alias("right"), F.when(k % 4 > 0, (k % 90).cast("double")).alias("size"), ((k % 97 == 0) & (j % 3 == 0)).alias("hidden"))
    return ordered.stacked_layout(sheets, placed.unionByName(spans))


@query("""with i as (select o_custkey as doc_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderkey) as pos, count(*) over (partition by o_custkey) as expected from orders),
s as (select o_custkey as doc_id, o_orderkey as row_no, case when o_custkey % 2 = 0 or o_orderkey % 3 > 0 then o_orderkey end as item_id, o_orderpriority as text from orders),
l as (select doc_id, item_id, arg_max(text, row_no) as by_id from s where item_id is not null group by all), k as (select doc_id, count(*) as ids from l group by doc_id),
p as (select doc_id, row_number() over (partition by doc_id order by row_no) as pos, text as by_place from s)
select i.doc_id, i.id, coalesce(case when coalesce(ids, 0) >= expected then by_id else by_place end, '') as alt_text from i left join k on k.doc_id = i.doc_id left join l on l.doc_id = i.doc_id and l.item_id = i.id left join p on p.doc_id = i.doc_id and p.pos = i.pos""")
def import_by_id_or_place(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    rows = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"))
    sheet = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("row_no"), F.when((F.col("o_custkey") % 2 == 0) | (F.col("o_orderkey") % 3 > 0), F.col("o_orderkey")).alias("item_id"), F.col("o_orderpriority").alias("text"))
    return inventory.import_texts(rows, sheet).select("doc_id", "id", "alt_text")


@query(f"""with recursive {NODES_SQL}, c(node, cur, steps, value) as (select node, node, 0, value from nodes union all select c.node, n.node, c.steps + 1, n.value from c join nodes p on p.node = c.cur join nodes n on n.node = p.parent where c.value is null)
select n.node, c.value, c.steps::bigint as steps from nodes n left join (select * from c where value is not null) c on c.node = n.node""")
def inherited_values(spark: SparkSession, d: str) -> DataFrame:
    return closure.along_chain(nodes(spark, d)).select("node", "value", "steps")


@query(f"""with recursive {NODES_SQL}, c(node, cur) as (select node, node from nodes union all select c.node, n.parent from c join nodes n on n.node = c.cur where n.parent is not null and n.parent in (select node from nodes))
select node, min(cur) as root from c group by node""")
def chain_roots(spark: SparkSession, d: str) -> DataFrame:
    return closure.along_chain(nodes(spark, d)).select("node", "root")


@query(f"""with recursive {NODES_SQL}, u(want, cur) as (select role, parent from nodes where parent is not null union select u.want, n.parent from u join nodes n on n.node = u.cur where n.role <> u.want and n.parent is not null)
select node, role from nodes where node not in (select cur from u join nodes n on n.node = u.cur where n.role = u.want)""")
def without_same_below(spark: SparkSession, d: str) -> DataFrame:
    return closure.without_same_below(nodes(spark, d)).select("node", "role")


ORDER = "l_linenumber, l_partkey, l_suppkey"


@query(f"""with s as (select *, l_partkey % 3 as level, count(*) filter (where l_partkey % 3 < 0) over w as s0, count(*) filter (where l_partkey % 3 < 1) over w as s1, count(*) filter (where l_partkey % 3 < 2) over w as s2 from lineitem window w as (partition by l_orderkey order by {ORDER}))
select l_orderkey, l_linenumber, l_partkey, level, row_number() over (partition by l_orderkey, level, case level when 0 then s0 when 1 then s1 else s2 end order by {ORDER})::bigint as counter from s""")
def list_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("level", F.col("l_partkey") % 3)
    return ordered.level_counters(rows, ["l_orderkey"], ORDER.split(", "), "level", 3).select("l_orderkey", "l_linenumber", "l_partkey", "level", F.col("counter").cast("long").alias("counter"))


@query(f"""with {ELEMENTS_SQL}, c as (select doc_id, idx, case when idx % 3 = 1 or idx % 7 = 2 then ' ' else text end as text from elements), e as (select doc_id, idx, trim(text) = '' as empty, (idx - row_number() over (partition by doc_id, trim(text) = '' order by idx)) as g from c)
select doc_id, min(idx) as first, count(*) as length, case when count(*) > 1 then 'double_empty_paragraph' else 'empty_paragraph' end as alert from e where empty group by doc_id, g""")
def empty_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of empty lines, of which some are made here."""
    cleared = F.when((F.col("idx") % 3 == 1) | (F.col("idx") % 7 == 2), " ").otherwise(F.col("text"))
    return ordered.empty_runs(elements(spark, d).withColumn("text", cleared), ["doc_id"], ["idx"])


REFLOW_SQL = """r as (select l_orderkey, l_linenumber, l_partkey, case when l_returnflag = 'N' then 'reflow-candidate' else 'content-change' end as classification, l_suppkey % 2 as lp, l_partkey % 2 as rp, l_discount <= l_tax as down, abs(l_discount - l_tax) as distance from lineitem)"""


@query(f"""with {REFLOW_SQL}, f as (select *, case when classification = 'reflow-candidate' and lag(classification) over w = 'reflow-candidate' and lag(lp) over w = lp and lag(rp) over w = rp and lag(down) over w = down then 0 else 1 end as fresh from r window w as (partition by l_orderkey order by l_linenumber, l_partkey)),
g as (select *, sum(fresh) over (partition by l_orderkey order by l_linenumber, l_partkey) as island from f)
select l_orderkey, min(l_linenumber)::int as l_linenumber, count(*) as span, round(max(distance), 6) as distance, case when min(classification) <> 'reflow-candidate' then min(classification) when count(*) > 1 then 'reflow' else 'layout-shift' end as classification from g group by l_orderkey, island""")
def reflow_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "N", "reflow-candidate").otherwise("content-change").alias("classification"), (F.col("l_suppkey") % 2).alias("left_page"), (F.col("l_partkey") % 2).alias("right_page"), F.col("l_discount").alias("left_y"), F.col("l_tax").alias("right_y"), F.abs(F.col("l_discount") - F.col("l_tax")).alias("distance"))
    return ordered.collapse_reflow(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "span", F.round("distance", 6).alias("distance"), "classification")


@query(f"""with s as (select *, case when lag(l_returnflag) over w = l_returnflag then 0 else 1 end as fresh from lineitem window w as (partition by l_orderkey order by {ORDER})),
g as (select *, sum(fresh) over (partition by l_orderkey order by {ORDER}) as island from s)
select l_orderkey, min(l_returnflag) as l_returnflag, string_agg(l_linestatus, '' order by {ORDER}) as l_linestatus, count(*) as fragments from g group by l_orderkey, island""")
def merged_fragments(spark: SparkSession, d: str) -> DataFrame:
    return ordered.merge_runs(table(spark, d, "lineitem"), ["l_orderkey"], ORDER.split(", "), "l_returnflag", "l_linestatus").select("l_orderkey", "l_returnflag", "l_linestatus", "fragments")


@query(f"""with {BOXES_SQL}, f as (select *, max(y1) over (partition by page order by y0, n, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding) as reach from boxes)
select page, n, l_partkey, l_suppkey, (sum(case when reach is null or y0 - reach > 0.1 then 1 else 0 end) over (partition by page order by y0, n, l_partkey, l_suppkey))::bigint as cluster from f""")
def line_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = boxes(spark, d).select("page", "n", "l_partkey", "l_suppkey", "bbox.y0", "bbox.y1")
    return ordered.gap_clusters(rows, ["page"], "y0", "y1", 0.1, "n", "l_partkey", "l_suppkey").select("page", "n", "l_partkey", "l_suppkey", "cluster")


TURNS_SQL = "t as (select conv_id, turn, case when length(text) % 3 = 0 then length(text) end as page from conversations)"


@query(f"""with {TURNS_SQL}, c as (select a.conv_id, a.turn, b.page, row_number() over (partition by a.conv_id, a.turn order by abs(a.turn - b.turn), b.turn) as p from t a join t b on a.conv_id = b.conv_id and b.page is not null)
select t.conv_id, t.turn, c.page as nearest from t left join c on c.conv_id = t.conv_id and c.turn = t.turn and p = 1""")
def nearest_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.length("text") % 3 == 0, F.length("text").cast("long")).alias("page"))
    return ordered.nearest_filled(rows, ["conv_id"], "turn", "page", "nearest").select("conv_id", "turn", "nearest")


@query("""with t as (select conv_id, turn, length(text) as page, row_number() over (partition by conv_id order by turn) as n, length(text) % 3 = 0 as good from conversations),
c as (select a.conv_id, a.turn, b.page, row_number() over (partition by a.conv_id, a.turn order by abs(a.n - b.n), b.n) as p from t a join t b on a.conv_id = b.conv_id and b.good and a.n <> b.n and abs(a.n - b.n) <= 6)
select t.conv_id, t.turn, c.page as neighbour from t left join c on c.conv_id = t.conv_id and c.turn = t.turn and p = 1""")
def neighbours_within_six(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("page"))
    return ordered.neighbour_within(rows, ["conv_id"], "turn", F.col("page") % 3 == 0, "page", 6, "neighbour").select("conv_id", "turn", "neighbour")


@query(f"""with {TURNS_SQL} select conv_id, turn, last_value(page ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as previous, first_value(page ignore nulls) over (partition by conv_id order by turn rows between 1 following and unbounded following) as next from t""")
def filled_between(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.length("text") % 3 == 0, F.length("text").cast("long")).alias("page"))
    return ordered.fill_between(rows, ["conv_id"], ["turn"], "page").select("conv_id", "turn", "previous", "next")


@query("""with m as (select l_orderkey, coalesce(median(l_extendedprice), 0) as med from lineitem group by l_orderkey) select l.l_orderkey, l_linenumber, l_partkey from lineitem l join m on m.l_orderkey = l.l_orderkey where l_extendedprice < 1.5 * med""")
def median_filter(spark: SparkSession, d: str) -> DataFrame:
    return ordered.without_outliers(table(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice", 1.5).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""with f as (select l_orderkey, lower(l_returnflag || l_linestatus) as k, min((l_linenumber, l_returnflag || l_linestatus)) as f from lineitem group by all)
select l_orderkey, string_agg(f[2], ',' order by f) as fonts from f group by l_orderkey""")
def ordered_fonts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("font"))
    return ordered.ordered_distinct(rows, ["l_orderkey"], "font", "l_linenumber").select("l_orderkey", F.array_join("values", ",").alias("fonts"))


TOKENS = r"list_distinct(regexp_extract_all(lower(trim(regexp_replace({}, '\s+', ' ', 'g'))), '[a-z0-9]+'))"


@query(f"""with p as (select p_partkey, p_brand, {TOKENS.format("p_type || ' ' || p_name")} as t from part), e as (select p_brand, p_type, min(p_partkey) as pos from part group by all), x as (select *, {TOKENS.format('p_type')} as u from e),
s as (select p_partkey, p_type, pos, len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) + least(len(u), 20) / 100 as score from p join x on p.p_brand = x.p_brand), k as (select *, row_number() over (partition by p_partkey order by score desc, pos) as place from s)
select p_partkey, p_type as example, round(score, 9) as score, place::int as place from k where place <= 3""")
def style_examples_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three most alike examples of the same source, for each candidate: Jaccard of tokens and a small bonus for length."""
    part = table(spark, d, "part")
    candidates = part.select("p_partkey", "p_brand", text.tokens(F.concat_ws(" ", "p_type", "p_name")).alias("t"))
    bank = part.groupBy("p_brand", F.col("p_type").alias("example")).agg(F.min("p_partkey").alias("pos")).withColumn("u", text.tokens("example"))
    pairs = candidates.groupBy("p_brand").count().join(bank.groupBy("p_brand").agg(F.count("*").alias("examples")), "p_brand").agg(F.sum(F.col("count") * F.col("examples")).alias("n"), F.sum("examples").alias("examples")).first()
    tasks = max(heavy_tasks(spark), -(-(pairs["n"] or 0) // TASK_ROWS))  # a task ranks as many pairs however many candidates there are
    if (pairs["examples"] or 0) <= BROADCAST_EXAMPLES:  # else a source's candidates meet in one task
        bank = F.broadcast(bank)
    scored = candidates.repartition(tasks, "p_partkey").join(bank, "p_brand").withColumn("score", text.jaccard(F.col("t"), F.col("u")) + F.least(F.size("u"), F.lit(20)) / 100)
    return ordered.top_per_key(scored, ["p_partkey"], F.col("score"), 3, "pos").select("p_partkey", "example", F.round("score", 9).alias("score"), "place")


@query()
def compare_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: every conversation of an even number compared with the next one, turn by turn: ordered alignment, differences, reflow runs."""
    turns = table(spark, d, "conversations")
    rows = turns.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair"), (F.col("conv_id") % 2).cast("int").alias("side"), F.col("turn").alias("idx"), "text", F.col("role"), ((F.col("turn") % 7 + 1) / 10).alias("y_norm"), F.lit(0.1).alias("x_norm"), F.floor(F.col("turn") / 7).cast("int").alias("page"))
    return compare.compare(rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side"))


@query("""with s as (select event_id, user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as k from s) select user_id, min(ts) as first, count(*) as n, max(event_id) as last_event from g group by user_id, k""")
def autosave_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Edits of a user that follow within 30 minutes are saved once: session windows, as the stream job in streaming/ makes them."""
    events = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    sessions = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("first"), F.count("*").alias("n"), F.max("event_id").alias("last_event"))
    return sessions.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), "n", "last_event")


@query(rf"""with {ELEMENTS_SQL} select doc_id, idx, case when regexp_matches(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '\b(?:answers?|chapter|section|exercise|problem|review|solutions?|cont)\b') and regexp_matches(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '^[0-9]+(?:[-.][0-9]+)*\b') then false
    when idx % 3 = 0 then true when idx % 3 = 1 then length(text) % 2 = 0 or length(trim(text)) > 0 and length(text) % 5 = 0 else idx % 4 > 0 end as real from elements""")
def real_items(spark: SparkSession, d: str) -> DataFrame:
    """Lines as elements: images with a target, images with a width at most (kept if it shows), and formulas of which some have no visual node."""
    rows = elements(spark, d)
    k, n = F.col("idx") % 3, F.length("text")
    none = F.lit(None).cast("string")
    m = F.struct(
        F.when(k == 0, "word/media/a.png").alias("target"), none.alias("image_target"), none.alias("ole_target"), F.when((k == 1) & (n % 2 == 0), "rId1").alias("rel_id"),
        F.when(((k == 1) & ((n % 2 == 0) | (n % 5 == 0) & (F.trim("text") != ""))) | (k == 0), "Picture").alias("docpr_name"), none.alias("prog_id"), F.when((k == 2) & (F.col("idx") % 4 == 0), "omml").alias("math_source"),
        F.when(k == 2, 10.0).alias("width_pt"), F.when(k == 2, 10.0).alias("height_pt"),
    )
    role = F.when(k == 2, "equation").otherwise("image")
    return rows.select("doc_id", "idx", visual.is_real_item(role, F.col("text"), F.lit(False), m).alias("real"))


@query(f"""with {BOXES_SQL}, b as (select page, n, l_partkey, l_suppkey, x0 * 612 as x0, y0 * 792 as y0, x1 * 612 as x1, y1 * 792 as y1 from boxes), a as (select *, (x1 - x0) * (y1 - y0) as area from b), m as (select page, coalesce(median(area), 0) as med from a where area > 0 group by page)
select a.page, n, l_partkey, l_suppkey from a join m on m.page = a.page where not ((y1 - y0 <= 6 and x1 - x0 >= 612 * 0.45) or (x1 - x0 <= 6 and y1 - y0 >= 792 * 0.28)) and not (med > 0 and area >= med * 18 and x1 - x0 >= 612 * 0.55 and y1 - y0 >= 792 * 0.4)""")
def figure_paint(spark: SparkSession, d: str) -> DataFrame:
    """Painted boxes without rules and frames, by the median area of their page."""
    rows = boxes(spark, d)
    b = F.col("bbox")
    rows = rows.withColumn("bbox", G.box(b["x0"] * 612, b["y0"] * 792, b["x1"] * 612, b["y1"] * 792)).withColumn("area", G.area(b))
    medians = rows.where("area > 0").groupBy("page").agg(F.coalesce(F.median("area"), F.lit(0.0)).alias("med"))
    w, h = F.lit(612.0), F.lit(792.0)
    return rows.join(medians, "page").where(~visual.is_rule(b, w, h) & ~visual.is_frame(b, F.col("med"), w, h)).select("page", "n", "l_partkey", "l_suppkey")


@query(f"""with {ITEMS_SQL}, l as (select * from items where trim(alt_text) = ''), s as (select source, avg(case when role = 'equation' then 1.0 else 0.0 end) >= 0.4 as small from l group by source),
n as (select l.source, id, row_number() over (partition by l.source order by id) - 1 as at_, case when small then 6 else 24 end as size from l join s on s.source = l.source)
select source, id, (at_ // size)::bigint as batch, (at_ % size + 1)::int as number from n""")
def generation_batches(spark: SparkSession, d: str) -> DataFrame:
    return generation.batches(items(spark, d)).select("source", "id", "batch", "number")


@query(f"""with {ITEMS_SQL}, l as (select * from items where trim(alt_text) = ''), s as (select source, avg(case when role = 'equation' then 1.0 else 0.0 end) >= 0.4 as small from l group by source),
n as (select l.source, id, role, row_number() over (partition by l.source order by id) - 1 as at_, case when small then 6 else 24 end as size from l join s on s.source = l.source)
select source, id, upper(role[1]) || role[2:] || ' ' || (at_ % size + 1)::varchar || ': item of ' || source as text from n""")
def generated_texts(spark: SparkSession, d: str) -> DataFrame:
    """Missing texts from answers that are kept as a table, one for each batch: fenced JSON that names its items by number, with the openings and quotes that come with it."""
    rows = items(spark, d)
    said = F.concat(F.lit('"Alt text: This image shows '), F.initcap("role"), F.lit(" "), F.col("number").cast("string"), F.lit(": item of "), "source", F.lit('"'))
    asked = generation.batches(rows).select("source", "batch", F.struct("number", said.alias("alt_text")).alias("x"))
    answers = asked.groupBy("source", "batch").agg(F.concat(F.lit("```json\n"), F.to_json(F.struct(F.sort_array(F.collect_list("x")).alias("items"))), F.lit("\n```")).alias("said"))
    return generation.accepted(rows, answers)


@query()
def list_runs(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as typed list items; a fold, held against plain cases in tests."""
    n = F.col("l_linenumber")
    marker = F.when(F.col("l_returnflag") == "N", F.concat(n.cast("string"), F.lit(". x"))).when(F.col("l_returnflag") == "R", F.concat(F.lit("("), F.lower(F.char((96 + n).cast("int"))), F.lit(") x"))).otherwise("plain")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(_lines()).cast("long").alias("idx"), marker.alias("text"), F.lit(False).alias("numbered"))
    return folds.list_runs(rows)


def _lines() -> WindowSpec:
    return Window.partitionBy("l_orderkey").orderBy(*ORDER.split(", "))


@query()
def grown_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Boxes clustered by growing unions; order-dependent, held against a plain version in tests."""
    rows = boxes(spark, d).select("page", F.row_number().over(_pages()).cast("long").alias("n"), "bbox.*")
    return folds.grown_clusters(rows, 0.05, 0.05)


def _pages() -> WindowSpec:
    return Window.partitionBy("page").orderBy("n", "l_partkey", "l_suppkey")


@query()
def matched_targets(spark: SparkSession, d: str) -> DataFrame:
    """Order lines matched greedily, tier by tier, with those of the next customer order; a fold, held against plain cases in tests."""
    rows = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 2).cast("long").alias("doc_id"), (F.col("l_orderkey") % 2).alias("side"), F.row_number().over(_lines()).cast("long").alias("pos"), F.when(F.col("l_returnflag") == "N", "equation").otherwise("image").alias("role"), F.col("l_linestatus").alias("source_part"), F.array(F.concat(F.lit("/word/media/"), (F.col("l_partkey") % 5).cast("string"))).alias("names"))
    return folds.match_targets(rows.where("side = 0"), rows.where("side = 1"))


@query()
def filled_previews(spark: SparkSession, d: str) -> DataFrame:
    """Turns without a place get one from their neighbours, each from those filled before it; a fold, held against plain cases in tests."""
    turn = F.col("turn")
    known = F.length("text") % 3 > 0
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), turn.alias("idx"), F.when(known, "text").otherwise("empty").alias("role"), F.when(known, F.floor(turn / 5).cast("long")).alias("page"), F.when(known, (turn % 5) / 5).alias("y0"), F.when(known, (turn % 5) / 5 + 0.1).alias("y1"))
    return folds.filled_previews(rows)


@query("""with recursive st as (select p_partkey as id, case when p_partkey >= 3 then p_partkey // 3 end as base, case when p_partkey % 5 = 1 then printf('%06X', p_partkey * 2654435 % 16777216) end as color, case when p_partkey % 7 = 2 then printf('%06X', p_partkey * 7919 % 16777216) end as shading from part),
cc(id, cur, v) as (select id, base, color from st union all select cc.id, st.base, st.color from cc join st on st.id = cc.cur where cc.v is null),
gg(id, cur, v) as (select id, base, shading from st union all select gg.id, st.base, st.shading from gg join st on st.id = gg.cur where gg.v is null),
r as (select l_orderkey, l_linenumber, l_partkey, case when l_linenumber % 4 = 0 then printf('%06X', l_suppkey * 104729 % 16777216) end as color, case when l_suppkey % 9 = 0 then 'yellow' when l_suppkey % 9 = 1 then 'darkBlue' end as highlight,
    case when l_partkey % 2 = 0 then l_partkey end as rs, case when l_partkey % 3 > 0 then l_suppkey end as ps from lineitem)
select l_orderkey, l_linenumber, l_partkey, coalesce(r.color, cv.v, '000000') as effective_color, coalesce(case highlight when 'yellow' then 'FFFF00' when 'darkBlue' then '00008B' end, ga.v, gb.v, 'FFFFFF') as ground
from r left join (select id, v from cc where v is not null) cv on cv.id = coalesce(rs, ps) left join (select id, v from gg where v is not null) ga on ga.id = rs left join (select id, v from gg where v is not null) gb on gb.id = ps""")
def effective_colours(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as runs, parts as styles that inherit."""
    code = lambda n, k: F.lpad(F.hex(n * k % 16777216), 6, "0")
    k = F.col("p_partkey")
    styles = table(spark, d, "part").select(F.lit(1).alias("doc_id"), k.alias("style_id"), F.when(k >= 3, F.floor(k / 3).cast("long")).alias("based_on"), F.when(k % 5 == 1, code(k, 2654435)).alias("color"), F.when(k % 7 == 2, code(k, 7919)).alias("shading"))
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    none = F.lit(None).cast("string")
    runs = table(spark, d, "lineitem").select(F.lit(1).alias("doc_id"), "l_orderkey", "l_linenumber", "l_partkey", F.when(n % 4 == 0, code(s, 104729)).alias("color"), F.when(s % 9 == 0, "yellow").when(s % 9 == 1, "darkBlue").alias("highlight"), none.alias("shading"), none.alias("nested_shading"), F.when(p % 2 == 0, p).alias("run_style"), F.when(p % 3 > 0, s).alias("para_style"), F.lit(None).cast("long").alias("table_style"))
    return contrast.effective(runs, styles).select("l_orderkey", "l_linenumber", "l_partkey", "effective_color", "ground")

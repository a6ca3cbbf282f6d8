"""Views of the driver's tables that stand in for a document collection's: whole tables, whole texts, plain arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.session import table


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.coalesce("text", F.lit("")))
    generated = F.when(F.col("doc_id") % 5 == 0, F.concat_ws(" ", F.lit("text in"), "lang", F.lit("from"), "source")).otherwise("")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.when(F.col("doc_id") % 3 == 0, "equation").otherwise("image").alias("role"), existing.alias("existing_alt_text"), generated.alias("generated_alt_text"))
    given = F.col("existing_alt_text") != ""
    return rows.select("*", F.when(given, F.col("existing_alt_text")).otherwise(F.col("generated_alt_text")).alias("alt_text"), given.alias("has_alt_text"), F.when(given, "existing").otherwise("missing").alias("alt_source"))


ITEMS_SQL = """items as (select *, case when existing_alt_text <> '' then existing_alt_text else generated_alt_text end as alt_text, existing_alt_text <> '' as has_alt_text,
    case when existing_alt_text <> '' then 'existing' else 'missing' end as alt_source from (
    select doc_id as id, source, case when doc_id % 3 = 0 then 'equation' else 'image' end as role, case when doc_id % 4 = 0 then '' else coalesce(text, '') end as existing_alt_text,
    case when doc_id % 5 = 0 then concat_ws(' ', 'text in', lang, 'from', source) else '' end as generated_alt_text from documents))"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "click", "").when(F.col("event_type") == "view", F.concat(F.lit("view  of "), F.col("user_id").cast("string"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("item_id"), F.col("event_type").alias("action"), text.alias("text"), "ts")


EDITS_SQL = """edits as (select event_id as seq, user_id as item_id, event_type as action, case event_type when 'click' then '' when 'view' then 'view  of ' || user_id::varchar else props end as text from events)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document, with their place."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "text")).select("doc_id", F.col("idx").cast("long").alias("idx"), "text")


ELEMENTS_SQL = """elements as (select doc_id, i - 1 as idx, lines[i] as text from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents)))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each order line, on the page of its order."""
    x0, y0 = (F.col("l_partkey") % 80) / 100, (F.col("l_suppkey") % 70) / 100
    box = G.box(x0, y0, x0 + F.col("l_quantity") / 300, y0 + (F.col("l_linenumber") % 5 + 1) / 30)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("n"), "l_partkey", "l_suppkey", "l_returnflag", box.alias("bbox"))


BOXES_SQL = """boxes as (select l_orderkey as page, l_linenumber::bigint as n, l_partkey, l_suppkey, l_returnflag, (l_partkey % 80) / 100 as x0, (l_suppkey % 70) / 100 as y0,
    (l_partkey % 80) / 100 + l_quantity / 300 as x1, (l_suppkey % 70) / 100 + (l_linenumber % 5 + 1) / 30 as y1 from lineitem)"""


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda k: F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") * k % 16777216), 6, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", code(2654435).alias("colour"), F.when(F.col("p_size") % 2 == 0, "#FFFFFF").otherwise(code(7919)).alias("ground"))


COLOURS_SQL = """colours as (select p_partkey, p_brand, '#' || printf('%06X', p_partkey * 2654435 % 16777216) as colour, case when p_size % 2 = 0 then '#FFFFFF' else '#' || printf('%06X', p_partkey * 7919 % 16777216) end as ground from part)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree over the parts: i hangs below i div 3."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("node"), F.when(k >= 3, F.floor(k / 3).cast("long")).alias("parent"), F.when(k % 7 == 0, F.col("p_brand")).alias("value"), F.concat(F.lit("role"), (k % 5).cast("string")).alias("role"))


NODES_SQL = """nodes as (select p_partkey as node, case when p_partkey >= 3 then p_partkey // 3 end as parent, case when p_partkey % 7 = 0 then p_brand end as value, 'role' || (p_partkey % 5)::varchar as role from part)"""


#: Phrases that texts of the view are made of.
OPENING_PHRASES = ("x squared equals", "The chart shows", "Equation showing", "see page 4", "a over b", "1/2 + 3", "IBM = ABC", "the square root of y", "comma open brace", "Photo of a red-brick house", "y2 - 3", "", "answers explain why")
MIDDLE_PHRASES = ("is greater than", "equals", "plus the numerator", "and 12.5", "frequency of rows", "close parenthesis ellipsis", "x - y = 7", "with the legend", "divided by", "12 - 3", "?")
CLOSING_PHRASES = ("times z.", "three cubed", "in each case!", "(graph)", "a b c d e f g", "from New York to Paris", "ABC")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts about formulas and pictures: item, grp (six candidates or so of one thing), role, page, text."""
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    text = F.concat_ws(" ", pick(OPENING_PHRASES, k), pick(MIDDLE_PHRASES, k), pick(CLOSING_PHRASES, k), F.when(k % 17 == 0, F.repeat(F.lit("word "), 20)).otherwise(""))
    role = F.when(k % 3 == 0, "equation").when(k % 3 == 1, "image").otherwise("paragraph")
    return table(spark, sf_dir, "part").select(k.alias("item"), F.floor(k / 6).cast("long").alias("grp"), role.alias("role"), F.when(k % 4 != 0, k % 9).alias("page"), text.alias("text"))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values: tuple[str, ...]) -> str:
    return f"({_sql_list(values)})[p_partkey % {len(values)} + 1]"


PHRASES_SQL = f"""phrases as (select p_partkey as item, p_partkey // 6 as grp, case p_partkey % 3 when 0 then 'equation' when 1 then 'image' else 'paragraph' end as role, case when p_partkey % 4 <> 0 then p_partkey % 9 end as page,
    concat_ws(' ', {_sql_pick(OPENING_PHRASES)}, {_sql_pick(MIDDLE_PHRASES)}, {_sql_pick(CLOSING_PHRASES)}, case when p_partkey % 17 = 0 then repeat('word ', 20) else '' end) as text from part),
t as (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as c, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as low from phrases)"""

#: Words that stand on the pages of the view, and descriptions of what is looked for there.
PAGE_WORDS = ("x2", "=", "+", "the", "sin", "12.5", "where", "xy", "(", ")", "Solution", "y", "of", "{", "}", "determine", "37", "a", "proof")
DESCRIPTIONS = ("x sub 2 equals twelve point 12.5", "open brace x y close brace plus 37", "the fraction a over y", "sin of x squared open parenthesis y close parenthesis", "a bracket of nothing here")


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, line, x0, y0, x1, y1, text: some 16 words in four lines."""
    k, n = F.col("l_partkey"), F.col("l_orderkey")
    word = F.element_at(F.array(*map(F.lit, PAGE_WORDS)), (k % len(PAGE_WORDS) + 1).cast("int"))
    x0, y0 = F.col("l_linenumber") * 20.0, (n % 4) * 10.0 + F.when(n % 8 > 3, 30.0).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").select(F.floor(n / 4).cast("long").alias("item"), (n % 4).alias("line"), x0.alias("x0"), y0.alias("y0"), (x0 + F.length(word) * 4).alias("x1"), (y0 + 9.5).alias("y1"), word.alias("text"))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.floor(F.col("o_orderkey") / 4).cast("long")
    box = F.struct(F.lit(20.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(140.0).alias("x1"), F.lit(40.0).alias("y1"))
    said = F.element_at(F.array(*map(F.lit, DESCRIPTIONS)), (F.col("item") % len(DESCRIPTIONS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(item.alias("item")).distinct().select("item", said.alias("description"), box.alias("box"))

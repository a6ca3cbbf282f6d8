"""Registered queries over texts about equations, over descriptions, and over the words of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import equations, responses, transcription
from quillspark.operators import formulas
from quillspark.plans.queries import query
from quillspark.session import cut
from quillspark.plans.views import DESCRIPTIONS, PHRASES_SQL, described, elements, page_words, phrases


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def has_any(text: str, values) -> str:
    return f"(len(list_filter({listed(values)}, lambda v: contains({text}, v))) > 0)"


WORDS = "case when c = '' then 0 else len(string_split(c, ' ')) end"
SIGNAL = rf"({has_any('s', equations.OPERATORS)} or regexp_matches(s, '\b[0-9]+\s*-\s*[0-9]+\b') or regexp_matches(s, '\b[A-Za-z]\s*-\s*[A-Za-z0-9]+\b'))"
#: s is the text, trimmed; w its words.
LOW = rf"""case when s = '' then true when regexp_matches(s, '^[0-9\s.,]+$') then false when len(w) < 3 then not ({SIGNAL} or regexp_matches(s, '[0-9]'))
    when {has_any('lower(s)', (*equations.PAGE_WORDS, 'provide', 'feedback'))} and not {SIGNAL} then true
    when len(list_filter(w, lambda x: regexp_matches(x, '^[\pL\pN]$'))) / len(w) > 0.7 then true when regexp_matches(s, '[0-9]') and {SIGNAL} then false
    else not {SIGNAL} and len(list_filter(w, lambda x: length(x) >= 3 and regexp_matches(x, '\pL'))) = 0 end"""
SPLIT = r"u as (select *, trim(text) as s, regexp_split_to_array(trim(text), '\s+') as w from t)"
OPS = has_any("text", (*equations.OPERATORS, "-"))
QUALITY = rf"""(case when regexp_matches(text, '^[0-9\s.,]+$') then 1.4 else 0 end + case when {OPS} then 1.0 else 0 end + case when contains(text, '=') then 1.2 else 0 end
    + case when {has_any('lower(text)', (' x', 'y', 'squared', 'fraction', 'numerator', 'denominator'))} then 0.9 else 0 end + case when len(w) >= 5 then 0.4 else 0 end
    - case when {has_any('lower(text)', equations.PAGE_WORDS)} and not {OPS} then 1.2 else 0 end - case when {LOW} then 1.3 else 0 end - greatest(0, length(text) - 220) * 0.002)::double"""
NOISE = f"(not {has_any('low', equations.DATA_CUES)} and ({WORDS} > 28 or (contains(low, '?') and {WORDS} > 12) or {has_any('low', equations.NOISE)}))"


@query(
    rf"""with {PHRASES_SQL}, {SPLIT} select item,
    {has_any('lower(c)', equations.RAW_SIGNS)} or regexp_matches(c, '[0-9]\s*[/=+-]\s*[0-9]') or regexp_matches(c, '\b[A-Za-z][0-9]+\b') as raw,
    not {has_any('low', equations.NOT_EQUATION)} and {has_any("' ' || low || ' '", equations.RELATIONS)} and ({has_any("' ' || low || ' '", equations.OPERATIONS)} or {WORDS} >= 3) as reads,
    not {has_any('low', equations.NOT_SPOKEN)} and {has_any('low', equations.SPOKEN)} as speaks,
    contains(text, '=') or {has_any('lower(text)', equations.EQUATION_WORDS)} or (regexp_matches(text, '[A-Za-z].*[A-Za-z]') and regexp_matches(text, '[0-9]')) as worded,
    {LOW} as low_quality from u"""
)
def equation_texts(spark: SparkSession, d: str) -> DataFrame:
    """Five views on whether a text is an equation."""
    t = F.col("text")
    return phrases(spark, d).select("item", equations.has_raw_signal(t).alias("raw"), equations.reads_as_equation(t).alias("reads"), equations.speaks_of_maths(t).alias("speaks"), equations.has_equation_words(t).alias("worded"), equations.is_low_quality(t).alias("low_quality"))


@query(
    rf"""with {PHRASES_SQL}, {SPLIT} select item,
    {WORDS} >= 6 and not regexp_matches(c, '[^\x00-\x7E]') and not {has_any('c', equations.UNSAFE_SIGNS)} and not {has_any('low', equations.UNSAFE_WORDS)} as safe,
    {NOISE} as running,
    c <> '' and not {NOISE} and {WORDS} <= 14 and ({has_any('low', equations.LABEL_WORDS)} or len(list_filter(regexp_split_to_array(translate(c, '=+', '  '), '\s+'), lambda x: regexp_matches(x, '^\pL+$') and not (x = upper(x) and length(x) <= 4))) = 0) as label,
    {WORDS} between 2 and 18 and not {has_any('low', equations.STYLE_NOT)} and {has_any('low', equations.STYLE_SPOKEN)} as example,
    {has_any('low', responses.DATA_WORDS)} as dense from u"""
)
def label_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a text is fit for: a description, a label, an example of style; or running text."""
    t = F.col("text")
    return phrases(spark, d).select("item", equations.is_safe_text(t).alias("safe"), equations.is_running_text(t).alias("running"), equations.is_useful_label(t).alias("label"), equations.is_style_example(t).alias("example"), responses.is_data_dense(t).alias("dense"))


@query(
    rf"""with {PHRASES_SQL}, {SPLIT}, q as (select grp, item, text, {QUALITY} as quality from u),
r as (select *, row_number() over (partition by grp order by round(quality, 6) desc, item) as n from q) select grp, item, round(quality, 6) as quality from r where n = 1"""
)
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Of each group of candidates the one of the highest quality, the first of equals."""
    rows = phrases(spark, d).select("grp", "item", F.round(equations.quality("text"), 6).alias("quality"))
    return rows.groupBy("grp").agg(F.max_by(F.struct("item", "quality"), F.struct("quality", -F.col("item"))).alias("best")).select("grp", "best.item", "best.quality")


@query(
    rf"""with {PHRASES_SQL}, {SPLIT}, e as (select *, case when regexp_matches(c, '[.!?]$') then c else c || '.' end as ended from u),
f as (select item, role, page, c, ended, (select {LOW} from (select c as s, string_split(c, ' ') as w)) as low_quality from e)
select item, case when c = '' or (role = 'equation' and low_quality) then '' when role not in ('equation', 'image') and page is not null and not contains(lower(ended), 'page') and length(ended) < 250
    then substr(ended, 1, length(ended) - 1) || ' (page ' || page || ').' else ended end as text from f"""
)
def finished_texts(spark: SparkSession, d: str) -> DataFrame:
    return phrases(spark, d).select("item", equations.finished("text", "role", "page").alias("text"))


def _marks_sql(text: str) -> str:
    for words, mark in equations.SPOKEN_MARKS.items():
        text = rf"regexp_replace({text}, '\b{words}\b', '{mark}', 'gi')"
    return text


@query(rf"""with {PHRASES_SQL}, m as (select item, trim(regexp_replace({_marks_sql('c')}, '\s+', ' ', 'g')) as marked, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z\-]+'), lambda x: length(x) > 2 and not list_contains({listed(equations.STOP_WORDS)}, lower(x))) as w from t)
select item, marked, array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i)[1:5], ',') as labels from m""")
def spoken_marks_and_labels(spark: SparkSession, d: str) -> DataFrame:
    """Spoken punctuation as marks, and the first words that a label would name."""
    return phrases(spark, d).select("item", equations.marks_for_words("text").alias("marked"), F.array_join(equations.label_words("text"), ",").alias("labels"))


NUMBERS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in formulas.NUMBER_WORDS.items()) + "}"


@query(
    rf"""with d as (select distinct o_orderkey // 4 as item from orders), e as (select item, lower(({listed(DESCRIPTIONS)})[item % {len(DESCRIPTIONS)} + 1]) as s from d),
k as (select item, s, regexp_extract_all(s, '[0-9]+(?:\.[0-9]+)?|[a-z]+') as w from e),
a as (select item, unnest(w) as token from k union select item, unnest(list_filter(list_transform(w, lambda x: {NUMBERS}[x]), lambda x: x is not null)) from k
    union select item, unnest(list_transform(regexp_extract_all(s, '\b[a-z]\s+sub(?:script)?\s+[0-9]+(?:\.[0-9]+)?\b'), lambda x: x[1] || regexp_extract(x, '[0-9.]+$'))) from k)
select item, string_agg(token, ',' order by token) as tokens, count(*) filter (where regexp_matches(token, '[0-9]+\.[0-9]+|^[a-z]+[0-9]+$|^[0-9]{{2,}}$')) as strong from a where not list_contains({listed(formulas.SAYING)}, token) group by item"""
)
def formula_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The tokens by which a described formula is looked for."""
    rows = described(spark, d).select("item", formulas.description_tokens(F.col("description")).alias("t")).where(F.size("t") > 0)
    return rows.select("item", F.array_join("t", ",").alias("tokens"), F.size(F.filter("t", formulas.is_strong)).cast("long").alias("strong"))


@query()
def formula_segments(spark: SparkSession, d: str) -> DataFrame:
    """Runs of formula words with their stats, without edges that say nothing."""
    found = formulas.segment_stats(formulas.judged_words(page_words(spark, d), described(spark, d)))
    return found.select("item", "line", F.col("first").cast("long").alias("first"), "words", "text", F.col("overlap").cast("long").alias("overlap"), F.col("strong").cast("long").alias("strong"), F.col("signs").cast("long").alias("signs"), "math_words", "long_words", "score")


@query()
def formula_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of described formulas, drawn in to the words that make them up, and padded for fine signs."""
    found = formulas.refined(page_words(spark, d), described(spark, d))
    room = formulas.padded(F.col("box"), F.col("description"))
    return found.select("item", "box.*", F.size("chosen").alias("clusters"), room["x0"].alias("padded_x0"), room["y1"].alias("padded_y1"))


@query()
def wrapper_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes drawn in to the wrappers that a description names."""
    return formulas.drawn_in_to_wrappers(page_words(spark, d), described(spark, d)).select("item", "box.*")


@query()
def formula_searches(spark: SparkSession, d: str) -> DataFrame:
    """Formulas looked for by their descriptions alone, and which of the places found are taken instead of the known ones; tests hold the growth against a plain loop."""
    words, wanted = page_words(spark, d), described(spark, d)
    judged = cut(formulas.judged_words(words, wanted))
    found = cut(formulas.located(words, wanted, judged))
    better = formulas.better_places(words, wanted, found, judged)
    return found.select("item", "way", F.col("box").alias("found")).join(better, "item").select("item", "way", "replaced", F.col("found.x0").alias("found_x0"), F.col("found.y0").alias("found_y0"), "box.*")


@query()
def transcriptions(spark: SparkSession, d: str) -> DataFrame:
    """The equation that each line of a document holds, transcribed strictly; tests/test_transcription.py holds it against a plain version."""
    rows = elements(spark, d).select("doc_id", "idx", transcription.strict_transcription("text").alias("equation"))
    return rows.where("equation <> ''")

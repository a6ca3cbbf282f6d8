"""The normal forms of texts, and what they cost."""

import random

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.plans import queries
from quillspark.session import heavy_tasks

LETTERS = "abz 019=+-*/^().,:;_`~|  \t\n  ABZäİ中!\"'[]{}\\&%$#@?<>"


def test_normal_forms_against_the_plain_patterns(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice(LETTERS) for _ in range(rng.randrange(30))),) for _ in range(400)] + [(None,), ("",), (" _ ",), ("=a=",), ("a|b",)]
    t = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s+", " ")
    kept, styled = r"[^a-z0-9=+\-*/^().,:; ]", "[^a-z0-9 ]"
    want = [F.trim(F.regexp_replace(t, kept, "")), F.trim(F.regexp_replace(F.regexp_replace(t, r"[_`~|]", " "), kept, "")), F.trim(F.regexp_replace(t, styled, "")), F.trim(F.regexp_replace(t, styled, ""))]
    got = [T.normal_for_alignment("text"), T.normal_for_comparison("text"), T.normal_for_style("text"), T.style_of_aligned(T.normal_for_alignment("text"))]
    found = spark.createDataFrame(rows, "text string").select(F.array(*want).alias("want"), F.array(*got).alias("got")).collect()
    assert [r["got"] for r in found] == [r["want"] for r in found]


def test_classes_name_their_letters_one_by_one():
    assert all("-z" not in x and "-9" not in x for x in (T.NOT_ALIGNED, T.NOT_STYLED))


def test_ranking_is_dealt_by_the_pairs(spark, sf, monkeypatch):
    """Candidates are dealt once, before examples meet them, into tasks by the number of pairs; the ranking needs no other shuffle."""
    monkeypatch.setattr(queries, "TASK_ROWS", 100)
    found = queries.style_examples_top3(spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(p_partkey") == 1 and "BroadcastHashJoin" in plan
    dealt = int(plan.split("hashpartitioning(p_partkey")[1].split(")")[0].split(", ")[1])
    monkeypatch.undo()
    assert dealt > heavy_tasks(spark)
    assert sorted(found.collect()) == sorted(queries.style_examples_top3(spark, sf).collect())

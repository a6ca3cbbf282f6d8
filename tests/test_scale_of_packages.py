"""What packages, lists and their numbers cost as tables grow: each package is read once, no group of rows meets in one task for want of a key, and what is sorted is sorted once."""

import inspect
import random

from pyspark.sql import functions as F
from test_sources import BODY, RELS, files, package  # noqa: F401

from quillspark.operators import folds, numbering
from quillspark.plans import document_queries, refinement_queries
from quillspark.sources import docx, docx_repairs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_inventory_reads_packages_once(files):  # noqa: F811
    plan = plan_of(docx.inventory(files))
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_writing_sends_no_group_to_python(spark):
    source = spark.createDataFrame([(str(k), bytearray(package(**{"word/document.xml": BODY, "word/_rels/document.xml.rels": RELS}))) for k in range(3)], "path string, content binary")
    texts = spark.createDataFrame([("1", "word/document.xml", "2", "new")], "path string, source_part string, docpr_id string, alt_text string")
    for done in (docx.with_texts(source, texts), docx_repairs.with_lists(source, docx_repairs.typed_lists(docx_repairs.paragraphs(source)))):
        assert "InPandas" not in plan_of(done)
    assert sorted((r["path"], r["changed"]) for r in docx.with_texts(source, texts).collect()) == [("0", 0), ("1", 1), ("2", 0)]


def test_batches_are_bounded_by_bytes():
    rows = [(str(k), b"x" * (1 << 20)) for k in range(20)]
    sizes = [b.num_rows for b in docx.in_batches(rows, document_queries.MADE)]
    assert sum(sizes) == 20 and max(sizes) == docx.OUT_BYTES >> 20
    assert "Pandas" not in inspect.getsource(document_queries.made_packages)


def test_typed_lists_need_no_join(spark):
    lines = spark.createDataFrame([("a", 0, "1. x", False)], "doc_id string, idx long, text string, numbered boolean")
    found = docx_repairs.typed_lists(lines.withColumns({"style": F.lit(None).cast("string"), "twips": F.lit(None).cast("int")}))
    assert "Join" not in plan_of(found)
    assert found.select("idx", "template", "marker").collect() == [(0, "%1.", 3)] and len(folds.list_runs(lines).columns) == 6


def test_numbers_are_counted_in_one_order(spark, sf):
    """Shared lists are broadcast, not a key of a shuffle; one sort for the counters and one for the rows' numbers."""
    plan = plan_of(refinement_queries.list_prefixes(spark, sf))
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert plan.count("Sort [doc") == 2


def test_counters_against_a_plain_loop(spark):
    rng = random.Random(3)
    spec = [("a", 0, "%1.", "decimal", 1, None), ("a", 1, "%1.%2", "decimal", 3, 7), ("a", 2, "%2-%3", "decimal", 1, None), ("b", 0, "%2/%1", "decimal", 2, 5), ("b", 1, "%3", "decimal", 1, None), ("b", 2, "%1%2%3", "decimal", 4, None)]
    rows = [(d, n, rng.choice(["a", "b", "c", None]), rng.randrange(4)) for d in range(6) for n in range(60)]
    levels = spark.createDataFrame(spec, "num_id string, level int, template string, format string, start int, first int")
    found = numbering.numbered(spark.createDataFrame(rows, "doc long, n long, num_id string, level int"), levels, ["doc"], ["n"], 3)
    got = {(r["doc"], r["n"]): r["prefix"] for r in found.collect()}
    known = {(x[0], x[1]): x[2:] for x in spec}
    want, state = {}, {}
    for d, n, num_id, level in rows:
        if (num_id, level) not in known:
            want[d, n] = "" if num_id is None else f"{level + 1}."
            continue
        now = state.setdefault((d, num_id), {})
        for k in [k for k in now if k > level]:
            del now[k]
        template, _, start, first = known[num_id, level]
        now[level] = now[level] + 1 if level in now else start if first is None else first
        for k in range(3):
            if f"%{k + 1}" in template:
                now.setdefault(k, known[num_id, k][2])
        shown = template
        for k in range(3):
            shown = shown.replace(f"%{k + 1}", str(now.get(k)))
        want[d, n] = shown
    assert got == want


def test_typed_markers_are_found_once(spark):
    lines = spark.createDataFrame([("a", 0, "1. x", False)], "doc_id string, idx long, text string, numbered boolean")
    assert plan_of(folds.list_runs(lines)).count("AS __prefix#") == 1

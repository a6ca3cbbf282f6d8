"""Small relational and window cases, and folds against windows."""

import random

from pyspark.sql import functions as F

from quillspark.operators import closure, contrast, inventory, ordered, spatial
from quillspark.plans import compare

ITEM = "id long, role string, existing_alt_text string, generated_alt_text string, alt_text string, has_alt_text boolean, alt_source string"


def test_summary(spark):
    rows = [(0, "image", "a", "", "a", True, "existing"), (1, "equation", "", "", "", False, "missing"), (2, "image", "", "g", "g", False, "generated")]
    got = inventory.summarize(spark.createDataFrame(rows, ITEM)).first().asDict()
    assert got == {"total_items": 3, "images": 2, "equations": 1, "with_alt_text": 1, "generated_alt_text": 1, "with_effective_alt_text": 2, "without_alt_text": 1}


def test_edits_and_sources(spark):
    items = spark.createDataFrame([(i, "image", x, "", x, bool(x), "existing" if x else "missing") for i, x in enumerate(["a", "a", "a", ""])], ITEM)
    log = spark.createDataFrame([(1, "set", 0, "zzz"), (5, "set", 0, "a"), (2, "set", 1, "b"), (3, "set", 2, ""), (4, "set", 3, "")], "seq long, action string, item_id long, text string")
    got = {r["id"]: r["alt_source"] for r in inventory.overlay(items, log).collect()}
    assert got == {0: "existing", 1: "manual", 2: "missing", 3: "missing"}


def test_replace(spark):
    items = spark.createDataFrame([(0, "image", "", "", "aaa", False, "missing")], ITEM)
    row = inventory.replace(items, "aa", "b").first()
    assert (row["alt_text"], row["replaced"], row["alt_source"]) == ("ba", 1, "manual")


def test_import(spark):
    items = spark.createDataFrame([(7, 0), (7, 1), (8, 0), (8, 1)], "doc_id long, id long")
    sheet = spark.createDataFrame([(7, 1, 1, "B"), (7, 2, 0, "A"), (8, 1, 0, "X"), (8, 2, 0, "Y")], "doc_id long, row_no long, item_id long, text string")
    got = {(r["doc_id"], r["id"]): r["alt_text"] for r in inventory.import_texts(items, sheet).collect()}
    assert got == {(7, 0): "A", (7, 1): "B", (8, 0): "X", (8, 1): "Y"}


def test_dedupe_first_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, "k1"), (2, None), (3, "k1"), (4, None)], "pos int, k string")
    assert sorted(r["pos"] for r in ordered.dedupe_first(df, F.col("k"), "pos").collect()) == [1, 2, 4]


def test_level_counters_equal_a_fold(spark):
    rng = random.Random(5)
    rows = [(d, i, rng.randrange(3)) for d in range(30) for i in range(rng.randrange(1, 25))]
    got = {(r["d"], r["i"]): r["counter"] for r in ordered.level_counters(spark.createDataFrame(rows, "d int, i int, level int"), ["d"], ["i"], "level", 3).collect()}
    expected, counters, last = {}, {}, None
    for d, i, level in rows:
        if d != last:
            counters, last = {}, d
        counters = {k: v for k, v in counters.items() if k <= level}
        counters[level] = counters.get(level, 0) + 1
        expected[d, i] = counters[level]
    assert got == expected


def test_reflow_and_empty_runs(spark):
    kinds = ["reflow-candidate"] * 3 + ["content-change", "reflow-candidate"]
    rows = [(1, i, k, 0, 0, 0.1, 0.2, 0.1 + i / 100) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "p int, n int, classification string, left_page int, right_page int, left_y double, right_y double, distance double")
    got = [(r["n"], r["classification"], r["span"]) for r in ordered.collapse_reflow(df, ["p"], ["n"]).orderBy("n").collect()]
    assert got == [(0, "reflow", 3), (3, "content-change", 1), (4, "layout-shift", 1)]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["", " ", "text", ""])], "d int, i int, text string")
    assert [(r["first"], r["alert"]) for r in ordered.empty_runs(lines, ["d"], ["i"]).orderBy("first").collect()] == [(0, "double_empty_paragraph"), (3, "empty_paragraph")]


def test_nearest_page_takes_the_first_on_ties(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 2, None), (1, 4, 2)], "d int, i int, page int")
    assert [r["near"] for r in ordered.nearest_filled(df, ["d"], "i", "page", "near").orderBy("i").collect()] == [1, 1, 2]


def test_closures_end_in_cycles(spark):
    df = spark.createDataFrame([("fig", "figure1", None), ("figure1", "figure", None), ("figure", None, "F"), ("x", "y", None), ("y", "x", None)], "node string, parent string, value string")
    got = {r["node"]: (r["value"], r["steps"], r["root"]) for r in closure.along_chain(df).collect()}
    assert got["fig"] == ("F", 2, "figure") and got["figure"] == ("F", 0, "figure") and got["x"] == (None, None, None)
    tree = spark.createDataFrame([(1, None, "figure"), (2, 1, "section"), (3, 2, "figure"), (4, 1, "table")], "node int, parent int, role string")
    assert sorted(r["node"] for r in closure.without_same_below(tree).collect()) == [2, 3, 4]


def test_formulas_on_the_pages_beside(spark):
    rows = spark.createDataFrame([(1, 2, 0.5, 0.5), (2, 9, 0.5, 0.5)], "row_id int, page int, x double, y double")
    formulas = spark.createDataFrame([(7, 3, 0.5, 0.5, 1.0)], "formula_id int, page int, x double, y double, confidence double")
    assert [tuple(r) for r in spatial.nearest_formula(rows, formulas).collect()] == [(1, 7, 0.4)]


def test_nearest_within_equals_a_scan(spark):
    rng = random.Random(2)
    points = [(i, 1, rng.uniform(0, 30), rng.uniform(0, 30)) for i in range(60)]
    traces = [(i, 1, rng.uniform(0, 30), rng.uniform(0, 30)) for i in range(200)]
    got = {r["point_id"]: r["trace_id"] for r in spatial.nearest_within(spark.createDataFrame(points, "point_id int, page int, x double, y double"), spark.createDataFrame(traces, "trace_id int, page int, x double, y double")).collect()}
    expected = {}
    for p, _, x, y in points:
        near = [(abs(x - a) + abs(y - b), t) for t, _, a, b in traces if abs(x - a) <= 2.5 and abs(y - b) <= 2.5]
        if near:
            expected[p] = min(near)[1]
    assert got == expected


def test_alignment_keeps_the_order(spark):
    texts = {"A": "the quick brown fox jumps over", "B": "an entirely different paragraph here", "C": "closing remarks on the experiment"}
    schema = "pair long, idx long, text string, page int, x_norm double, y_norm double, role string"
    side = lambda names: compare.prepared(spark.createDataFrame([(1, i, texts[n], 0, 0.1, 0.2 + i / 10, None) for i, n in enumerate(names)], schema))
    got = [(r["left_idx"], r["right_idx"]) for r in compare.aligned(side("ABC"), side("AC")).orderBy("n").collect()]
    assert got == [(0, 0), (2, 1)]


def test_partitions_do_not_matter(spark, sf):
    from quillspark.plans.queries import QUERIES

    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(repr, QUERIES["reflow_runs"](spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_repaired_runs(spark):
    styles = spark.createDataFrame([(1, "base", None, "777777", None), (1, "own", "base", None, "000000"), (1, "loop", "loop", None, None)], "doc_id int, style_id string, based_on string, color string, shading string")
    schema = "doc_id int, run_no int, color string, highlight string, shading string, nested_shading string, run_style string, para_style string, table_style string"
    runs = [(1, 0, "000000", None, None, None, None, None, None), (1, 1, None, None, None, None, None, "base", None), (1, 2, None, None, None, None, "own", "base", None), (1, 3, None, "yellow", "000000", None, "loop", "base", None), (1, 4, None, None, None, "000000", None, None, None)]
    got = {r["run_no"]: (r["effective_color"], r["ground"], r["low"], r["new_color"] is not None) for r in contrast.repaired(spark.createDataFrame(runs, schema), styles).collect()}
    assert got == {0: ("000000", "FFFFFF", False, False), 1: ("777777", "FFFFFF", True, True), 2: ("777777", "000000", False, False), 3: ("000000", "FFFF00", False, False), 4: ("000000", "000000", True, True)}

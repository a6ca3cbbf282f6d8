"""Folds against small cases and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.responses import numbered_texts
from quillspark.operators import folds, generation


def runs(spark, texts):
    df = spark.createDataFrame([(1, i, t, False) for i, t in enumerate(texts)], "doc_id long, idx long, text string, numbered boolean")
    return [(r["idx"], r["list_id"], r["number"]) for r in folds.list_runs(df).orderBy("idx").collect()]


def test_list_runs(spark):
    assert runs(spark, ["1. a", "2. b", "4. c", "1. d"]) == [(0, 1, 1), (1, 1, 2), (2, 2, 4), (3, 3, 1)]
    assert runs(spark, ["1. a", "plain", "2. b"]) == [(0, 1, 1), (2, 2, 2)]
    assert runs(spark, ["1. a", "\t(a) x", "\t(b) y", "2. b", "\t(c) z"]) == [(0, 1, 1), (1, 2, 1), (2, 2, 2), (3, 1, 2), (4, 3, 3)]
    assert runs(spark, ["1. a", "• dot", "2. b"]) == [(0, 1, 1), (1, 0, None), (2, 2, 2)]


TARGET = "doc_id long, pos long, role string, source_part string, names array<string>"


def test_tiers_of_matching(spark):
    rows = spark.createDataFrame([(1, 0, "image", "body", [])], TARGET)
    targets = spark.createDataFrame([(1, 0, "equation", "body", []), (1, 1, "image", "header", []), (1, 2, "image", "body", [])], TARGET)
    assert [r["target_pos"] for r in folds.match_targets(rows, targets).collect()] == [2]
    rows = spark.createDataFrame([(1, k, "image", "body", ["/Word/Media/A.png"]) for k in range(4)], TARGET)
    targets = spark.createDataFrame([(1, 0, "image", "body", []), (1, 1, "equation", "body", ["word/media/a.png"]), (1, 2, "image", "body", ["word\\media\\a.png"])], TARGET)
    got = [r["target_pos"] for r in folds.match_targets(rows, targets).orderBy("pos").collect()]
    assert got == [2, 1, 0, None]


def test_clusters_grow(spark):
    rng = random.Random(1)
    rows = [(p, n, x := rng.random(), y := rng.random(), x + 0.05, y + 0.05) for p in range(5) for n in range(25)]
    got = {(r["page"], r["n"]): r["cluster"] for r in folds.grown_clusters(spark.createDataFrame(rows, "page long, n long, x0 double, y0 double, x1 double, y1 double"), 0.04, 0.04).collect()}
    assert len(got) == len(rows)
    for p in range(5):
        boxes = {n: (a, b, c, d) for q, n, a, b, c, d in rows if q == p}
        groups = {}
        for n in boxes:
            groups.setdefault(got[p, n], []).append(n)
        assert [min(g) for _, g in sorted(groups.items())] == sorted(min(g) for g in groups.values())
        unions = [tuple(f(boxes[n][k] for n in g) for k, f in enumerate((min, min, max, max))) for g in groups.values()]
        for i, (a, g) in enumerate(zip(unions, groups.values(), strict=True)):
            for n in boxes:  # what is outside lay beyond the gaps of a cluster that was closed before its own began
                b = boxes[n]
                apart = max(a[0] - b[2], b[0] - a[2], 0) > 0.04 or max(a[1] - b[3], b[1] - a[3], 0) > 0.04
                assert n in g or apart or min(g) > min(groups[got[p, n]]), (i, n)


def test_filled_between_and_chained(spark):
    rows = [(1, 0, "text", 3, 0.1, 0.2), (1, 1, "empty", None, None, None), (1, 2, "empty", None, None, None), (1, 3, "text", 3, 0.5, 0.6), (2, 0, "empty", None, None, None), (2, 1, "text", 1, 0.5, 0.6), (3, 0, "empty", None, None, None)]
    got = {(r["doc_id"], r["idx"]): (r["page"], r["y0"], r["y1"]) for r in folds.filled_previews(spark.createDataFrame(rows, "doc_id long, idx long, role string, page long, y0 double, y1 double")).collect()}
    assert got[1, 1] == (3, pytest.approx(0.204), pytest.approx(0.496))
    assert got[1, 2][1] == pytest.approx(0.5)  # below the one filled before it
    assert got[2, 0] == (1, pytest.approx(0.47), pytest.approx(0.496)) and got[3, 0] == (None, None, None)


def test_exact_anchors_are_taken_once(spark):
    e = spark.createDataFrame([(1, 0, "Same"), (1, 1, "same"), (1, 2, "same"), (1, 3, "a longer piece of text")], "doc_id long, idx long, text string")
    b = spark.createDataFrame([(1, 10, "same!"), (1, 11, "here is a longer piece of text indeed"), (1, 12, "SAME")], "doc_id long, idx long, text string")
    assert [r["block"] for r in folds.exact_anchors(e, b).orderBy("idx").collect()] == [10, 12, None, 11]


@pytest.mark.parametrize(
    ("answer", "expected"),
    [
        ('```json\n{"items":[{"number":1,"alt_text":"A"}]}\n```', {1: "A"}),
        ('{"1":"A"}', {1: "A"}),
        ('Sure! {"alts": {"2": "B"}} done', {2: "B"}),
        ('[{"number": "3", "alt_text": " x  y "}, {"number": 0, "alt_text": "no"}]', {3: "x y"}),
        ("1. A\n2) B", {1: "A", 2: "B"}),
        ("1. alt text: A\n more\n0. none", {1: "A more"}),
        ("", {}),
        (None, {}),
        ("{broken", {}),
    ],
)
def test_answers(answer, expected):
    assert numbered_texts(answer) == expected


def test_items_an_answer_leaves_out_get_nothing(spark):
    items = spark.createDataFrame([("s", i, "equation" if i % 2 else "image", "", "h") for i in range(10)], "source string, id long, role string, alt_text string, hint string")
    assert generation.batches(items).select(F.max("number")).first()[0] == 6
    # recorded answers: a list, one that is cut short, and one that talks about itself
    answers = spark.createDataFrame([("s", 0, "1. only the first one\n2. Alt text: \"The image shows a cat on a mat\""), ("s", 1, "Please provide the image")], "source string, batch long, said string")
    assert sorted(r["text"] for r in generation.accepted(items, answers).collect()) == ["a cat on a mat", "only the first one"]


def test_large_ids_and_missing_documents(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, 2**60 + 1, "1. a", None), (big, 2**60 + 3, "2. b", False), (None, 1, "1. x", False), (None, 2, "2. y", False)], "doc_id long, idx long, text string, numbered boolean")
    assert sorted((r["doc_id"], r["idx"], r["number"]) for r in folds.list_runs(df).collect()) == [(big, 2**60 + 1, 1), (big, 2**60 + 3, 2)]

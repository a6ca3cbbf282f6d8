"""Described formulas against plain loops over the words of a page."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import formulas
from quillspark.plans import compare
from quillspark.plans.views import described, page_words

WORDS = "item long, line long, x0 double, y0 double, x1 double, y1 double, text string"


def on_lines(*lines, item=1, top=0.0, gap=10.0):
    return [(item, k, 10.0 * n, top + gap * k, 10.0 * n + 8, top + gap * k + 9.5, w) for k, line in enumerate(lines) for n, w in enumerate(line.split())]


@pytest.fixture
def look(spark):
    def run(said, *lines, box=(0.0, 0.0, 90.0, 30.0), gap=10.0):
        words = spark.createDataFrame(on_lines(*lines, gap=gap), WORDS)
        wanted = spark.createDataFrame([(1, said, box)], "item long, description string, box struct<x0:double,y0:double,x1:double,y1:double>")
        return words, wanted

    return run


def test_tokens(spark):
    one = spark.range(1)
    tokens = lambda c: sorted(one.select(c.alias("x")).first()["x"])
    assert tokens(formulas.description_tokens(F.lit("x sub 2 equals twelve over 1.5"))) == ["1.5", "12", "2", "twelve", "x", "x2"]
    assert tokens(formulas.visual_tokens(F.lit("x2 = {√ 1.5}"))) == ["1.5", "2", "brace", "root", "square", "x", "x2"]
    assert tokens(formulas.overlap_tokens(F.lit("xy and"), F.array(F.lit("x"), F.lit("y")))) == ["x", "y"]
    assert [one.select(formulas.is_strong(F.lit(t)).alias("x")).first()["x"] for t in ("1.5", "x2", "12", "2", "x")] == [True, True, True, False, False]


def test_segments_and_their_edges(look):
    words, wanted = look("x sub 2 equals 12.5", "the proof x2 = 12.5 a where sin y")
    found = formulas.segment_stats(formulas.judged_words(words, wanted)).orderBy("segment").collect()
    assert [(r["text"], r["overlap"], r["strong"]) for r in found] == [("x2 = 12.5", 4, 2), ("sin y", 0, 0)]  # 'a' is weak and goes
    assert found[0]["score"] == 4 * 6 + 2 * 4 + 1.5 + 3


def test_boxes(look):
    words, wanted = look("x sub 2 equals 12.5 plus y sub 7", "some words of prose here", "x2 = 12.5", "+ y7", "and more words of prose", box=(0.0, 0.0, 200.0, 100.0))
    got = formulas.refined(words, wanted).first()
    assert tuple(got["box"]) == (0.0, 10.0, 28.0, 29.5)
    words, wanted = look("nothing that is there", "only plain prose words", box=(1.0, 2.0, 3.0, 4.0))
    assert tuple(formulas.refined(words, wanted).first()["box"]) == (1.0, 2.0, 3.0, 4.0)
    words, wanted = look("x sub 2", "x2", box=(0.0, 0.0, 1.0, 1.0))
    assert tuple(formulas.refined(words, wanted).first()["box"]) == (0.0, 0.0, 1.0, 1.0)  # the new one would be too much larger


def test_wrappers(look):
    words, wanted = look("open parenthesis y close parenthesis", "x = ( y ) + 1", box=(0.0, 0.0, 90.0, 10.0))
    assert tuple(formulas.drawn_in_to_wrappers(words, wanted).first()["box"]) == (20.0, 0.0, 48.0, 9.5)
    words, wanted = look("no such sign", "( y )", box=(0.0, 0.0, 9.0, 9.0))
    assert tuple(formulas.drawn_in_to_wrappers(words, wanted).first()["box"]) == (0.0, 0.0, 9.0, 9.0)


def test_segments_of_a_table_against_loops(spark, sf):
    judged = formulas.judged_words(page_words(spark, sf), described(spark, sf))
    rows = judged.orderBy("item", "line", "n").collect()
    expected, run, key = [], [], None

    def close():
        mine = list(run)
        if any(w["met"] for w in mine):
            while len(mine) > 1 and mine[0]["weak"]:
                mine.pop(0)
            while len(mine) > 1 and mine[-1]["weak"]:
                mine.pop()
        if mine:
            expected.append((mine[0]["item"], mine[0]["line"], " ".join(w["text"] for w in mine)))
        run.clear()

    for w in rows:
        if (w["item"], w["line"]) != key or not w["formulaish"] or w["breaks"]:
            close()
        key = w["item"], w["line"]
        if w["formulaish"] and not w["breaks"]:
            run.append(w)
    close()
    got = formulas.segment_stats(judged).collect()
    assert sorted((r["item"], r["line"], r["text"]) for r in got) == sorted(expected) and len(expected) > 100
    assert all(r["signs"] == len(re.findall(r"[=+\-*/_(){}\[\]|:]", r["text"])) for r in got)


def test_list_levels_and_bonuses(spark):
    one = spark.range(1)
    level = lambda *x: one.select(text.list_level(*x).alias("x")).first()["x"]
    assert level(F.lit("\t"), F.lit("Body"), F.lit(0)) == 1
    assert level(F.lit(""), F.lit("List Bullet 3"), F.lit(1440)) == 2
    assert level(F.lit(""), F.lit(None).cast("string"), F.lit(9999)) == 8
    at = {"y_norm": 0.5, "x_norm": 0.1, "doc_y": 1.5, "page": 1, "role": "text"}
    plain = compare.score(at, at, 1.0, 1.0)
    assert round(compare.score(at | {"reading_order": 3}, at | {"reading_order": 4}, 1.0, 1.0) - plain, 6) == 0.025
    assert round(compare.score(at | {"sequence_order": 3}, at | {"sequence_order": 3}, 1.0, 1.0) - plain, 6) == 0.08


def grown_plainly(words):
    """The best cluster of one item's words, one word after the other."""
    gaps = lambda a, b: (max(0.0, a[0] - b[2], b[0] - a[2]), max(0.0, a[1] - b[3], b[1] - a[3]))
    best = None
    for seed in [w for w in words if w["met"]] or words:
        cluster, box, grew = [seed], seed["box"], True
        while grew:
            grew = False
            for w in words:
                if all(w is not x for x in cluster):
                    across, down = gaps(box, w["box"])
                    if across <= 18 and down <= 6:
                        cluster.append(w)
                        box = (min(box[0], w["box"][0]), min(box[1], w["box"][1]), max(box[2], w["box"][2]), max(box[3], w["box"][3]))
                        grew = True
        tokens = {t for w in cluster for t in w["met"]}
        strong = {t for w in cluster for t in w["strong_met"]}
        score = (sum(w["anchor"] for w in cluster), sum(w["signs"] for w in cluster), len(tokens), len(strong), -(box[2] - box[0]) * (box[3] - box[1]) / len(cluster))
        if best is None or score > best[0]:
            best = score, len(cluster), box
    return best[1:]


def test_words_grow_as_in_a_plain_loop(spark):
    import random

    rng = random.Random(9)
    rows = []
    for item in range(40):
        for n in range(rng.randrange(1, 30)):
            x, y = rng.random() * 150, rng.random() * 60
            met = rng.sample(["x", "y", "12", "x2"], rng.choice([0, 0, 0, 1, 2]))
            rows.append((item, n // 5, n, met, rng.randrange(3), rng.random() < 0.5, [t for t in met if len(t) > 1], x, y, x + 1 + rng.random() * 12, y + 1 + rng.random() * 6))
    df = spark.createDataFrame(rows, "item long, line long, n long, met array<string>, signs int, anchor boolean, strong_met array<string>, x0 double, y0 double, x1 double, y1 double")
    got = {r["item"]: (r["words"], tuple(round(r[c], 9) for c in ("x0", "y0", "x1", "y1"))) for r in formulas.grown_from_words(df).collect()}
    for item in range(40):
        words = [{"met": r[3], "signs": r[4], "anchor": r[5], "strong_met": r[6], "box": r[7:]} for r in rows if r[0] == item]
        n, box = grown_plainly(words)
        assert got[item] == (n, tuple(round(x, 9) for x in box)), item


def test_located_falls_back_to_words_and_better_places_are_taken(spark):
    words = [
        (1, 0, 0.0, 0.0, 20.0, 9.0, "x2"), (1, 0, 22.0, 0.0, 30.0, 9.0, "="), (1, 0, 32.0, 0.0, 50.0, 9.0, "12.5"),
        (2, 0, 0.0, 0.0, 60.0, 9.0, "abc1"), (2, 0, 62.0, 0.0, 90.0, 9.0, "def2"), (2, 0, 92.0, 0.0, 120.0, 9.0, "ghi3"), (2, 0, 122.0, 0.0, 130.0, 9.0, "="), (3, 0, 0.0, 0.0, 60.0, 9.0, "Nothing"),
    ]
    words = spark.createDataFrame(words, "item long, line long, x0 double, y0 double, x1 double, y1 double, text string")
    box = (0.0, 0.0, 300.0, 300.0)
    wanted = spark.createDataFrame([(1, "x sub 2 equals twelve 12.5", box), (2, "cosine of it", box), (3, "q", None), (4, "z", box)], "item long, description string, box struct<x0: double, y0: double, x1: double, y1: double>")
    found = formulas.located(words, wanted)
    got = {r["item"]: (r["way"], tuple(r["box"]) if r["box"] else None) for r in found.collect()}
    assert got[1] == ("clusters", (0.0, 0.0, 50.0, 9.0))
    assert got[2] == ("words", (122.0, 0.0, 130.0, 9.0))
    assert got[3] == (None, None) and got[4] == (None, None)
    better = {r["item"]: (r["replaced"], tuple(r["box"]) if r["box"] else None) for r in formulas.better_places(words, wanted, found).collect()}
    assert better == {1: (True, (0.0, 0.0, 50.0, 9.0)), 2: (True, (122.0, 0.0, 130.0, 9.0)), 3: (False, None), 4: (False, box)}


def test_words_are_dealt_by_their_number_and_texts_judged_once(spark, look, monkeypatch):
    words, wanted = look("the square root of y", "3 roots", "= squares y", "plain prose words")
    monkeypatch.setattr(formulas, "tasks_for", lambda df: 7)
    monkeypatch.setattr(formulas, "BROADCAST_TEXTS", 0)
    shuffled = formulas.judged_words(words, wanted)
    assert shuffled.rdd.getNumPartitions() == 7 and "wanted" not in shuffled.columns  # what a task sorts has no descriptions in it
    monkeypatch.undo()
    rows = lambda df: sorted(map(str, df.select("item", "line", "n", "text", "met", "breaks", "weak", "formulaish").collect()))
    assert rows(shuffled) == rows(formulas.judged_words(words, wanted))
    for r in formulas.segment_stats(formulas.judged_words(words, wanted)).collect():
        tokens = spark.createDataFrame([(r["text"],)], "t string").select(formulas.overlap_tokens(F.col("t"), formulas.description_tokens(F.lit("the square root of y"))).alias("x")).first()["x"]
        assert sorted(r["met"]) == sorted(tokens)  # as if the segment's text were looked at

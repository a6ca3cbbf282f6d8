"""Rendered list numbers, grown figure boxes and numbering in spans, against plain loops."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillspark.functions import equations
from quillspark.operators import figures, numbering, ordered
from quillspark.plans import refinement_queries as R


def shown(n, kind):
    if kind == "decimal":
        return str(n)
    if kind == "lowerLetter":
        text = ""
        while n > 0:
            n, text = (n - 1) // 26, chr(97 + (n - 1) % 26) + text
        return text
    text = ""
    for value, sign in ((100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        text, n = text + sign * (n // value), n % value
    return text


def plain_prefixes(rows, levels):
    """rows: doc, at, num_id, level in order. A counter lives until a shallower item comes."""
    spec, now, found = {(x[0], x[1]): x[2:] for x in levels}, defaultdict(dict), {}
    for doc, at, num_id, level in sorted(rows):
        if num_id is None:
            found[doc, at] = ""
        elif (num_id, level) not in spec:
            found[doc, at] = f"{level + 1}."
        else:
            counters = now[doc, num_id]
            for deeper in [k for k in counters if k > level]:
                del counters[deeper]
            template, _, start, first = spec[num_id, level]
            counters[level] = counters[level] + 1 if level in counters else start if first is None else first
            for k in range(9):
                if f"%{k + 1}" in template:
                    _, kind, begin, _ = spec.get((num_id, k), ("", "decimal", 1, None))
                    template = template.replace(f"%{k + 1}", shown(counters.setdefault(k, begin), kind))
            found[doc, at] = template.strip()
    return found


def test_prefixes_are_those_of_a_fold(spark):
    luck = random.Random(5)
    rows = [(luck.randrange(4), at, luck.choice(["1", "2", None, "9"]), luck.choice([0, 1, 1, 2, 2, 3])) for at in range(400)]
    levels = [*R.LEVELS, ("1", 3, "%5 %4", "decimal", 2, None)]
    df = spark.createDataFrame(rows, "doc long, at long, num_id string, level int")
    spec = spark.createDataFrame(levels, "num_id string, level int, template string, format string, start int, first int")
    got = {(r["doc"], r["at"]): r["prefix"] for r in numbering.numbered(df, spec, ["doc"], ["at"]).collect()}
    assert got == plain_prefixes(rows, levels)


def test_no_items_and_typed_numbers(spark):
    spec = spark.createDataFrame(R.LEVELS, "num_id string, level int, template string, format string, start int, first int")
    assert numbering.numbered(spark.createDataFrame([], "doc long, at long, num_id string, level int"), spec, ["doc"], ["at"], 3).count() == 0
    rows = [("1. a", "1.", True, "1. a"), ("2. a", "1.", True, "1. 2. a"), ("2. a", "1.", False, "2. a"), (None, "1.", True, "1."), ("a\t", "iv", True, "iv a"), ("a", "", True, "a")]
    df = spark.createDataFrame(rows, "text string, prefix string, defined boolean, want string")
    assert df.where(numbering.with_prefix("text", F.col("prefix"), F.col("defined")) != F.col("want")).count() == 0


def belongs(a, b, kind):
    gap = lambda k: max(a[k] - b[k + 2], b[k] - a[k + 2], 0)
    w, h, pw, ph = max(1, a[2] - a[0]), max(1, a[3] - a[1]), max(1, b[2] - b[0]), max(1, b[3] - b[1])
    if kind == "text":
        small = ph <= max(28, h * 0.7) and pw <= max(180, w * 1.5) and max(0, b[2] - b[0]) * max(0, b[3] - b[1]) <= 0.7 * max(1, (a[2] - a[0]) * (a[3] - a[1]))
        return small and gap(0) <= max(42, w * 0.28) and gap(1) <= max(26, h * 0.3)
    if kind == "paint":
        return gap(0) <= max(20, w * 0.15) and gap(1) <= max(20, h * 0.2)
    return gap(0) <= 8 and gap(1) <= 8


def plain_growth(box, parts):
    """One part after the other, from the start again whenever one has joined."""
    left, n = list(parts), 0
    while True:
        for x in left:
            if belongs(box, x[1], x[0]):
                box = [min(box[0], x[1][0]), min(box[1], x[1][1]), max(box[2], x[1][2]), max(box[3], x[1][3])]
                left.remove(x)
                n += 1
                break
        else:
            return [round(v, 6) for v in box], n


def test_figures_grow_as_one_by_one(spark, sf):
    first, parts = R.figure_parts(spark, sf)
    parts = figures.drawn_parts(parts, 612.0, 792.0)
    by_figure = defaultdict(list)
    for r in parts.collect():
        by_figure[r["figure"]].append((r["kind"], list(r["box"])))
    got = {r["figure"]: ([round(v, 6) for v in r["box"]], r["joined"]) for r in figures.grown(first, parts).collect()}
    assert got == {r["figure"]: plain_growth(list(r["box"]), by_figure[r["figure"]]) for r in first.collect()}
    assert len({n for _, n in got.values()}) > 2


def test_rules_and_frames_stay_unless_alone(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    small, rule, frame, text = (0.0, 0.0, 9.0, 9.0), (0.0, 50.0, 500.0, 52.0), (0.0, 0.0, 600.0, 700.0), (0.0, 0.0, 600.0, 5.0)
    rows = [(1, "paint", small), (1, "paint", small), (1, "paint", small), (1, "paint", rule), (1, "paint", frame), (1, "text", text), (2, "paint", rule), (3, "image", frame), (4, "paint", None)]
    got = figures.drawn_parts(spark.createDataFrame(rows, f"figure long, kind string, box {box}"), 612.0, 792.0)
    assert sorted(r["figure"] for r in got.collect()) == [1, 1, 1, 1, 2, 3, 4]
    empty = spark.createDataFrame([], f"figure long, kind string, box {box}")
    one = spark.createDataFrame([(7, small)], f"figure long, box {box}")
    assert [r["joined"] for r in figures.grown(one, empty).collect()] == [0]


def test_numbered_in_spans(spark):
    ids = [None, *random.Random(3).sample(range(-500, 5000), 300)]
    df = spark.createDataFrame([("hot", i) for i in ids] + [(None, 4), (None, 99), ("x", 7)], "source string, id long")
    got = {(r["source"], r["id"]): r["__number"] for r in ordered.numbered(df, "source", "id", span=100).collect()}
    order = sorted(ids, key=lambda i: -(10**9) if i is None else i)
    assert got == {("hot", i): k for k, i in enumerate(order, 1)} | {(None, 4): 1, (None, 99): 2, ("x", 7): 1}


def test_formulas_in_pictures(spark):
    cases = {
        "x squared plus y cubed equals a over b": True, "graph of x squared plus y cubed equals a over b": False, "Equation 4": True, "": False, None: False, "plus minus": False,
        "the equation that was found on the first of the many pages of this long book": False, "OfficeMath": True, "3 review equation": False, "red - brick \t formula": True,
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want boolean")
    assert df.where(~equations.picture_reads_as_equation("text").eqNullSafe(F.col("want"))).count() == 0
    none = F.lit(None)
    row = spark.range(1).select(equations.paragraph_holds_equation(none, none, none.cast("array<string>"), none.cast("array<boolean>"), none, none), equations.target_is_equation(none, none, none)).first()
    assert list(row) == [False, False]

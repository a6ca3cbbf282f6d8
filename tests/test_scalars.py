"""Hand-derived cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import colour, text
from quillspark.functions import geometry as G
from quillspark.functions.math_words import integer_words, numbers_as_words, signs_as_words
from quillspark.functions.responses import without_openings
from quillspark.plans.compare import ratio, skip_cost


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "expected"),
    [
        (lambda: text.normal_for_alignment(F.lit(" A_b\n = 2! ")), "ab = 2"),
        (lambda: text.normal_for_comparison(F.lit("A_b")), "a b"),
        (lambda: text.normal_for_alignment(F.lit("A_b")), "ab"),
        (lambda: text.normal_for_style(F.lit("A_b = 2.")), "ab  2"),
        (lambda: text.collapse(F.lit(None).cast("string")), ""),
        (lambda: text.collapse(F.lit(" a  b\n")), "a b"),
        (lambda: text.same_or_contained(F.lit("Hello world"), F.lit("say hello world now")), True),
        (lambda: text.same_or_contained(F.lit("abc"), F.lit("abcd")), False),
        (lambda: text.same_or_contained(F.lit(""), F.lit("")), False),
        (lambda: text.is_valid_paragraph(F.lit("abcd"), F.lit(None).cast("double")), False),
        (lambda: text.is_valid_paragraph(F.lit("abcde"), F.lit(None).cast("double")), True),
        (lambda: text.is_valid_paragraph(F.lit("abcde"), F.lit(0.04)), False),
        (lambda: text.is_valid_paragraph(F.lit("abcde"), F.lit(0.05)), True),
        (lambda: text.is_equation_like(F.lit("a2 + b2 = c2")), True),
        (lambda: text.is_equation_like(F.lit("hello")), False),
        (lambda: text.is_effectively_empty(F.lit('""')), True),
        (lambda: text.is_effectively_empty(F.lit("\" ' \"")), True),
        (lambda: text.is_effectively_empty(F.lit("a")), False),
        (lambda: text.list_number(F.lit(27), F.lit("lowerLetter")), "aa"),
        (lambda: text.list_number(F.lit(1994), F.lit("upperRoman")), "MCMXCIV"),
        (lambda: text.list_number(F.lit(0), F.lit("lowerRoman")), "i"),
        (lambda: text.list_number(F.lit(0), F.lit("lowerLetter")), "0"),
        (lambda: text.column_letters(F.lit(26)), "Z"),
        (lambda: text.column_letters(F.lit(703)), "AAA"),
        (lambda: text.roman_to_number(F.lit("xiv")), 14),
        (lambda: text.letters_to_number(F.lit("aa")), 27),
        (lambda: text.indent_level(F.lit("\t")), 1),
        (lambda: text.indent_level(F.lit(" " * 7)), 1),
        (lambda: text.indent_level(F.lit(" " * 40)), 8),
        (lambda: text.occurrences(F.lit("aaa"), F.lit("aa")), 1),
        (lambda: text.seconds(F.lit("2.5")), 2.5),
        (lambda: text.seconds(F.lit("1m30s")), 90.0),
        (lambda: text.seconds(F.lit("x")), 0.0),
        (lambda: integer_words(F.lit(0)), "zero"),
        (lambda: integer_words(F.lit(21)), "twenty one"),
        (lambda: integer_words(F.lit(1234)), "one thousand two hundred thirty four"),
        (lambda: integer_words(F.lit(-5)), "minus five"),
        (lambda: integer_words(F.lit(1_000_000_000)), "1000000000"),
        (lambda: numbers_as_words(F.lit("57.5%")), "fifty seven point five percent"),
        (lambda: numbers_as_words(F.lit("x2")), "x2"),
        (lambda: signs_as_words(F.lit("2+2=5")), "two plus two equals five"),
        (lambda: signs_as_words(F.lit(r"\frac{x^2}{2} -> y^{5}")), "x squared over two maps to y to the five"),
        (lambda: signs_as_words(F.lit("7-2")), "seven minus two"),
        (lambda: without_openings(F.lit("This image shows a cat")), "a cat"),
        (lambda: without_openings(F.lit("Here is the screen-reader friendly alt text for the image: a cat")), "a cat"),
        (lambda: without_openings(F.lit("Photo of there are - cats")), "- cats"),
        (lambda: numbers_as_words(F.lit("7" * 5000 + " and 0000000012")), "7" * 5000 + " and twelve"),
        (lambda: signs_as_words(F.lit("x^{" + "9" * 5000 + "}")), "x to the " + "9" * 5000),
        (lambda: signs_as_words(F.lit("x^02 + ٣")), "x squared plus ٣"),
        (lambda: signs_as_words(F.lit("a >= 3")), "a greater than or equal to three"),
        (lambda: G.size_class_of_points(F.lit(36.0), F.lit(50.0)), "small"),
        (lambda: G.size_class_of_points(F.lit(100.0), F.lit(100.0)), "medium"),
        (lambda: G.size_class_of_points(F.lit(200.0), F.lit(10.0)), "large"),
        (lambda: G.aspect_similarity(F.lit(2.0), F.lit(2.0)), 1.2),
        (lambda: G.aspect_similarity(F.lit(2.0), F.lit(1.0)), 0.0),
        (lambda: F.round(colour.contrast(F.lit("000000"), F.lit("#FFFFFF")), 6), 21.0),
        (lambda: F.round(colour.contrast(F.lit("777777"), F.lit("FFFFFF")), 6), 4.478089),
        (lambda: F.round(colour.contrast(F.lit("#FF0000"), F.lit("FFFFFF")), 6), 3.998477),
        (lambda: colour.is_low_contrast(F.lit("nope"), F.lit("FFFFFF")), False),
        (lambda: colour.accessible(F.lit("#000000"), F.lit("#FFFFFF")), "000000"),
    ],
)
def test_scalar(value, make, expected):
    assert value(make()) == expected


@pytest.mark.parametrize(("marker", "expected"), [("(a) x", ("lowerLetter", "a", 4, "", "(%1)")), ("iv. x", ("lowerRoman", "iv", 4, "", "%1.")), ("c. x", ("lowerLetter", "c", 3, "", "%1.")), ("mix. x", ("lowerRoman", "mix", 5, "", "%1.")), ("the. x", None), ("1.x", None)])
def test_list_prefix(value, marker, expected):
    found = value(text.list_prefix(F.lit(marker)))
    assert (found and tuple(found)) == expected


def test_ratio():
    assert (ratio("abcd", "bcde"), ratio("tide", "diet"), ratio("diet", "tide"), ratio("", "")) == (0.75, 0.25, 0.5, 1.0)
    assert [skip_cost(x) for x in ("", "abc", "abcdefg")] == [0.08, 0.12, 0.18]


def test_repaired_contrast_is_enough(spark):
    pairs = [(f"#{n * 1234567 % 16777216:06X}", g) for n in range(60) for g in ("#FFFFFF", "#000000", "#336699")]
    df = spark.createDataFrame(pairs, "c string, g string").withColumn("r", colour.accessible(F.col("c"), F.col("g")))
    best_possible = F.greatest(colour.contrast(F.lit("000000"), F.col("g")), colour.contrast(F.lit("FFFFFF"), F.col("g")))
    assert df.where((colour.contrast(F.col("r"), F.col("g")) < 4.45) & (best_possible >= 4.5)).count() == 0  # rounding to 8 bits costs a little


def test_page_space_matrices_and_polygons(value):
    m = lambda *x: F.struct(*[F.lit(float(v)).alias(c) for c, v in zip("abcdef", x)])
    scaled, moved = m(2, 0, 0, 3, 0, 0), m(1, 0, 0, 1, 10, 20)
    assert tuple(value(G.transform(scaled, F.lit(1.0), F.lit(1.0)))) == (2.0, 3.0)
    assert tuple(value(G.transform(G.multiply(scaled, moved), F.lit(1.0), F.lit(1.0)))) == (12.0, 23.0)
    assert tuple(value(G.transform(G.multiply(moved, scaled), F.lit(1.0), F.lit(1.0)))) == (22.0, 63.0)
    box = G.box(F.lit(10.0), F.lit(20.0), F.lit(50.0), F.lit(80.0))
    assert tuple(value(G.from_pdf_space(box, F.lit(100.0), F.lit(200.0)))) == (0.1, 0.6, 0.5, 0.9)
    assert tuple(value(G.from_page_space(box, F.lit(100.0), F.lit(200.0)))) == (0.1, 0.1, 0.5, 0.4)
    assert tuple(value(G.around_polygon(F.array(*map(F.lit, (3.0, 9.0, 1.0, 4.0, 2.0, 8.0)))))) == (1.0, 4.0, 3.0, 9.0)


@pytest.mark.parametrize(("name", "stem"), [("a/b\\My file (1).docx", "My_file_1_"), ("plain", "plain"), (".hidden", ""), ("x.tar.gz", "x.tar"), (None, ""), ("é ü.pdf", "_")])
def test_file_stem(value, name, stem):
    assert value(text.file_stem(F.lit(name).cast("string"))) == stem


@pytest.mark.parametrize(
    ("said", "fonts", "sizes", "issues"),
    [
        ("Page one", ["Times New Roman"], [10.0, 10.04], []), ("page one", ["times new roman"], [10.0], ["capital", "case"]), ("Page ONE", [], None, ["font:unknown", "size:unknown", "case"]),
        ("12", ["Arial", "Times New Roman"], [9.0, 10.0], ["font:Arial", "size:9.0"]), ("PAGE", ["Times New Roman"], [10.0], ["case"]),
    ],
)
def test_footer_issues(spark, said, fonts, sizes, issues):
    row = spark.createDataFrame([(said, fonts, sizes)], "t string, f array<string>, s array<double>")
    assert row.select(text.footer_issues("t", F.col("f"), F.col("s")).alias("x")).first()["x"] == issues


def test_content_is_preferred_where_the_declared_box_is_off(value):
    from quillspark.functions import visual

    box = lambda *x: G.box(*map(F.lit, map(float, x)))
    page = F.lit(612.0 * 792.0)
    ask = lambda a, b: value(visual.prefers_content(a, b, page))
    assert ask(box(0, 0, 100, 100), box(0, 0, 95, 95)) is False
    assert ask(box(0, 0, 100, 100), box(50, 50, 150, 150)) is True  # little of it inside
    assert ask(box(0, 0, 60, 100), box(0, 0, 100, 100)) is True  # much narrower
    assert ask(box(0, 0, 600, 700), box(0, 0, 500, 300)) is True  # most of the page, for less than a third of it
    assert ask(box(0, 0, 100, 100), box(0, 0, 0, 0)) is False
    assert ask(F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"), box(0, 0, 1, 1)) is True


def test_list_report(spark):
    from quillspark.operators import anchors

    runs = spark.createDataFrame([(1, 1, "decimal"), (1, 1, "decimal"), (1, 2, "lowerLetter"), (1, 0, "bullet"), (2, 0, "bullet")], "doc_id long, list_id long, kind string")
    assert {tuple(r) for r in anchors.list_report(runs).collect()} == {(1, 3, 1, 2), (2, 0, 1, 0)}

"""Strict transcription by hand, and against a plain version with Python's expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import equations, transcription


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("x=2", "x = 2"), ("Answer: yâ‰¤3", "y≤3"), ("3. -> a+b = c ->", "a + b = c"), ("x = = = 4", "x = 4"), ("a = 1 + + b", "a = 1 + b"),
        ("x2 × 3", "x2 × 3"), ("y = 4 (page 12)", "y = 4"), ("y = 4 chapter nine x = 5", "y = 4"), ("f(x) = _ _ _ + 2", "f(x) = ___ + 2"), ("1-2 a-b", "1 - 2 a - b"),
        ("only words here", ""), ("", ""), (None, ""), ("see {z} x^2 = 16 | y1", "x ^ 2 = 16"), ("• n = 7 •", "n = 7"),
    ],
)
def test_by_hand(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(transcription.strict_transcription("t").alias("x")).first()
    assert row.x == expected


def tidy(s):
    return " ".join((s or "").split())


def raw(s):
    return any(x in s for x in ("=", "^", "_", "\\frac", "\\sqrt", "≤", "≥", "×", "÷", "·", "−", "–", "—")) or bool(re.search(r"\d\s*[/=+\-]\s*\d", s)) or bool(re.search(r"\b[a-zA-Z]\d+\b", s))


def words(s):
    return "=" in s or any(x in s.lower() for x in ("fraction", "squared", "numerator", "denominator", "plus", "minus")) or sum(c.isascii() and c.isalpha() for c in s) >= 2 and any(c.isdigit() for c in s)


def plain(s, quality):
    s = re.sub(r"^(alt text|alt|answer|response)[:\-]\s*", "", tidy(s).strip("\"'` "), flags=re.I)
    for bad, good in transcription.MISREAD.items():
        s = s.replace(bad, good)
    for p in (r"\(page\s+\d+\)", r"\bpage\s+\d+\b", r"\banswers?\b.*$", r"\bchapter\b.*$", r"\bspss\b.*$", r"\bcont\.?\b.*$", r"\b(document|image)\b.*$"):
        s = re.sub(p, "", s, flags=re.I)
    s = tidy(s)
    for p in (r"^\s*\d+\.\s*", r"^\s*(->|=>|→|←|↔)\s*", r"\s*(->|=>|→|←|↔)\s*$", r"^\s*[•·▪◦]+\s*", r"\s*[•·▪◦]+\s*$"):
        s = re.sub(p, "", s)
    s = tidy(re.sub(r"\s*(->|=>|→|←|↔)\s*", " ", tidy(s)))
    blanks = lambda x: tidy(re.sub(r"(?<![A-Za-z0-9])(?:[-–—]\s*){3,}(?![A-Za-z0-9])", " ___ ", re.sub(r"(?<![A-Za-z0-9])(?:_\s*){2,}(?![A-Za-z0-9])", " ___ ", x)))
    s = blanks(s)
    spans = [tidy(x).strip(" \t\r\n,;:") for x in re.findall(r"[A-Za-z0-9_+\-=/^().,<>≤≥×÷·\s]+", s)]
    spans = [x for x in spans if x and (raw(x) or words(x))]
    s = max(spans, key=lambda x: (quality(x), len(x))) if spans else s
    s = tidy(re.sub(r"[^0-9A-Za-z_+\-=/^().,<>≤≥×÷·\s]", " ", s))
    for _ in range(4):
        s = tidy(re.sub(r"(?<=[A-Za-z0-9_)\]])\s*([+=])\s*(?:\1\s*)+(?=[A-Za-z0-9_(\[]|___)", r" \1 ", s))
    s = re.sub(r"(?<=[A-Za-z0-9_)])-(?=[A-Za-z_(])", " - ", re.sub(r"(?<=\d)-(?=\d)", " - ", s))
    s = tidy(re.sub(r"\s*([×÷·])\s*", r" \1 ", re.sub(r"\s*([=+/^<>])\s*", r" \1 ", s)))
    s = blanks(s).strip(" \t\r\n,;:")
    return s if s and (raw(s) or words(s)) else ""


def test_against_a_plain_version(spark):
    rng = random.Random(4)
    parts = ["x", "=", "= =", "+", "2", "12.5", "y1", "page 3", "answers", "the", "fraction", "___", "- - -", "->", "•", "Ã—", "≤", "(a", "b)", "{", "|", "a-b", "3-4", ",", ";", "plus", "x^2", "Image", "\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(12))) for _ in range(600)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(4)
    got = {r.k: r.x for r in rows.select("k", transcription.strict_transcription("t").alias("x")).collect()}
    asked = set()
    for t in texts:
        plain(t, lambda x: asked.add(x) or 0)
    known = {r.s: r.q for r in spark.createDataFrame([(x,) for x in asked], "s string").select("s", equations.quality("s").alias("q")).collect()}
    wrong = [(t, got[k], plain(t, known.__getitem__)) for k, t in enumerate(texts) if got[k] != plain(t, known.__getitem__)]
    assert not wrong, wrong[:5]
    assert sum(x != "" for x in got.values()) > 200

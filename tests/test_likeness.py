"""The ratio of two texts against difflib's, and the alignment made of it, in Spark, against the plain table."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest

from quillspark.functions import likeness
from quillspark.plans import compare
from test_compare import paragraphs, plain_align

ALPHABETS = ["ab", "aaabxyz", "abcdefghij", "etaoinshrdlu ,.", "abcdefghijklmnopqrstuvwxyz .,ETA", "".join(map(chr, range(0x4E00, 0x4E80))), "\x00\x01ab\U0001f600́", "thereinan "]


def texts(rng):
    letters = rng.choice(ALPHABETS)
    weights = [rng.random() ** 3 + 0.001 for _ in letters]
    most = rng.choice([3, 12, 60, 199, 260, 600])
    a, b = ("".join(rng.choices(letters, weights, k=rng.randrange(most))) for _ in "ab")
    if rng.random() < 0.5:  # alike, or parts of one another
        k, n = sorted(rng.randrange(len(a) + 1) for _ in "ab")
        b = rng.choice([a[:k] + b[:20] + a[n:], b + a[k:], a[k:] + a[:k], a[:k] + a[k + 1 :], a[k:n], a + a])
    return a, b


@pytest.mark.parametrize("piece", [1, 2, 5, 8, 1000])
def test_ratio_is_that_of_difflib(monkeypatch, piece):
    monkeypatch.setattr(likeness, "PIECE", piece)
    monkeypatch.setattr(likeness, "LONG", 2 * piece - 1)
    rng = random.Random(piece)
    for _ in range(600):
        a, b = texts(rng)
        assert likeness.ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


@pytest.mark.parametrize("size", [199, 200, 201, 299, 300])
def test_frequent_characters_at_their_limits(size):
    """From 200 characters on, a character is frequent with more than one in a hundred and one."""
    for times in (size // 100, size // 100 + 1, size // 100 + 2):
        b = ("z" * times + "".join(chr(0x3000 + k) for k in range(size)))[:size]
        for a in ("z", "zz", "q" + b[times - 1 : times + 5], b[5:] + "z", "z" * 300, ""):
            assert likeness.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
            assert likeness.ratio(b, a) == SequenceMatcher(None, b, a).ratio()


def test_unlike_conversations_need_none_of_difflibs_windows(monkeypatch):
    """F16: five turns against five of up to 1,800 letters took difflib thousands of windows, each read character by character."""
    rng = random.Random(16)
    syllables = "th er an in re on ti es en at ed nd ha to or ea ou is it ly sh bl wh".split()

    def turn(k):
        text = " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(rng.choice([5, 30, 250])))
        return {"pair": 1, "idx": k, "text": text.capitalize() + ".", "page": 0, "x_norm": 0.1, "y_norm": (k + 1) / 10, "role": "user", "doc_y": (k + 1) / 10, "normal": text, "comparison": text}

    left, right = (pd.DataFrame([turn(k) for k in range(5)]) for _ in "lr")
    want = plain_align(left, right)
    asked, find = [], SequenceMatcher.find_longest_match
    monkeypatch.setattr(SequenceMatcher, "find_longest_match", lambda *x: asked.append(1) or find(*x))
    assert compare.align(left, right).values.tolist() == want.values.tolist()
    assert len(asked) < 100


def test_moves_by_cell_and_by_diagonals_are_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(60):
        m, n = rng.integers(1, 20, 2)
        table = rng.integers(-2, 9, (m, n)) / 8  # with ties
        table[rng.random((m, n)) < 0.02] = np.nan
        costs = [rng.choice([0.08, 0.12, 0.125, 0.18], k) for k in (m, n)]
        found = []
        for short in (0, 10**9):
            monkeypatch.setattr(compare, "SHORT", short)
            found.append(compare.best_moves(table, *costs))
        for a, b in zip(*found, strict=True):
            assert np.array_equal(a, b, equal_nan=True)


@pytest.mark.parametrize("orders", [False, True])
def test_pairs_in_spark_against_the_plain_table(spark, orders):
    """Several pairs, some with one side only, with roles, places and orders missing."""
    rng = random.Random(7)
    kinds = "pair long, idx long, text string, page long, x_norm double, y_norm double, role string, doc_y double, normal string, comparison string" + ", reading_order double, sequence_order double" * orders
    names = [x.split()[0] for x in kinds.split(", ")]
    sides, want = ([], []), []
    for pair in range(12):
        left = paragraphs(rng, rng.randrange(1, 9), orders=orders)
        right = paragraphs(rng, rng.randrange(1, 9), like=left, orders=orders)
        if pair == 3:
            left[0]["y_norm"] = None
        left, right = (left, []) if pair == 5 else ([], right) if pair == 6 else (left, right)
        for side, rows in zip(sides, (left, right), strict=True):
            side.extend(x | {"pair": pair} for x in rows)
        if left and right:
            want += plain_align(*(pd.DataFrame([x | {"pair": pair} for x in rows]) for rows in (left, right))).values.tolist()
    frames = [spark.createDataFrame([tuple(x[c] for c in names) for x in rng.sample(side, len(side))], kinds) for side in sides]
    got = [list(x) for x in compare.aligned(*frames).orderBy("pair", "n").collect()]
    assert len(got) > 20
    assert got == want

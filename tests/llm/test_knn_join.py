"""Exact top-k against all products, over rows with and without structure, odd vectors, ties, and tiles and groups of a few rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import knn_join

SCHEMA = "vec_id long, embedding array<double>, score int, rank string, grp int, row int, id int, v string, cell int, asked int"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def plain(rows, k=5, every=50):
    held = lambda x: max(LOW, min(HIGH, math.floor(256.0 * x)))
    taken = [(i, [held(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in taken:
        if q % every == 0:
            scores = sorted((-max(LOW, min(HIGH, sum(x * y for x, y in zip(a, b, strict=False)))), i) for i, b in taken if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, parts=3, every=50, **how):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, "v", 5, 6) for r in rows], SCHEMA).repartition(parts)
    got = knn_join.search(df, F.col("vec_id") % every == 0, **how)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def clustered(n, wide, seed=0, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, wide))
    return [(i, [float(x) for x in centres[i % 8] + spread * rng.normal(size=wide)]) for i in range(n)]


@pytest.mark.parametrize(("how", "parts", "every"), [({}, 3, 50), ({"tile": 16, "queries": 3}, 5, 5), ({"most_pivots": 2, "k": 3}, 2, 7), ({"most_pivots": 1000, "k": 40, "tile": 50}, 1, 9)])
def test_clusters(spark, how, parts, every):
    rows = clustered(600, 12)
    assert found(spark, rows, parts, every, **how) == plain(rows, how.get("k", 5), every)


def test_rows_without_structure_and_ties(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(4)]) for i in range(700)]
    assert found(spark, rows, 4, 10, tile=64, queries=8) == plain(rows, 5, 10)


def test_only_what_may_be_among_the_best_is_sent(spark, monkeypatch):
    sent = []
    rows = clustered(3000, 6, spread=0.01)
    real = spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or real(value))
    got = found(spark, rows, 4, 4, tile=100)
    blocks = next(x for x in sent if isinstance(x, dict))
    assert got == plain(rows, 5, 4)
    assert len(blocks) >= 4
    assert sum(n for n, _ in blocks.values()) < len(blocks) * 3000 / 100 / 2  # less than half of all rows for each group


def test_odd_vectors(spark):
    rows = clustered(120, 5) + [(None, [1.0] * 5), (200, None), (250, []), (300, [1.0]), (350, [0.0] * 9), (400, [1.0, None, 2.0]), (450, [float("nan")] * 5), (500, [1.0, float("inf")]), (550, [-1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])]
    rows += [rows[0], rows[0], (50, [9.0] * 5), (7, [-9.0] * 5), (7, [-9.0] * 5)]
    assert found(spark, rows, 3) == plain(rows)
    assert found(spark, rows, 1, k=1000) == plain(rows, 1000)


def test_sums_beyond_doubles_and_beyond_64_bits(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-(1 << 24), 1 << 24)) for _ in range(6)]) for i in range(200)]
    assert found(spark, rows, 2, 10) == plain(rows, 5, 10)
    rows += [(1000 + i, [s * 1e300, s * 3.0, 1e15]) for i, s in enumerate([1, -1, 1, 2])]
    assert found(spark, rows, 2, 10, tile=40) == plain(rows, 5, 10)


def test_equal_vectors_make_up_most_rows(spark):
    rows = [(i, [0.5, 0.25, -0.5]) for i in range(900)] + clustered(100, 3)
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    assert found(spark, rows, 6, 50, tile=100) == plain(rows)


def test_few_or_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0])]) == []
    assert found(spark, [(50, [1.0])]) == []
    assert found(spark, [(50, [1.0]), (1, [2.0])]) == [(50, 1, 1, 256 * 512)]

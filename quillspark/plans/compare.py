"""Comparison of two documents: ordered alignment, differences, reflow runs.

Paragraphs: pair (of documents), idx, text, page, x_norm, y_norm, role. A task streams through its pairs and holds the two sides of one at a time; the
alignment table grows with the product of their paragraphs, not with the collection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.likeness import ratio
from quillspark.operators import folds, ordered

ALIGNED = "pair long, n long, left_idx long, right_idx long, score double, similarity double"
LEAST_SCORE = 0.45
#: By what paragraphs are put in order, and where those without a place in an order stand.
READ = ("sequence_order", "page", "reading_order", "y_norm", "x_norm", "idx")
LAST = 10**9


def score(a: pd.Series, b: pd.Series, raw: float, normal: float) -> float:
    near = lambda c: 1 - min(abs(a[c] - b[c]), 1)
    value = 0.34 * raw + 0.46 * normal + 0.12 * near("y_norm") + 0.05 * near("x_norm") + 0.02 * near("doc_y") + 0.01 / (1 + abs(a["page"] - b["page"]))
    if a["role"] and b["role"]:
        value += 0.05 if a["role"] == b["role"] else -0.08 if {a["role"], b["role"]} & {"image", "equation"} else 0
    for order, most in (("reading_order", 0.05), ("sequence_order", 0.08)):
        if pd.notna(a.get(order)) and pd.notna(b.get(order)):
            value += most / (1 + abs(a[order] - b[order]))
    return round(value, 6)


def skip_cost(normal: str) -> float:
    return 0.08 if not normal else 0.12 if len(normal) <= 6 else 0.18


def ratio_bounds(left: list[str], right: list[str]) -> np.ndarray:
    """What no ratio can exceed: twice the characters that both have, over all of them. Equal texts have 1, and no bound is below the ratio."""
    codes = np.frombuffer("".join(left + right).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    place = np.cumsum(np.bincount(codes, minlength=1) > 0) - 1  # of each code point that occurs
    width, lengths = max(1, int(place[-1]) + 1), [len(x) for x in left + right]
    cells = np.repeat(np.arange(len(lengths)) * width, lengths) + place[codes]
    counts = np.split(np.bincount(cells, minlength=len(lengths) * width).reshape(-1, width).astype(np.int32), [len(left)])
    sizes = [x.sum(axis=1) for x in counts]
    shared = np.stack([np.minimum(row, counts[1]).sum(axis=1) for row in counts[0]])  # a row of pairs at a time
    total = sizes[0][:, None] + sizes[1][None, :]
    return np.where(total > 0, 2 * shared / np.maximum(1, total), 1.0)


def score_bounds(left: list[dict], right: list[dict]) -> np.ndarray:
    """What no score() of a pair can exceed."""
    of = lambda side, c: np.array([x[c] for x in side], dtype=float)
    near = lambda c: 1 - np.minimum(np.abs(of(left, c)[:, None] - of(right, c)[None, :]), 1)
    texts = [ratio_bounds([x[c] for x in left], [x[c] for x in right]) for c in ("text", "normal")]
    value = 0.34 * texts[0] + 0.46 * texts[1] + 0.12 * near("y_norm") + 0.05 * near("x_norm") + 0.02 * near("doc_y") + 0.01 / (1 + np.abs(of(left, "page")[:, None] - of(right, "page")[None, :]))
    roles = [np.array([x["role"] or "" for x in side], dtype=object) for side in (left, right)]
    value += np.where((roles[0][:, None] == roles[1][None, :]) & (roles[0] != "")[:, None], 0.05, 0.0)
    for order, most in (("reading_order", 0.05), ("sequence_order", 0.08)):
        if order in left[0] and order in right[0]:
            value += np.nan_to_num(most / (1 + np.abs(of(left, order)[:, None] - of(right, order)[None, :])))
    return value + 2e-6  # for rounding


#: Cells of a table for each of its diagonals up to which Python is quicker than numpy.
SHORT = 50


def best_moves(scores: np.ndarray, down: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best total up to every pair of prefixes and the move that leads there: 0 pairs, 1 skips left, 2 skips right; a pairing wins a tie over skipping left, that over skipping right. By diagonals, or cell by cell where those are too short to pay."""
    m, n = scores.shape
    best, move = np.zeros((m + 1, n + 1)), np.zeros((m + 1, n + 1), dtype=np.int8)
    best[1:, 0], best[0, 1:] = -np.cumsum(down), -np.cumsum(across)
    if m * n <= SHORT * (m + n):
        return moves_by_cell(scores, down, across, best, move)
    for d in range(2, m + n + 1):
        i = np.arange(max(1, d - n), min(m, d - 1) + 1)
        j = d - i
        paired, up, side = best[i - 1, j - 1] + scores[i - 1, j - 1], best[i - 1, j] - down[i - 1], best[i, j - 1] - across[j - 1]
        chosen = (up > paired).astype(np.int8)
        top = np.where(chosen == 1, up, paired)
        chosen[side > top] = 2
        move[i, j], best[i, j] = chosen, np.where(chosen == 2, side, top)
    return best, move


def moves_by_cell(scores: np.ndarray, down: np.ndarray, across: np.ndarray, best: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    totals, moves, costs = best.tolist(), move.tolist(), across.tolist()
    for i, (line, skip) in enumerate(zip(scores.tolist(), down.tolist(), strict=True)):
        above, here, chosen = totals[i], totals[i + 1], moves[i + 1]
        for j, (paired, cost) in enumerate(zip(line, costs, strict=True)):
            top, step = above[j] + paired, 0
            if (up := above[j + 1] - skip) > top:
                top, step = up, 1
            if (side := here[j] - cost) > top:
                top, step = side, 2
            here[j + 1], chosen[j + 1] = top, step
    return np.array(totals), np.array(moves, dtype=np.int8)


def pairings(move: np.ndarray) -> list[tuple[int, int]]:
    """The pairs on the best way, from the end."""
    i, j = move.shape[0] - 1, move.shape[1] - 1
    out = []
    while i and j:
        if move[i, j] == 0:
            i, j = i - 1, j - 1
            out.append((i, j))
        else:
            i, j = (i - 1, j) if move[i, j] == 1 else (i, j - 1)
    return out


#: Rounds in which only the pairs on the best way are scored, before all that may be on it are.
ROUNDS = 8


def in_order(rows: list[dict]) -> list[dict]:
    """Paragraphs as they are read: numbers that are missing come last, orders that are missing stand at LAST."""

    def place(x: dict) -> list[tuple]:
        values = [LAST if c.endswith("_order") and missing(x[c]) else x[c] for c in READ if c in x]
        return [(True, 0) if missing(v) else (False, v) for v in values]

    return sorted(rows, key=place)


def missing(value: float | None) -> bool:
    return value is None or math.isnan(value)


def align(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """way_of() for one pair of documents as frames."""
    rows = [(x["pair"], *found) for x in left[:1].to_dict("records") for found in way_of(left.to_dict("records"), right.to_dict("records"))]
    return pd.DataFrame({c.split()[0]: pd.Series([x[k] for x in rows], dtype="float64" if c.endswith("double") else "int64") for k, c in enumerate(ALIGNED.split(", "))})


def way_of(left: list[dict], right: list[dict]) -> Iterator[tuple]:
    """The best order-keeping pairing of two documents, skips at a cost; ties as in best_moves(): n, left_idx, right_idx, score, similarity. Pairs of too low a score are left out.

    Scores start as bounds. The best way by bounds is found, its pairs are scored, and so on until all pairs of the best way are scored: no other way can be better then, as bounds are never below scores, and none wins a tie
    that it would not have won. After some rounds every pair is scored that lies on a way not known to be worse. So alike documents cost a little more than their length, and others no more than all pairs."""
    if not left or not right:
        return
    left, right = in_order(left), in_order(right)
    ratios: dict[tuple[str, str], float] = {}

    def known(a: str, b: str) -> float:
        if (a, b) not in ratios:
            ratios[a, b] = 1.0 if a == b else ratio(a, b)
        return ratios[a, b]

    down, across = (np.array([skip_cost(x["normal"]) for x in side]) for side in (left, right))
    scores = score_bounds(left, right)
    exact = np.zeros(scores.shape, dtype=bool)
    least, rounds = -np.inf, 0
    while True:
        best, move = best_moves(scores, down, across)
        way = pairings(move)
        wanted = [c for c in way if not exact[c]]
        if not wanted:
            break
        rounds += 1
        if rounds > ROUNDS:
            back, _ = best_moves(scores[::-1, ::-1], down[::-1], across[::-1])
            through = best[:-1, :-1] + scores + back[::-1, ::-1][1:, 1:]
            wanted = [(i, j) for j, i in np.argwhere(((through >= least - 1e-9) & ~exact).T).tolist()]  # by right texts
        for i, j in wanted:
            a, b = left[i], right[j]
            scores[i, j], exact[i, j] = score(a, b, known(a["text"], b["text"]), known(a["normal"], b["normal"])), True
        on_left, on_right = {i for i, _ in way}, {j for _, j in way}
        total = sum(scores[c] for c in way) - sum(c for k, c in enumerate(down) if k not in on_left) - sum(c for k, c in enumerate(across) if k not in on_right)
        least = max(least, total)
    kept = [c for c in way[::-1] if scores[c] >= LEAST_SCORE]
    for n, (i, j) in enumerate(kept):
        yield n, left[i]["idx"], right[j]["idx"], float(scores[i, j]), known(left[i]["comparison"], right[j]["comparison"])


def prepared(paragraphs: DataFrame) -> DataFrame:
    """Valid paragraphs with their normal forms, and with reading_order and sequence_order if they have them."""
    orders = [c for c in ("reading_order", "sequence_order") if c in paragraphs.columns]
    rows = paragraphs.where(T.is_valid_paragraph("text", F.col("y_norm")))
    doc_y = F.col("page") + F.col("y_norm") if "doc_y" not in paragraphs.columns else F.col("doc_y")
    rows = rows.select("pair", "idx", F.coalesce("text", F.lit("")).alias("text"), "page", "x_norm", "y_norm", "role", doc_y.alias("doc_y"), T.normal_for_alignment("text").alias("normal"), T.normal_for_comparison("text").alias("comparison"), *orders)
    return rows.withColumn("formula", T.normal_is_equation_like(F.col("comparison")))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair, n, left_idx, right_idx, score, similarity; both sides as prepared() gives them."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(math.nan)).alias(c)
    places, texts = ("page", "x_norm", "y_norm", "doc_y"), ["idx", "text", "role", "normal", "comparison", *[c for c in READ if c.endswith("_order") and c in left.columns and c in right.columns]]
    side = lambda df, k: df.select("pair", F.lit(k).alias("side"), *texts, *map(number, places))

    def fold(_: int, rows: list) -> Iterator[tuple]:
        found = [x._asdict() for x in rows]
        return way_of([x for x in found if x["side"] == 0], [x for x in found if x["side"] == 1])

    return folds.each_document(side(left, 0).unionByName(side(right, 1)), "pair", ["side"], fold, ALIGNED)


def differences(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Aligned pairs with their issues; those without any are left out."""
    side = lambda df, name: df.select("pair", F.col("idx").alias(f"{name}_idx"), *[F.col(c).alias(f"{name}_{c}") for c in ("formula", "page", "x_norm", "y_norm")])
    rows = pairs.join(side(left, "left"), ["pair", "left_idx"]).join(side(right, "right"), ["pair", "right_idx"])
    moved, indent, pages = F.abs(F.col("left_y_norm") - F.col("right_y_norm")), F.abs(F.col("left_x_norm") - F.col("right_x_norm")), F.abs(F.col("left_page") - F.col("right_page"))
    formula = F.col("left_formula") | F.col("right_formula")
    same = F.col("similarity") >= 0.93
    mismatch = (F.col("score") < 0.85) & (F.col("similarity") < 0.78) & ~formula
    changed_formula = formula & (F.col("similarity") < 0.7)
    issues = F.array_compact(
        F.array(
            F.when(pages >= 1, "CROSS_PAGE_ALIGNMENT"),
            F.when(mismatch, "TEXT_MISMATCH").when((F.col("similarity") < 0.6) & ~formula, "CONTENT_CHANGE"),
            F.when((indent > 0.28) & ~same, "INDENTATION_MISMATCH"),
            F.when(moved > 0.30, "MAJOR_POSITION_SHIFT").when(moved > 0.15, "PAGE_SHIFT").when(moved > 0.07, "MINOR_POSITION_SHIFT"),
            F.when(changed_formula, "EQUATION_OR_GRAPHIC_CHANGE"),
        )
    )
    kind = F.when(same & (moved > 0.07), "reflow-candidate").when(changed_formula, "visual-structure-change").otherwise("content-change")
    rows = rows.select("pair", "n", "left_idx", "right_idx", "score", "similarity", issues.alias("issues"), kind.alias("classification"), moved.alias("distance"), "left_page", "right_page", F.col("left_y_norm").alias("left_y"), F.col("right_y_norm").alias("right_y"))
    return rows.where(F.size("issues") > 0)


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair, n (of the first aligned pair), classification, span, distance: the differences of two documents, reflow runs as one row."""
    left, right = prepared(left), prepared(right)
    found = differences(aligned(left, right), left, right)
    return ordered.collapse_reflow(found, ["pair"], ["n"]).select("pair", "n", "classification", "span", "distance")

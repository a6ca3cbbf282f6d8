"""The alignment against the plain table of all scores."""

import random

import numpy as np
import pandas as pd
import pytest

from quillspark.plans import compare
from quillspark.plans.compare import ALIGNED, LAST, LEAST_SCORE, ratio, score, skip_cost


def plain_align(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The best order-keeping pairing of two documents, skips at a cost; a pairing wins a tie over skipping left, that over skipping right. Pairs of too low a score are left out."""
    none = pd.DataFrame({c.split()[0]: pd.Series(dtype="float64" if c.endswith("double") else "int64") for c in ALIGNED.split(", ")})
    if left.empty or right.empty:
        return none
    order = [c for c in ("sequence_order", "page", "reading_order", "y_norm", "x_norm", "idx") if c in left]
    last = {c: LAST for c in order if c.endswith("_order")}
    left, right = (x.loc[x[order].fillna(last).sort_values(order, kind="stable").index].to_dict("records") for x in (left, right))
    ratios: dict[tuple[str, str], float] = {}

    def known(a: str, b: str) -> float:
        if (a, b) not in ratios:
            ratios[a, b] = 1.0 if a == b else ratio(a, b)
        return ratios[a, b]

    m, n = len(left), len(right)
    down, across = [skip_cost(x["normal"]) for x in left], [skip_cost(x["normal"]) for x in right]
    scores = np.array([[score(a, b, known(a["text"], b["text"]), known(a["normal"], b["normal"])) for b in right] for a in left])
    best = np.zeros((m + 1, n + 1))
    best[1:, 0], best[0, 1:] = -np.cumsum(down), -np.cumsum(across)
    move = np.zeros((m + 1, n + 1), dtype=np.int8)
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            options = (best[i - 1, j - 1] + scores[i - 1, j - 1], best[i - 1, j] - down[i - 1], best[i, j - 1] - across[j - 1])
            move[i, j] = 1 if options[1] > options[0] else 0
            top = options[move[i, j]]
            if options[2] > top:
                move[i, j], top = 2, options[2]
            best[i, j] = top
    out, i, j = [], m, n
    while i and j:
        if not move[i, j]:
            i, j = i - 1, j - 1
            if scores[i, j] >= LEAST_SCORE:
                out.append((left[i]["pair"], 0, left[i]["idx"], right[j]["idx"], scores[i, j], known(left[i]["comparison"], right[j]["comparison"])))
        elif move[i, j] == 1:
            i -= 1
        else:
            j -= 1
    if not out:
        return none
    frame = pd.DataFrame(out[::-1], columns=[c.split()[0] for c in ALIGNED.split(", ")])
    frame["n"] = range(len(frame))
    return frame


WORDS = "alpha beta gamma delta x = 2 y + 3 the of and rows".split()


def paragraphs(rng, n, like=None, orders=False):
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 14)))
        if like is not None and rng.random() < 0.7:
            text = rng.choice([like[min(k, len(like) - 1)]["text"], like[rng.randrange(len(like))]["text"] + " more"])
        row = {"pair": 1, "idx": k, "text": text, "page": k // 7, "x_norm": rng.choice([0.1, 0.3]), "y_norm": (k % 7 + 1) / 10, "role": rng.choice(["text", "image", "equation", None, ""])}
        row |= {"doc_y": row["page"] + row["y_norm"], "normal": rng.choice([text, "", text[:5]]), "comparison": text}
        if orders:
            row |= {"reading_order": rng.choice([None, float(k)]), "sequence_order": float(k)}
        rows.append(row)
    return rows


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_against_the_plain_table(monkeypatch, rounds):
    monkeypatch.setattr(compare, "ROUNDS", rounds)
    rng = random.Random(rounds)
    for k in range(60):
        left = paragraphs(rng, rng.randrange(1, 25), orders=k % 3 == 0)
        right = paragraphs(rng, rng.randrange(1, 25), like=left if k % 2 else None, orders=k % 3 == 0)
        a, b = pd.DataFrame(left), pd.DataFrame(right)
        got, want = compare.align(a, b), plain_align(a, b)
        assert got.values.tolist() == want.values.tolist()


def test_bounds_are_never_below(monkeypatch):
    rng = random.Random(3)
    for orders in (False, True):
        left, right = paragraphs(rng, 20, orders=orders), paragraphs(rng, 20, orders=orders)
        bounds = compare.score_bounds(left, right)
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                assert bounds[i, j] >= score(a, b, ratio(a["text"], b["text"]), ratio(a["normal"], b["normal"]))


def test_alike_documents_are_scored_along_their_way(monkeypatch):
    """Two documents of 1,500 paragraphs with some changes: few of the 2.25 million pairs are scored."""
    rng = random.Random(8)
    left = [{"pair": 1, "idx": k, "text": f"paragraph {k} " + " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(12)), "page": k // 20, "x_norm": 0.1, "y_norm": k % 20 / 20, "role": "text"} for k in range(1500)]
    right = [dict(x, text=x["text"] + " changed") if k % 50 == 7 else x for k, x in enumerate(left) if k % 100 != 3]
    for rows in (left, right):
        for x in rows:
            x |= {"doc_y": x["page"] + x["y_norm"], "normal": x["text"], "comparison": x["text"]}
    asked = []
    monkeypatch.setattr(compare, "ratio", lambda a, b: asked.append(1) or ratio(a, b))
    got = compare.align(pd.DataFrame(left), pd.DataFrame(right))
    assert got[["left_idx", "right_idx"]].values.tolist() == [[x["idx"], x["idx"]] for x in right]
    assert len(asked) < 20_000

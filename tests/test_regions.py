"""Regions against plain loops."""

import random
import re

from test_style_map import maths, normal

from quillspark.operators import regions, style_map

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def fragment(s):
    s = (s or "").strip()
    if not s:
        return False
    return maths(s) or len(re.findall("[A-Za-z]{2,}", s)) < 3 and (bool(re.fullmatch(r"[A-Za-z]|[=+\-/*^()\[\]]|[A-Za-z]?\d+(?:\.\d+)?", s)) or any(x in s for x in "×·≤≥") or len(s) <= 8 and any(c.isdigit() for c in s))


def united(boxes):
    return style_map.united(boxes)


def wide(b, x, y):
    return max(0.0, b[0] - x), max(0.0, b[1] - y), min(1.0, b[2] + x), min(1.0, b[3] + y)


def plain(lines, pictures, paths):
    """The regions of one document, in loops over its pages."""
    out, n, m, p = [], 0, 0, 0
    for page in sorted({r[0] for r in lines} | {r[0] for r in pictures} | {r[0] for r in paths}):
        texts = []
        for block in sorted({r[1] for r in lines if r[0] == page}):
            mine = sorted((r for r in lines if r[:2] == (page, block) and r[4] and r[3]), key=lambda r: r[2])
            said = "\n".join(r[4] for r in mine).strip()
            if said:
                texts.append((said, united(r[3] for r in mine)))
                out.append(("text", n, page, texts[-1][1], said, None, None))
                n += 1
            rows = []
            for r in mine:
                middle = rows and sum(united(x[3] for x in rows[-1])[1::2]) / 2
                if rows and abs((r[3][1] + r[3][3]) / 2 - middle) <= 0.012:
                    rows[-1].append(r)
                else:
                    rows.append([r])
            for row in rows:
                parts = [r for r in row if fragment(r[4])]
                said = " ".join(r[4].strip() for r in parts)
                if parts and (len(parts) > 1 or maths(said)):
                    out.append(("equation_line", m, page, wide(united(r[3] for r in parts), 0.004, 0.003), said, None, None))
                    m += 1
        for r in sorted(r for r in pictures if r[0] == page):
            out.append(("image", p, page, r[2], None, None, None))
            p += 1
        clusters = []
        for r in sorted((r for r in paths if r[0] == page), key=lambda r: r[1]):
            box = tuple(f(0.0 if f is max else 1.0, v) for f, v in zip((max, max, min, min), r[2], strict=True))
            w, h = box[2] - box[0], box[3] - box[1]
            if w <= 0 and h <= 0 or w < 0.002 and h < 0.002:
                continue
            meet = lambda a, b: not (a[2] < b[0] or b[2] < a[0] or a[3] < b[1] or b[3] < a[1])
            met = [c for c in clusters if meet(wide(box, 0.01, 0.012), wide(c[0], 0.01, 0.012))]  # noqa: B023
            if met:
                met[0][:] = united([box, *(c[0] for c in met)]), 1 + sum(c[1] for c in met)
                for c in met[1:]:
                    clusters.remove(c)
            else:
                clusters.append([box, 1])
        for box, count in clusters:
            w, h = box[2] - box[0], box[3] - box[1]
            held = [t for t, b in texts if box[0] - 0.01 <= (b[0] + b[2]) / 2 <= box[2] + 0.01 and box[1] - 0.01 <= (b[1] + b[3]) / 2 <= box[3] + 0.01]
            chars = sum(len(normal(t)) for t in held)
            if w >= 0.35 and h <= 0.012 or h >= 0.35 and w <= 0.012 or w * h < 0.01 and count < 6 or max(w, h) < 0.08 or len(held) >= 4 and chars >= 28:
                continue
            out.append(("vector", p, page, box, None, len(held), chars))
            p += 1
    return out


def test_against_loops(spark):
    rng = random.Random(2)
    said = ["x = 2", "+", "3", "the rows of a table", "a", "y^2", "", "  ", "and so on it goes", "12.5", "p4", "2 × 3", "(b)"]
    line_rows, picture_rows, path_rows, docs = [], [], [], {}
    for d in range(12):
        lines, pictures, paths = [], [], []
        for page in range(rng.randrange(1, 4)):
            for block in range(rng.randrange(6)):
                y = rng.random() * 0.8
                for line in range(rng.randrange(1, 7)):
                    y += rng.choice([0.0, 0.004, 0.03])
                    x = rng.random() * 0.6
                    lines.append((page, block, line, (x, y, x + 0.1 + rng.random() * 0.2, y + 0.02), rng.choice(said)))
            pictures += [(page, k, (0.1 * k, 0.1, 0.1 * k + 0.05, 0.2)) for k in range(rng.randrange(3))]
            for n in range(rng.randrange(40)):
                x, y = rng.random() * 1.1 - 0.05, rng.random() * 1.1 - 0.05
                w, h = rng.choice([(0.0, 0.0), (0.001, 0.001), (0.5, 0.002), (0.03, 0.03), (0.09, 0.05), (0.0, 0.1)])
                paths.append((page, n, (x, y, x + w, y + h)))
        docs[d] = lines, pictures, paths
        line_rows += [(d, *r) for r in lines]
        picture_rows += [(d, *r) for r in pictures]
        path_rows += [(d, *r) for r in paths]
    frame = spark.createDataFrame
    lines = frame([*line_rows, (99, 0, 0, 0, None, "x = 1"), (99, 0, 0, 1, (0.0, 0.0, 1.0, 1.0), None)], f"doc_id long, page int, block int, line int, box {BOX}, text string").repartition(3)
    pictures, paths = frame(picture_rows, f"doc_id long, page int, block int, box {BOX}"), frame(path_rows, f"doc_id long, page int, n int, box {BOX}")
    got = {}
    for r in regions.regions(lines, pictures, paths).collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["n"], r["page"], tuple(round(v, 9) for v in r["box"]), r["text"], r["text_blocks"], r["text_chars"]))
    want = {d: [(k, n, p, tuple(round(v, 9) for v in b), *rest) for k, n, p, b, *rest in plain(*x)] for d, x in docs.items()}
    key = lambda r: (r[0], r[1])
    assert {d: sorted(x, key=key) for d, x in got.items()} == {d: sorted(x, key=key) for d, x in want.items() if x}
    assert {r[0] for x in got.values() for r in x} == {"text", "equation_line", "image", "vector"}

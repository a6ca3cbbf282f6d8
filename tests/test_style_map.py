"""The style map against plain loops over all blocks, on generated documents with repeated, held and similar texts."""

import random
import re
from difflib import SequenceMatcher

import pytest

from quillspark.operators import style_map

ELEMENTS = "doc_id long, part string, idx long, role string, text string, width_pt double, height_pt double, is_visual boolean, has_alt_text boolean, first_row boolean, first_column boolean, repeat_header boolean, row_break boolean, fonts array<string>, sizes array<double>"
BLOCKS = "doc_id long, kind string, n long, page long, box struct<x0: double, y0: double, x1: double, y1: double>, text string, text_blocks long, text_chars long"


def normal(s):
    return re.sub("[^a-z0-9 ]", "", re.sub(r"\s+", " ", (s or "").lower())).strip()


def same(a, b):
    a, b = sorted((normal(a), normal(b)), key=len)
    return bool(a) and (a == b or len(a) >= 10 and a in b)


def ratio(a, b):
    return SequenceMatcher(None, normal(a), normal(b)).ratio()


def typeset(s):
    s = (s or "").strip()
    if len(s) < 3 or len(re.findall(r"\b[\w']+\b", s)) >= 8 and len(re.findall("[A-Za-z]{2,}", s)) >= 5 or re.search(r"\b(answers?|chapter|section|exercise|problem|review|solutions?)\b", s, re.I):
        return False
    digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
    return any(x in s for x in "=+/^×÷·≤≥") and (digits >= 1 or letters >= 2) or sum(x in s for x in "()[]") >= 2 and (digits >= 1 or bool(re.search(r"\b[a-z]\b", s.lower()))) or bool(re.search(r"\b[a-z]\s*=\s*.", s.lower()))


def maths(s):
    s = (s or "").strip()
    return typeset(s) or any(c.isdigit() for c in s) and bool(re.search(r"[=+\-/*^()²³¼½¾≤≥]", s))


def signature(s):
    return set(re.findall(r"\d+", normal(s))), set(re.findall(r"\b[a-z]\b", normal(s)))


def alike(a, b):
    (n, v), (m, w) = signature(a), signature(b)
    return (2.5 if same(a, b) else 0) + len(n & m) * 0.7 + len(v & w) * 0.4 + (0.8 if maths(b) else 0)


def points_class(w, h):
    return None if not w or not h else "small" if w * h <= 1800 and max(w, h) <= 72 else "medium" if w * h <= 12000 and max(w, h) <= 180 else "large"


def plain(elements, blocks):
    """(map_index, part, idx, role, kind, first, last, page, box) of one document, every search over all blocks."""
    of = lambda *kinds: sorted((b for b in blocks if b["kind"] in kinds), key=lambda b: b["n"])
    texts, lines, pictures = of("text"), of("equation_line"), of("image", "vector")
    used = {"text": set(), "line": set(), "near": set(), "picture": set()}
    at = {"text": 0, "line": 0, "picture": 0}
    turn = lambda start, n: [*range(start, n), *range(min(start, n))]
    page = None

    def most_similar(e):
        best = None
        if not normal(e["text"]):
            return None
        for k, b in enumerate(texts):
            score = ratio(e["text"], b["text"]) * 0.88 + 1 / (1 + abs(e["idx"] - k)) * 0.12
            if best is None or score > best[0]:
                best = score, k
        return best and best[1]

    def by_text(e):
        k = next((k for k in turn(at["text"], len(texts)) if k not in used["text"] and same(e["text"], texts[k]["text"])), None)
        if k is not None:
            used["text"].add(k)
        else:
            k = most_similar(e)
        if k is not None:
            at["text"] = k + 1
            return "text", k, k, texts[k]["page"], texts[k]["box"]

    def scored(candidates, score, least):
        best = None
        for k in candidates:
            if best is None or score(k) > best[0]:
                best = score(k), k
        return None if best is None or best[0] < least else best[1]

    def equation(e):
        start = at["text"]
        score = lambda k: alike(e["text"], texts[k]["text"]) + (0.6 if page is not None and texts[k]["page"] == page else 0) + 0.2 / (1 + abs(k - start))
        k = scored([k for k in turn(start, len(texts)) if k not in used["text"] and maths(texts[k]["text"])], score, 0.8)
        if k is None:
            return by_text(e)
        used["text"].add(k)
        at["text"] = k + 1
        return "text", k, k, texts[k]["page"], texts[k]["box"]

    def run(k):
        out, box = [k], lines[k]["box"]
        for j in range(k + 1, min(k + 3, len(lines))):
            b = lines[j]
            if j in used["line"] or b["page"] != lines[k]["page"] or b["box"][1] - box[3] > 0.04 or style_map.overlap(box, b["box"]) < 0.35:
                break
            out.append(j)
            box = style_map.united([box, b["box"]])
        return out, box

    def visual_line(e, size, aspect):
        start = at["line"]

        def score(k):
            js, box = run(k)
            text = " ".join(lines[j]["text"] or "" for j in js)
            value = 0 if page is None else 1.8 if lines[k]["page"] == page else -0.4
            value += 0 if not size else 1.6 if style_map.size_class(box) == size else -0.8
            value += style_map.shape_score(aspect, box)
            value += 0.6 if maths(text) else 0.3 if any(x in text for x in "=+-/^") else 0
            return value - abs(k - start) * 0.03

        k = scored([k for k in turn(start, len(lines)) if k not in used["line"]], score, 0.45)
        if k is None:
            return None
        js, box = run(k)
        used["line"].update(js)
        at["line"] = max(start, js[-1] + 1)
        return "equation_line", k, js[-1], lines[k]["page"], (max(0.0, box[0] - 0.004), max(0.0, box[1] - 0.004), min(1.0, box[2] + 0.004), min(1.0, box[3] + 0.004))

    def picture(e, size, aspect, visual):
        start = at["picture"]

        def score(k):
            b = pictures[k]
            value = 0 if page is None else 2.0 if b["page"] == page else -0.4
            value += 0 if not size else 1.6 if style_map.size_class(b["box"]) == size else -0.8
            value += style_map.shape_score(aspect, b["box"])
            if b["kind"] == "vector":
                value -= 0.45 * b["text_blocks"] if b["text_blocks"] >= 3 else 0
                value -= min(1.6, b["text_chars"] / 30) if b["text_chars"] >= 18 else 0
                value -= 2.2 if visual and (b["text_blocks"] >= 2 or b["text_chars"] >= 10) else 0
            return value - abs(k - start) * 0.03

        free = [k for k in turn(start, len(pictures)) if k not in used["picture"]]
        k = scored(free, score, 0.25)
        if k is None and size:
            k = next((k for k in free if (page is None or pictures[k]["page"] == page) and style_map.size_class(pictures[k]["box"]) == size), None)
            k = next((k for k in free if style_map.size_class(pictures[k]["box"]) == size), None) if k is None else k
        if k is None and not visual:
            k = next((k for k in free if page is not None and pictures[k]["page"] == page), None)
            k = next(iter(free), None) if k is None else k
        if k is None:
            return None
        used["picture"].add(k)
        at["picture"] = max(start, k + 1)
        return pictures[k]["kind"], k, k, pictures[k]["page"], pictures[k]["box"]

    def near(e):
        start = at["text"]
        for steps in ((-1, 0, 1), (-2, 2, -3, 3)):
            free = [start + s for s in steps if 0 <= start + s < len(texts)]
            free = [k for k in free if (page is None or texts[k]["page"] == page) and k not in used["near"] and (texts[k]["text"] or "").strip()]
            score = lambda k: alike(e["text"], texts[k]["text"]) + (0.4 if any(x in texts[k]["text"] for x in "=+/^()[]") else 0) + (0.6 if page is not None and texts[k]["page"] == page else 0) + (0.35 if k < start else 0) - 0.35 * abs(k - start)
            k = scored(free, score, 1.0)
            if k is not None:
                used["near"].add(k)
                return "text", k, k, texts[k]["page"], texts[k]["box"]
        return None

    def table(e):
        rows = [x.strip() for x in (e["text"] or "").split("\n") if normal(x)]
        if not (e["text"] or "").strip():
            return None
        found = [k for k, b in enumerate(texts) if k not in used["text"] and any(same(x, b["text"]) for x in rows)]
        used["text"].update(found)
        found = found or [k for k, b in enumerate(texts) if any(ratio(x, b["text"]) >= 0.46 for x in rows)]
        if not found:
            k = most_similar(e)
            return None if k is None else ("text", k, k, texts[k]["page"], texts[k]["box"])
        counts = {}
        for k in found:
            counts[texts[k]["page"]] = counts.get(texts[k]["page"], 0) + 1
        best = max(counts, key=counts.get)
        box = style_map.united([texts[k]["box"] for k in found if texts[k]["page"] == best])
        more = [p["box"] for p in pictures if p["page"] == best and box[0] - 0.08 <= (p["box"][0] + p["box"][2]) / 2 <= box[2] + 0.08 and box[1] - 0.08 <= (p["box"][1] + p["box"][3]) / 2 <= box[3] + 0.08]
        return "table", found[0], found[-1], best, style_map.united([box, *more])

    def repeated(part):
        for k, b in enumerate(texts):
            if b["box"][1] <= 0.22 if part == "header" else b["box"][3] >= 0.78:
                e = next((e for e in elements if e["part"] == part and same(e["text"], b["text"])), None)
                if e is not None:
                    yield [e, ("text", k, k, b["page"], b["box"])]

    items = list(repeated("header"))
    for e in (e for e in elements if e["part"] == "body"):
        visual = e["role"] == "equation" and (bool(e["is_visual"]) or not normal(e["text"]))
        size = points_class(e["width_pt"], e["height_pt"]) or ("small" if visual else None)
        aspect = e["width_pt"] / e["height_pt"] if e["width_pt"] and e["height_pt"] else None
        if visual:
            found = visual_line(e, size, aspect) or picture(e, size, aspect, True) or near(e)
        elif e["role"] == "equation":
            found = equation(e)
        else:
            found = {"image": lambda e: picture(e, size, aspect, False), "table": table, "empty": lambda e: None}.get(e["role"], by_text)(e)  # noqa: B023
        page = found[3] if found and found[3] is not None else page
        items.append([e, found])
    items += list(repeated("footer"))
    places = [[E(e["role"]), found] for e, found in items]
    style_map.filled(places)  # has a test of its own
    items = [[e, found] for (e, _), (_, found) in zip(items, places, strict=True)]
    return [(k, e["part"], e["idx"], e["role"], *(found[:4] if found else (None,) * 4), *(found[4] if found else (None,) * 4)) for k, (e, found) in enumerate(items)]


WORDS = "x = 2 y + 3 the sum of 4/5 a b (c) rows and columns equal number section 12 x^2 total page é".split()


def document(seed, n):
    rng = random.Random(seed)
    say = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 9)))
    texts = [say() for _ in range(n)]
    box = lambda: (x := rng.random() * 0.6, y := rng.random() * 0.9, x + 0.02 + rng.random() * 0.35, y + 0.01 + rng.random() * 0.3)
    elements = []
    for k in range(n):
        role = rng.choice(["normal_text", "normal_text", "heading", "equation", "equation", "image", "table", "empty"])
        text = "" if role == "empty" else "\n".join(rng.choice(texts) for _ in range(3)) if role == "table" else rng.choice([rng.choice(texts), rng.choice(texts) + " more", say()])
        elements.append({"part": "body", "idx": k, "role": role, "text": text, "width_pt": rng.choice([None, 0.0, 40.0, 150.0, 400.0]), "height_pt": rng.choice([None, 20.0, 60.0, 300.0]), "is_visual": rng.choice([True, False, None])})
    for part in ("header", "footer"):
        elements += [{"part": part, "idx": k, "role": part, "text": rng.choice(texts), "width_pt": None, "height_pt": None, "is_visual": None} for k in range(rng.randrange(3))]
    blocks = []
    for kind, many in (("text", n), ("equation_line", n // 3), ("picture", n // 3)):
        for k in range(many):
            own = rng.choice(["image", "vector"]) if kind == "picture" else kind
            text = None if kind == "picture" else rng.choice([rng.choice(texts), rng.choice(texts), say(), "before it " + rng.choice(texts)])
            blocks.append({"kind": own, "n": k, "page": 1 + k * 4 // n, "box": box(), "text": text, "text_blocks": rng.randrange(5), "text_chars": rng.randrange(40)})
    return elements, blocks


def frames(spark, docs):
    es = [(d, e["part"], e["idx"], e["role"], e["text"], e["width_pt"], e["height_pt"], e["is_visual"], *(None,) * 7) for d, (x, _) in docs.items() for e in x]
    bs = [(d, b["kind"], b["n"], b["page"], b["box"], b["text"], b["text_blocks"], b["text_chars"]) for d, (_, y) in docs.items() for b in y]
    return spark.createDataFrame(es, ELEMENTS), spark.createDataFrame(bs, BLOCKS)


def rounded(rows):
    return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows]


def test_against_plain_loops(spark):
    docs = {k: document(k, n) for k, n in enumerate([1, 3, 12, 12, 20, 30, 30, 40, 40, 60, 80, 80])}
    got = {}
    for r in style_map.placed_items(*frames(spark, docs)).orderBy("doc_id", "map_index").collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for d, (elements, blocks) in docs.items():
        assert rounded(got.get(d, [])) == rounded(plain(elements, blocks)), d
    kinds = {r[4] for rows in got.values() for r in rows}
    assert kinds >= {"text", "equation_line", "image", "vector", "table", "between", "beside"}


def test_many_equal_lines_are_taken_in_turn(spark):
    n = 3000
    elements = [{"part": "body", "idx": k, "role": "normal_text", "text": "the same long line", "width_pt": None, "height_pt": None, "is_visual": None} for k in range(n)]
    blocks = [{"kind": "text", "n": k, "page": 1 + k // 50, "box": (0.0, 0.3, 1.0, 0.4), "text": "the same long line", "text_blocks": 0, "text_chars": 0} for k in range(n)]
    rows = style_map.placed_items(*frames(spark, {1: (elements, blocks)})).collect()
    assert sorted((r.idx, r.first_block) for r in rows) == [(k, k) for k in range(n)]


def test_no_blocks_no_elements(spark):
    elements, blocks = document(3, 12)
    empty_blocks = style_map.placed_items(*frames(spark, {1: (elements, [])})).collect()
    assert len(empty_blocks) == 12 and all(r.page is None and r.kind is None for r in empty_blocks)
    assert style_map.placed_items(*frames(spark, {1: ([], blocks)})).collect() == []
    assert style_map.placed_items(*frames(spark, {})).collect() == []


class E:
    def __init__(self, role):
        self.role = role


@pytest.mark.parametrize(
    ("found", "expected"),
    [
        ([(1, 0.1, 0.2), None, (1, 0.5, 0.6)], ("between", 1, 0.204, 0.496)),
        ([(1, 0.1, 0.2), None, (2, 0.5, 0.6)], ("beside", 2, 0.604, 0.624)),
        ([None, (2, 0.5, 0.6)], ("beside", 2, 0.47, 0.496)),
        ([(3, 0.5, 0.96), None], ("beside", 3, 0.964, 0.984)),
        ([(3, 0.5, 0.99), None], ("beside", 3, 0.97, 0.99)),
        ([None], None),
    ],
)
def test_filled(found, expected):
    items = [[E("empty" if f is None else "text"), None if f is None else ("text", 0, 0, f[0], (0.0, f[1], 1.0, f[2]))] for f in found]
    style_map.filled(items)
    got = items[found.index(None)][1]
    assert (got if got is None else (got[0], got[3], round(got[4][1], 6), round(got[4][3], 6))) == expected


def test_texts_held_in_others_are_found_from_few_runs():
    import random
    from collections import namedtuple

    rng, block = random.Random(5), namedtuple("block", "normal is_math tokens page y0 y1")
    whole = ["".join(rng.choice("ab ") for _ in range(rng.randrange(40))).strip() for _ in range(150)]
    said = whole + [t[i : i + n] for t in whole for i, n in [(rng.randrange(20), rng.randrange(8, 14))]]
    texts = style_map.Texts([block(t, False, [], 0, 0.0, 0.0) for t in said])
    for t in (*said, *("".join(rng.choice("ab ") for _ in range(rng.randrange(60))) for _ in range(50))):
        assert texts.same_texts(t) == sorted({x for x in said if style_map.same(t, x)})
        assert list(style_map.counts_of(t)) == [t.count(chr(c)) for c in style_map.ALPHABET]
    long = " ".join(str(rng.random()) for _ in range(500))
    kept = style_map.Texts([block(long, False, [], 0, 0.0, 0.0)]).holding
    assert sum(map(len, kept.values())) <= len(long) / style_map.STEP + 1  # not an entry a character

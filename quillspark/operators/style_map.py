"""The style map: every element of a document with its place on the pages, by greedy assignment to what the pages hold, and what is wrong with the elements.

elements: doc_id, part (header, body or footer), idx, role, text, width_pt, height_pt (of its drawing), is_visual (an equation drawn as an object or picture).
blocks: doc_id, kind (text, equation_line, image or vector), n (its place among its kind, pictures and vectors together), page, box, text, text_blocks and text_chars (text that a vector block covers).

Elements of the body take blocks in order; what is taken is not taken again, and later elements look from behind the last one first, then from the beginning:

    text          the first text block that is the same (or holds it, or is held in it, from ten characters on), else the most similar one, taken or not: 0.88 of the ratio and 0.12 for being near
    equation      the best block of mathematics by shared numbers and letters (0.7 and 0.4), sameness (2.5), page (0.6) and nearness, from 0.8 on; else as a text
    visual        the best run of up to three equation lines (0.45), else the best picture, else the best text up to three blocks away (1.0)
    image         the best picture by page, size class, shape and nearness (0.25), else one of its size class, of its page, or any
    table         all blocks that are the same as one of its lines, on the page that has most, with the pictures in reach; else those similar to a line from 0.46 on
    empty         between its neighbours, when all others have their places
    header, footer   each text block of that zone with the first element of the part that is the same

The assignment depends on all before it, so it is a fold; a task streams through its documents one at a time. It is no product of elements and blocks: blocks are found by their whole
texts, by runs of a few characters, by numbers and letters, each distinct text once; taken ones are stepped over in near-constant time; what is scored by nearness is looked for only as far as a score can still be had; and before the
ratio of two texts is taken, a bound on it by counts of characters leaves the few that could be best.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import equations
from quillspark.functions import geometry as G
from quillspark.functions import text as T
from quillspark.operators.anchors import FOOTER_START, HEADER_END
from quillspark.operators.folds import each_document

#: Characters that two different texts must share in a row for one to hold the other. Of a text's runs of RUN characters every STEP-th is kept: of STEP runs in a row one is among them, and HELD characters have so many.
HELD, RUN, STEP = 10, 6, 5
#: No picture further away than this reaches its least score, 0.25 of 4.8 at 0.03 a place; no equation line 0.45 of 5.2.
PICTURE_REACH, LINE_REACH = 152, 159
ALPHABET = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789 ", dtype=np.uint8)

Box = tuple[float, float, float, float]


class Free:
    """Ascending places of which some are taken; the nearest free one on either side, in near-constant time."""

    def __init__(self, places: list[int]):
        self.places = places
        self.after, self.before = list(range(len(places) + 1)), list(range(len(places) + 1))

    @staticmethod
    def _end(chain: list[int], i: int) -> int:
        end = i
        while chain[end] != end:
            end = chain[end]
        while chain[i] != end:
            chain[i], i = end, chain[i]
        return end

    def first(self, start: int, taken: set[int]) -> int | None:
        """The first free place from `start` on."""
        i = self._end(self.after, bisect_left(self.places, start))
        while i < len(self.places) and self.places[i] in taken:
            self.after[i] = i + 1
            i = self._end(self.after, i)
        return self.places[i] if i < len(self.places) else None

    def last(self, end: int, taken: set[int]) -> int | None:
        """The last free place before `end`."""
        i = self._end(self.before, bisect_left(self.places, end))
        while i and self.places[i - 1] in taken:
            self.before[i] = i - 1
            i = self._end(self.before, i)
        return self.places[i - 1] if i else None

    def around(self, start: int, taken: set[int]) -> Iterator[int]:
        for place in (self.first(start, taken), self.last(start, taken)):
            if place is not None:
                yield place

    def in_turn(self, start: int, taken: set[int]) -> int | None:
        """The first free place from `start` on, else from the beginning."""
        place = self.first(start, taken)
        return self.first(0, taken) if place is None else place


def united(boxes: Iterable[Box]) -> Box | None:
    boxes = list(boxes)
    return (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else None


def same(a: str, b: str) -> bool:
    short, long = sorted((a, b), key=len)
    return bool(short) and (a == b or len(short) >= HELD and short in long)


def size_class(box: Box) -> str:
    wide, high = max(0.0, box[2] - box[0]), max(0.0, box[3] - box[1])
    area, edge = wide * high, max(wide, high)
    return "small" if area <= 0.006 and edge <= 0.18 else "medium" if area <= 0.04 and edge <= 0.38 else "large"


def shape_score(expected: float | None, box: Box) -> float:
    wide, high = max(0.0, box[2] - box[0]), max(0.0, box[3] - box[1])
    if not expected or not wide or not high:
        return 0.0
    found = wide / high
    return max(0.0, 1.2 - abs(expected - found) / max(expected, found) * 2.4)


def overlap(a: Box, b: Box) -> float:
    shared, narrow = min(a[2], b[2]) - max(a[0], b[0]), min(a[2] - a[0], b[2] - b[0])
    return shared / narrow if shared > 0 and narrow > 0 else 0.0


class Texts:
    """A document's text blocks, by what they say."""

    def __init__(self, blocks: list):
        self.blocks = blocks
        self.by_text: dict[str, list[int]] = defaultdict(list)
        for n, b in enumerate(blocks):
            self.by_text[b.normal].append(n)
        self.free = {t: Free(places) for t, places in self.by_text.items()}
        self.holding, self.opening = defaultdict(list), defaultdict(list)  # texts by every STEP-th of their runs, and by their first STEP ones
        for t in self.by_text:
            if len(t) >= HELD:
                for i in range(0, len(t) - RUN + 1, STEP):
                    self.holding[t[i : i + RUN]].append(t)
                for i in range(STEP):
                    self.opening[t[i : i + RUN]].append(t)
        self.known: dict[str, list[str]] = {}
        self.maths = [n for n, b in enumerate(blocks) if b.is_math]
        maths = set(self.maths)
        self.free_maths = self._by_page(self.maths)
        self.math_texts = {t: self._by_page([n for n in places if n in maths]) for t, places in self.by_text.items() if maths.intersection(places)}
        self.saying = defaultdict(set)
        for t in self.math_texts:
            for token in blocks[self.by_text[t][0]].tokens:
                self.saying[token].add(t)
        self.zone = [np.array([max(0.0, 0.18 - b.y0) for b in blocks]), np.array([max(0.0, b.y1 - 0.82) for b in blocks])]

    @cached_property
    def counts(self) -> np.ndarray:
        counts = np.zeros((len(self.blocks), len(ALPHABET)), dtype=np.int32)
        for t, places in self.by_text.items():
            counts[places] = counts_of(t)
        return counts

    @cached_property
    def sizes(self) -> np.ndarray:
        return self.counts.sum(axis=1)

    def _by_page(self, places: list[int]) -> dict[int | None, Free]:
        pages: dict[int | None, list[int]] = defaultdict(list)
        for n in places:
            pages[self.blocks[n].page].append(n)
        return {"all": Free(places)} | {("page", p): Free(x) for p, x in pages.items()}

    def same_texts(self, normal: str) -> list[str]:
        if normal not in self.known:
            found = {normal} & self.by_text.keys()
            if len(normal) >= HELD:
                found |= {t for t in {t for i in range(STEP) for t in self.holding.get(normal[i : i + RUN], ())} if normal in t}
                found |= {t for t in {t for i in range(0, len(normal) - RUN + 1, STEP) for t in self.opening.get(normal[i : i + RUN], ())} if t in normal}
            self.known[normal] = sorted(found) if normal else []
        return self.known[normal]

    def next_same(self, normal: str, start: int, taken: set[int]) -> int | None:
        frees = [self.free[t] for t in self.same_texts(normal)]
        for begin in (start, 0):
            places = [p for f in frees if (p := f.first(begin, taken)) is not None]
            if places:
                return min(places)
        return None

    def all_same(self, normals: list[str], taken: set[int]) -> list[int]:
        return sorted({n for x in normals for t in self.same_texts(x) for n in self.by_text[t] if n not in taken})

    def ratio_bound(self, normal: str) -> np.ndarray:
        counts = counts_of(normal)
        total = self.sizes + counts.sum()
        return 2 * np.minimum(self.counts, counts).sum(axis=1) / np.maximum(1, total)

    def most_similar(self, normal: str, idx: int, role: str) -> int | None:
        if not self.blocks or not normal:
            return None
        more = self.zone[0] if role == "header" else self.zone[1] if role == "footer" else np.zeros(len(self.blocks))
        near = 1 / (1 + np.abs(idx - np.arange(len(self.blocks)))) * 0.12
        bound = self.ratio_bound(normal) * 0.88 + near + more
        best, at, ratios = -1.0, None, {}
        for n in np.argsort(-bound, kind="stable"):
            if bound[n] + 1e-9 < best:
                break
            t = self.blocks[n].normal
            if t not in ratios:
                ratios[t] = SequenceMatcher(None, normal, t).ratio()
            score = ratios[t] * 0.88 + 1 / (1 + abs(idx - int(n))) * 0.12 + float(more[n])
            if score > best or (score == best and n < at):
                best, at = score, int(n)
        return at

    def similar_to_a_line(self, lines: list[str], least: float) -> list[int]:
        found, ratios = [], {}
        bounds = [self.ratio_bound(x) for x in lines]
        for n, b in enumerate(self.blocks):
            for x, bound in zip(lines, bounds, strict=True):
                if bound[n] + 1e-9 >= least:
                    if (x, b.normal) not in ratios:
                        ratios[x, b.normal] = SequenceMatcher(None, x, b.normal).ratio()
                    if ratios[x, b.normal] >= least:
                        found.append(n)
                        break
        return found


def counts_of(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("ascii", "ignore"), dtype=np.uint8), minlength=128)[ALPHABET].astype(np.int32)


class Anchors:
    """A document's blocks, what is taken of them, and where to look next."""

    def __init__(self, blocks: list):
        of = lambda *kinds: sorted((b for b in blocks if b.kind in kinds), key=lambda b: b.n)
        self.texts, self.lines, self.pictures = Texts(of("text")), of("equation_line"), of("image", "vector")
        self.taken_texts, self.taken_lines, self.taken_near, self.taken_pictures = set(), set(), set(), set()
        self.text_at = self.line_at = self.picture_at = 0
        self.page: int | None = None
        by: dict[object, list[int]] = defaultdict(list)
        for n, b in enumerate(self.pictures):
            kind = size_class(box_of(b))
            for key in ("all", ("page", b.page), ("class", kind), ("both", b.page, kind)):
                by[key].append(n)
        self.free_pictures = {k: Free(v) for k, v in by.items()}

    def text(self, e) -> tuple | None:
        n = self.texts.next_same(e.normal, self.text_at, self.taken_texts)
        if n is not None:
            self.taken_texts.add(n)
        else:
            n = self.texts.most_similar(e.normal, e.idx, e.role)
        return self._found_text(n)

    def _found_text(self, n: int | None) -> tuple | None:
        if n is None:
            return None
        self.text_at = n + 1
        return "text", n, n, self.texts.blocks[n].page, box_of(self.texts.blocks[n])

    def equation(self, e) -> tuple | None:
        t, start, taken = self.texts, self.text_at, self.taken_texts
        own = set(e.tokens)
        texts = {x for token in own for x in t.saying.get(token, ())} | {x for x in t.same_texts(e.normal) if x in t.math_texts}
        frees = [f for x in texts for k, f in t.math_texts[x].items() if k == "all" or k == ("page", self.page)]
        frees += [f for k, f in t.free_maths.items() if k == "all" or k == ("page", self.page)]

        def score(n: int) -> float:
            b = t.blocks[n]
            shared = own.intersection(b.tokens)
            numbers = sum(x[0].isdigit() for x in shared)
            value = (2.5 if same(e.normal, b.normal) else 0.0) + numbers * 0.7
            value += (len(shared) - numbers) * 0.4
            value += 0.8
            if self.page is not None and b.page == self.page:
                value += 0.6
            return value + 0.2 / (1 + abs(n - start))

        n = best_in_turn({n for f in frees for n in f.around(start, taken)}, start, score, 0.8)
        if n is None:
            return self.text(e)
        taken.add(n)
        return self._found_text(n)

    def _run(self, n: int) -> list[int]:
        """An equation line and up to two that follow close below it."""
        run, box = [n], box_of(self.lines[n])
        for k in range(n + 1, min(n + 3, len(self.lines))):
            b = self.lines[k]
            if k in self.taken_lines or b.page != self.lines[n].page or b.y0 - box[3] > 0.04 or overlap(box, box_of(b)) < 0.35:
                break
            run.append(k)
            box = united([box, box_of(b)])
        return run

    def equation_lines(self, e) -> tuple | None:
        start = self.line_at

        def score(n: int) -> float:
            run = self._run(n)
            box = united(box_of(self.lines[k]) for k in run)
            value = 0.0 if self.page is None else 1.8 if self.lines[n].page == self.page else -0.4
            if e.size_class:
                value += 1.6 if size_class(box) == e.size_class else -0.8
            value += shape_score(e.aspect, box)
            if getattr(self.lines[n], f"math{len(run)}"):
                value += 0.6
            elif any(self.lines[k].has_signs for k in run):
                value += 0.3
            return value - abs(n - start) * 0.03

        near = range(max(0, start - LINE_REACH), min(len(self.lines), start + LINE_REACH))
        n = best_in_turn({n for n in near if n not in self.taken_lines}, start, score, 0.45)
        if n is None:
            return None
        run = self._run(n)
        self.taken_lines.update(run)
        self.line_at = max(self.line_at, run[-1] + 1)
        b = united(box_of(self.lines[k]) for k in run)
        wide = max(0.0, b[0] - 0.004), max(0.0, b[1] - 0.004), min(1.0, b[2] + 0.004), min(1.0, b[3] + 0.004)
        return "equation_line", n, run[-1], self.lines[n].page, wide

    def picture(self, e) -> tuple | None:
        start, taken = self.picture_at, self.taken_pictures

        def score(n: int) -> float:
            b = self.pictures[n]
            value = 0.0 if self.page is None else 2.0 if b.page == self.page else -0.4
            if e.size_class:
                value += 1.6 if size_class(box_of(b)) == e.size_class else -0.8
            value += shape_score(e.aspect, box_of(b))
            if b.kind == "vector":
                if b.text_blocks >= 3:
                    value -= 0.45 * b.text_blocks
                if b.text_chars >= 18:
                    value -= min(1.6, b.text_chars / 30.0)
                if e.visual and (b.text_blocks >= 2 or b.text_chars >= 10):
                    value -= 2.2
            return value - abs(n - start) * 0.03

        near = range(max(0, start - PICTURE_REACH), min(len(self.pictures), start + PICTURE_REACH))
        n = best_in_turn({n for n in near if n not in taken}, start, score, 0.25)
        tries = []
        if e.size_class:
            tries += [("both", self.page, e.size_class) if self.page is not None else ("class", e.size_class), ("class", e.size_class)]
        if not e.visual:
            tries += ([("page", self.page)] if self.page is not None else []) + ["all"]
        for key in tries:
            if n is None and key in self.free_pictures:
                n = self.free_pictures[key].in_turn(start, taken)
        if n is None:
            return None
        taken.add(n)
        self.picture_at = max(start, n + 1)
        return self.pictures[n].kind, n, n, self.pictures[n].page, box_of(self.pictures[n])

    def nearby_text(self, e) -> tuple | None:
        start, blocks = self.text_at, self.texts.blocks

        def score(n: int) -> float:
            b = blocks[n]
            shared = set(e.tokens).intersection(b.tokens)
            numbers = sum(x[0].isdigit() for x in shared)
            value = (2.5 if same(e.normal, b.normal) else 0.0) + numbers * 0.7
            value += (len(shared) - numbers) * 0.4
            if b.is_math:
                value += 0.8
            if b.has_marks:
                value += 0.4
            if self.page is not None and b.page == self.page:
                value += 0.6
            if n < start:
                value += 0.35
            return value - 0.35 * abs(n - start)

        for steps in ((-1, 0, 1), (-2, 2, -3, 3)):
            places = [n for s in steps if 0 <= (n := start + s) < len(blocks) and n not in self.taken_near and blocks[n].filled and (self.page is None or blocks[n].page == self.page)]
            n = max(places, key=score, default=None)  # the first of the best, in this order
            if n is not None and score(n) >= 1.0:
                self.taken_near.add(n)
                return "text", n, n, blocks[n].page, box_of(blocks[n])
        return None

    def table(self, e) -> tuple | None:
        lines = [x for x in e.lines.split("\n") if x] if e.lines else []
        if e.has_lines:
            found = self.texts.all_same(lines, self.taken_texts)
            self.taken_texts.update(found)
            found = found or self.texts.similar_to_a_line(lines, 0.46)
            if found:
                blocks = [self.texts.blocks[n] for n in found]
                pages = [b.page for b in blocks]
                page = max(dict.fromkeys(pages), key=pages.count)
                box = united(box_of(b) for b in blocks if b.page == page)
                inside = lambda b: box[0] - 0.08 <= (b.x0 + b.x1) / 2 <= box[2] + 0.08 and box[1] - 0.08 <= (b.y0 + b.y1) / 2 <= box[3] + 0.08
                return "table", found[0], found[-1], page, united([box, *(box_of(b) for b in self.pictures if b.page == page and inside(b))])
            n = self.texts.most_similar(e.normal, e.idx, e.role)
            if n is not None:
                return "text", n, n, self.texts.blocks[n].page, box_of(self.texts.blocks[n])
        return None

    def place(self, e) -> tuple | None:
        found = None
        if e.role == "equation":
            found = (self.equation_lines(e) or self.picture(e) or self.nearby_text(e)) if e.visual else self.equation(e)
        elif e.role == "image":
            found = self.picture(e)
        elif e.role == "table":
            found = self.table(e)
        elif e.role != "empty":
            found = self.text(e)
        if found is not None and found[3] is not None:
            self.page = found[3]
        return found

    def repeated(self, elements: list, part: str) -> Iterator[tuple]:
        """Each text block in the part's zone with the first element that is the same."""
        first: dict[str, int | None] = {}
        for n, b in enumerate(self.texts.blocks):
            if b.y0 <= HEADER_END if part == "header" else b.y1 >= FOOTER_START:
                if b.normal not in first:
                    first[b.normal] = next((k for k, e in enumerate(elements) if same(e.normal, b.normal)), None)
                if (k := first[b.normal]) is not None:
                    yield elements[k], ("text", n, n, b.page, box_of(b))


def box_of(b) -> Box:
    return b.x0, b.y0, b.x1, b.y1


def best_in_turn(places: set[int], start: int, score: Callable[[int], float], least: float) -> int | None:
    """The place of the best score; of equal ones the first from `start` on, then from the beginning. None below `least`."""
    best = max(places, key=lambda n: (score(n), n >= start, -n), default=None)
    return None if best is None or score(best) < least else best


def filled(items: list[list]) -> None:
    """Places for empty items [e, found] without one, each from the nearest ones before and behind; those just filled serve the next ones."""
    ahead: list[tuple | None] = [None] * (len(items) + 1)
    for k in range(len(items) - 1, -1, -1):
        ahead[k] = items[k][1] if items[k][1] is not None else ahead[k + 1]
    before = None
    for k, item in enumerate(items):
        e, found = item
        if found is None and e.role == "empty":
            after = ahead[k + 1]
            if before and after and before[3] == after[3]:
                a, b = before[4], after[4]
                top = min(max(a[3] + 0.004, 0), 0.97)
                item[1] = "between", None, None, before[3], (min(a[0], b[0]), top, max(a[2], b[2]), max(min(b[1] - 0.004, 1), top + 0.012))
            elif after and not before:
                b = after[4]
                top = max(b[1] - 0.03, 0)
                item[1] = "beside", None, None, after[3], (b[0], top, b[2], max(top + 0.015, min(b[1] - 0.004, 1)))
            elif anchor := after or before:
                a = anchor[4]
                top = min(a[3] + 0.004, 0.97)
                item[1] = "beside", None, None, anchor[3], (a[0], top, a[2], min(top + 0.02, 0.995))
        before = item[1] or before


ITEMS = "doc_id {}, map_index long, part string, idx long, role string, kind string, first_block long, last_block long, page long, x0 double, y0 double, x1 double, y1 double"


def placed_items(elements: DataFrame, blocks: DataFrame) -> DataFrame:
    """The items of the map, in its order (headers, body, footers): doc_id, map_index, part, idx, role, and what the element was given: kind, first_block, last_block, page and box."""

    def fold(_: object, both: list) -> Iterator[tuple]:
        anchors = Anchors([r for r in both if r.is_block and r.x0 is not None])
        of = lambda part: [r for r in both if not r.is_block and r.part == part]
        items = [[e, x] for e, x in anchors.repeated(of("header"), "header")]
        items += [[e, anchors.place(e)] for e in of("body")]
        items += [[e, x] for e, x in anchors.repeated(of("footer"), "footer")]
        filled(items)
        for k, (e, found) in enumerate(items):
            kind, a, b, page, box = found or (None, None, None, None, (None,) * 4)
            yield k, e.part, e.idx, e.role, kind, a, b, page, *box

    normal, text = T.normal_for_style("text"), T.text_or_empty("text")
    tokens = F.array_distinct(F.regexp_extract_all(normal, F.lit(r"[0-9]+|\b[a-z]\b"), F.lit(0)))
    has_any = lambda c, signs: F.coalesce(c.rlike(signs), F.lit(False))
    order = Window.partitionBy("doc_id").orderBy("n")
    line = blocks.where("kind = 'equation_line'")
    several = lambda k: equations.is_math_text(F.array_join(F.array_compact(F.array("text", *[F.lead("text", j).over(order) for j in range(1, k)])), " "))
    math_lines = line.select("doc_id", "kind", "n", *[several(k).alias(f"math{k}") for k in (1, 2, 3)])
    b = F.col("box")
    whole = blocks.join(math_lines, ["doc_id", "kind", "n"], "left").select(
        "doc_id", F.lit(True).alias("is_block"), F.lit(None).cast("string").alias("part"), F.col("n").cast("long").alias("idx"), F.col("n").cast("long").alias("n"), F.lit(None).cast("string").alias("role"), "kind", normal.alias("normal"), tokens.alias("tokens"),
        F.col("page").cast("long").alias("page"), *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")], F.when(F.col("kind") == "text", equations.is_math_text("text")).alias("is_math"), has_any(text, r"[=+/^()\[\]]").alias("has_marks"), has_any(text, r"[=+\-/^]").alias("has_signs"), (F.trim(text) != "").alias("filled"),
        "math1", "math2", "math3", F.coalesce("text_blocks", F.lit(0)).cast("long").alias("text_blocks"), F.coalesce("text_chars", F.lit(0)).cast("long").alias("text_chars"),
    )
    w, h = F.col("width_pt"), F.col("height_pt")
    visual = (F.col("role") == "equation") & (F.coalesce("is_visual", F.lit(False)) | (normal == ""))
    lines = F.when(F.col("role") == "table", F.array_join(F.transform(F.split(text, "\n"), lambda x: T.normal_for_style(x)), "\n"))
    parts = elements.select(
        "doc_id", F.lit(False).alias("is_block"), "part", F.col("idx").cast("long").alias("idx"), "role", normal.alias("normal"), tokens.alias("tokens"), visual.alias("visual"), lines.alias("lines"), (F.trim(text) != "").alias("has_lines"),
        F.coalesce(F.when((w > 0) & (h > 0), G.size_class_of_points(w, h)), F.when(visual, "small")).alias("size_class"), F.when((w > 0) & (h > 0), w / h).alias("aspect"),
    )
    both = whole.unionByName(parts, allowMissingColumns=True)
    return each_document(both, "doc_id", ["is_block", "part", "idx"], fold, ITEMS.format(elements.schema["doc_id"].dataType.simpleString()))


def alerts(items: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, map_index, type, detail, page: what is wrong with the items of a map, in its order. Runs of empty paragraphs of the body are one alert, with their length; a picture without a text; a table without
    header row, first column, repeated header, or with rows that may break; a footer in other letters than footers are set in. elements: as for placed_items(), with has_alt_text, first_row, first_column,
    repeat_header, row_break, fonts and sizes. An item without a page is told of on the page of the nearest one that has one."""
    told = items.join(elements.select("doc_id", "part", "idx", "text", "has_alt_text", "first_row", "first_column", "repeat_header", "row_break", "fonts", "sizes"), ["doc_id", "part", "idx"])
    order = Window.partitionBy("doc_id").orderBy("map_index")
    empty = (F.col("role") == "empty") & (F.col("part") == "body")
    rows = told.withColumn("empty", empty).withColumn("run", F.sum(F.when(empty, 0).otherwise(1)).over(order))
    runs = rows.where("empty").groupBy("doc_id", "run").agg(F.min("map_index").alias("map_index"), F.count("*").alias("length"), F.min_by("page", "map_index").alias("page"))
    runs = runs.select("doc_id", "map_index", F.when(F.col("length") > 1, "double_empty_paragraph").otherwise("empty_paragraph").alias("type"), F.col("length").cast("string").alias("detail"), "page")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    missing = F.array_compact(F.array(
        F.when(no("first_row"), "header row"), F.when(no("first_column"), "first column"), F.when(no("repeat_header"), "repeat header row"),
        F.when(F.coalesce("row_break", F.lit(True)), "break across pages disabled"),
    ))
    checked = F.array_compact(F.array(
        F.when((F.col("role") == "image") & no("has_alt_text"), F.struct(F.lit("image_missing_alt_text").alias("type"), F.lit("").alias("detail"))),
        F.when((F.col("role") == "table") & (F.size(missing) > 0), F.struct(F.lit("table_missing_structure").alias("type"), F.array_join(missing, ", ").alias("detail"))),
        F.when((F.col("role") == "footer") & (F.col("part") == "footer") & (F.col("fonts").isNotNull() | F.col("sizes").isNotNull()), F.struct(F.lit("footer_format_mismatch").alias("type"), F.array_join(T.footer_issues("text", F.col("fonts"), F.col("sizes")), ", ").alias("detail"))),
    ))
    single = rows.select("doc_id", "map_index", "page", F.explode(checked).alias("a")).where("a.type <> 'footer_format_mismatch' or a.detail <> ''").select("doc_id", "map_index", "a.type", "a.detail", "page")
    return runs.unionByName(single)


def histogram(items: DataFrame) -> DataFrame:
    """doc_id, role, n."""
    return items.groupBy("doc_id", F.coalesce("role", F.lit("unknown")).alias("role")).agg(F.count("*").alias("n"))

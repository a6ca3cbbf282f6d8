"""Regions of pages from their raw lines, pictures and paths: text blocks, lines of equations, pictures and drawings, as the style map takes them.

lines: doc_id, page, block, line (its place in the block), box (parts of the page), text. pictures: doc_id, page, block, box. paths: doc_id, page, n, box.

Rows of a block and clusters of a page's paths grow as they are read, so both are folds. A task streams through its documents and holds a batch of them, or one; the folds take the first line of every block (or path of every
page), then every second, and so on, so that a step is a few operations on arrays and not a loop over rows. Places are numbered from 0 in reading order, pictures before drawings on each page. Boxes are held within the
page; null ones, and lines without text, are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import equations
from quillspark.functions import text as T
from quillspark.operators.folds import changed, whole_documents
from quillspark.session import cut, tasks_for

#: How far apart the middles of a row's lines may be; room around paths that belong together; the least size of a path.
ROW, REACH, LEAST_PATH = 0.012, (0.01, 0.012), 0.002
#: A rule is so long and so thin; a drawing of less area has so many paths; its long side; text from which on it is a page's text rather than a drawing.
RULE, SMALL_AREA, MANY_PATHS, LEAST_EDGE, MOST_TEXT = (0.35, 0.012), 0.01, 6, 0.08, (4, 28)
#: Room around an equation line; up to so many different texts are sent to every task; pairs of a drawing and a text that are looked at together.
AROUND, BROADCAST_TEXTS, PAIRS = (0.004, 0.003), 50_000, 1_000_000
SIDES = ["x0", "y0", "x1", "y1"]


def spoken(lines: DataFrame) -> DataFrame:
    """The lines that have text and a box."""
    return lines.where((T.text_or_empty("text") != "") & F.col("box").isNotNull())


def judged(lines: DataFrame) -> DataFrame:
    """lines with fragment and maths; each text is judged once, however many lines say it."""
    known = cut(lines.select("text").distinct().select(F.col("text").alias("said"), equations.is_equation_fragment("text").alias("fragment"), equations.is_math_text("text").alias("maths")))
    known = F.broadcast(known) if known.count() <= BROADCAST_TEXTS else known
    return lines.join(known, F.col("text") == F.col("said")).drop("said")


def sides(rows: pa.Table) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy() for c in SIDES])


def united(boxes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The boxes around the runs of boxes that begin at starts."""
    return np.stack([f.reduceat(x, starts) for f, x in zip((np.minimum, np.minimum, np.maximum, np.maximum), boxes, strict=True)])


def numbered(groups: np.ndarray) -> np.ndarray:
    """The place, from 0, of each element in its run of equal ones."""
    starts = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1))
    return np.arange(len(groups)) - np.repeat(starts, np.diff(starts, append=len(groups)))


def joined(texts: pa.Array, starts: np.ndarray, between: str) -> pa.Array:
    """The texts of each run that begins at starts, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(texts)), pa.int32()), texts), between)


def row_starts(first: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Whether a line begins a row: the first of its block does, and those the middle of which is not near that of the row before. first: where blocks begin."""
    out = np.zeros(len(y0), dtype=bool)
    out[first] = True
    sizes = np.diff(first, append=len(y0))
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    low, high = y0[first].copy(), y1[first].copy()
    for k in range(1, sizes[0]):
        n = np.searchsorted(-sizes, -k)  # blocks with more than k lines
        at = first[:n] + k
        near = np.abs((y0[at] + y1[at]) / 2 - (low[:n] + high[:n]) / 2) <= ROW
        out[at] = ~near
        low[:n], high[:n] = np.where(near, np.minimum(low[:n], y0[at]), y0[at]), np.where(near, np.maximum(high[:n], y1[at]), y1[at])
    return out


def said_regions(lines: DataFrame) -> DataFrame:
    """doc_id, kind, page, n, x0, y0, x1, y1, text: blocks that have any text, and lines of equations, both numbered through the document. The latter are rows of a block, the middles of which are near each
    other, as far as they are fragments of equations; one fragment alone must be mathematics. Lines without a document are in no equation."""
    kind = lines.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_documents(batches, "doc_id"):
            ids, page, text = (pa.concat_arrays(rows.column(c).chunks) for c in ("doc_id", "page", "text"))
            doc, starts, boxes = np.cumsum(changed(rows, ["doc_id"])), np.flatnonzero(changed(rows, ["doc_id", "page", "block"])), sides(rows)
            told = pc.utf8_trim(joined(text, starts, "\n"), " \t\r\n\f\x0b")
            some = np.flatnonzero(pc.not_equal(told, "").to_numpy(zero_copy_only=False))
            yield out("text", starts[some], doc, united(boxes, starts)[:, some], ids, page, told.take(pa.array(some)))

            line = np.cumsum(row_starts(starts, boxes[1], boxes[3]))
            part = np.flatnonzero(rows.column("fragment").to_numpy() & ids.is_valid().to_numpy(zero_copy_only=False))
            if not len(part):
                continue
            starts = np.flatnonzero(np.diff(line[part], prepend=0))
            box = united(boxes[:, part], starts) + np.array([[-AROUND[0]], [-AROUND[1]], [AROUND[0]], [AROUND[1]]])
            box = np.concatenate([np.maximum(0.0, box[:2]), np.minimum(1.0, box[2:])])
            some = np.flatnonzero((np.diff(starts, append=len(part)) > 1) | rows.column("maths").to_numpy()[part[starts]])
            told = joined(pc.utf8_trim_whitespace(text.take(pa.array(part))), starts, " ").take(pa.array(some))
            yield out("equation_line", part[starts[some]], doc, box[:, some], ids, page, told)

    def out(kind: str, at: np.ndarray, doc: np.ndarray, box: np.ndarray, ids: pa.Array, page: pa.Array, text: pa.Array) -> pa.RecordBatch:
        first = pa.array(at)
        return pa.RecordBatch.from_arrays([ids.take(first), pa.array([kind] * len(at), pa.string()), page.take(first), pa.array(numbered(doc[at])), *map(pa.array, box), text], ["doc_id", "kind", "page", "n", *SIDES, "text"])

    lines = spoken(lines)
    rows = judged(lines.select("doc_id", F.col("page").cast("long").alias("page"), "block", "line", *[F.col("box")[c].alias(c) for c in SIDES], "text"))
    rows = rows.repartition(tasks_for(lines), "doc_id").sortWithinPartitions("doc_id", "page", "block", "line", "text").drop("line")
    return rows.mapInArrow(run, f"doc_id {kind}, kind string, page long, n long, x0 double, y0 double, x1 double, y1 double, text string")


def widened(box: np.ndarray) -> np.ndarray:
    return np.stack([np.maximum(0.0, box[0] - REACH[0]), np.maximum(0.0, box[1] - REACH[1]), np.minimum(1.0, box[2] + REACH[0]), np.minimum(1.0, box[3] + REACH[1])])


def clustered(page: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """page, paths (how many) and box of each page's clusters, in order: a path joins the first cluster that it meets, with room around both, and draws the others that it meets into it. Pages of about the same number of
    paths go together, a path of each at a time."""
    first = np.flatnonzero(np.diff(page, prepend=-1))
    sizes = np.diff(first, append=len(page))
    found = [(np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros((4, 0)))]
    scale = np.frexp(sizes)[1]
    for s in np.unique(scale):
        mine = np.flatnonzero(scale == s)
        mine = mine[np.argsort(-sizes[mine], kind="stable")]
        at, size, many = first[mine], sizes[mine], len(mine)
        box, wide = np.zeros((4, many, size[0])), np.zeros((4, many, size[0]))
        wide[0] = np.inf  # of clusters that are not there, which nothing meets
        paths, used = np.zeros((many, size[0]), dtype=int), np.zeros(many, dtype=int)
        for k in range(size[0]):
            n, top = np.searchsorted(-size, -k), used.max()
            new = boxes[:, at[:n] + k]
            a, b = widened(new)[:, :, None], wide[:, :n, :top]
            met = ~((a[2] < b[0]) | (b[2] < a[0]) | (a[3] < b[1]) | (b[3] < a[1]))
            met_by = met.sum(axis=1)
            p = np.flatnonzero(met_by == 0)
            box[:, p, used[p]], wide[:, p, used[p]], paths[p, used[p]] = new[:, p], widened(new[:, p]), 1
            used[p] += 1
            p = np.flatnonzero(met_by)
            if not len(p):
                continue
            own = met[p].argmax(axis=1)
            both = lambda x, y: np.concatenate([np.minimum(x[:2], y[:2]), np.maximum(x[2:], y[2:])])
            grown, count = both(box[:, p, own], new[:, p]), paths[p, own] + 1
            for i in np.flatnonzero(met_by[p] > 1):
                others = np.flatnonzero(met[p[i]])
                grown[:, i] = both(grown[:, i], np.concatenate([box[:2, p[i], others].min(axis=1), box[2:, p[i], others].max(axis=1)]))
                count[i] += paths[p[i], others[1:]].sum()
                paths[p[i], others[1:]], wide[0, p[i], others[1:]] = 0, np.inf
            box[:, p, own], wide[:, p, own], paths[p, own] = grown, widened(grown), count
        p, c = np.nonzero(paths)
        found.append((page[at[p]], paths[p, c], box[:, p, c]))
    of, paths, box = (np.concatenate(x, axis=-1) for x in zip(*found, strict=True))
    order = np.argsort(of, kind="stable")
    return of[order], paths[order], box[:, order]


def texts_within(page: np.ndarray, box: np.ndarray, of: np.ndarray, x: np.ndarray, y: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many texts (of their page, their middle) each box of a page has in it, with a little room, and their characters. Both are in order of pages."""
    a, b, c, d = np.maximum(0.0, box[0] - 0.01), np.maximum(0.0, box[1] - 0.01), np.minimum(1.0, box[2] + 0.01), np.minimum(1.0, box[3] + 0.01)
    first = np.searchsorted(of, page)
    sizes = np.searchsorted(of, page, side="right") - first
    texts, length = np.zeros(len(page), dtype=np.int64), np.zeros(len(page), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(page):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        mine = sizes[at:to]
        i = np.repeat(np.arange(at, to), mine)
        j = np.repeat(first[at:to], mine) + np.arange(len(i)) - np.repeat(np.cumsum(mine) - mine, mine)
        within = (x[j] >= a[i]) & (x[j] <= c[i]) & (y[j] >= b[i]) & (y[j] <= d[i])
        texts += np.bincount(i[within], minlength=len(page))
        length += np.bincount(i[within], chars[j[within]], minlength=len(page)).astype(np.int64)
        at = to
    return texts, length


PICTURE, TEXT, PATH = range(3)


def shown_regions(pictures: DataFrame, paths: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, kind, page, n, x0, y0, x1, y1, text_blocks, text_chars: pictures, and the clusters of paths that are drawings, numbered through the document. text_blocks and text_chars: what text has its middle in
    a drawing. No rules are drawings, nothing small of a few paths, no text in a frame."""
    kind = paths.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_documents(batches, "doc_id"):
            ids, pages = (pa.concat_arrays(rows.column(c).chunks) for c in ("doc_id", "page"))
            start = changed(rows, ["doc_id", "page"])
            page, heads, what, boxes = np.cumsum(start) - 1, np.flatnonzero(start), rows.column("what").to_numpy(), sides(rows)
            held = np.concatenate([np.maximum(0.0, boxes[:2]), np.minimum(1.0, boxes[2:])])
            w, h = np.maximum(0.0, held[2] - held[0]), np.maximum(0.0, held[3] - held[1])
            drawn = (what == PATH) & ~(((w <= 0) & (h <= 0)) | ((w < LEAST_PATH) & (h < LEAST_PATH)))
            of, count, box = clustered(page[drawn], held[:, drawn])
            w, h = np.maximum(0.0, box[2] - box[0]), np.maximum(0.0, box[3] - box[1])
            rule = ((w >= RULE[0]) & (h <= RULE[1])) | ((h >= RULE[0]) & (w <= RULE[1]))
            some = ~rule & ~((w * h < SMALL_AREA) & (count < MANY_PATHS)) & (np.maximum(w, h) >= LEAST_EDGE)
            of, box = of[some], box[:, some]
            said = (what == TEXT) & pc.and_(ids.is_valid(), pages.is_valid()).to_numpy(zero_copy_only=False)
            texts, chars = texts_within(of, box, page[said], boxes[0][said], boxes[1][said], rows.column("chars").to_numpy()[said])
            some = ~((texts >= MOST_TEXT[0]) & (chars >= MOST_TEXT[1]))
            of, box, texts, chars = of[some], box[:, some], texts[some], chars[some]

            shown = what == PICTURE
            late = np.repeat([False, True], [shown.sum(), len(of)])
            place = np.concatenate([page[shown], of])
            order = np.argsort(place, kind="stable")  # pictures of a page first
            late, place, box = late[order], place[order], np.concatenate([boxes[:, shown], box], axis=1)[:, order]
            told = [pa.array(np.concatenate([np.zeros(shown.sum(), dtype=np.int64), x])[order], mask=~late) for x in (texts, chars)]
            at = pa.array(heads[place])
            n = numbered((np.cumsum(changed(rows, ["doc_id"])))[heads[place]])
            yield pa.RecordBatch.from_arrays([ids.take(at), pa.array(np.where(late, "vector", "image").astype(object), pa.string()), pages.take(at), pa.array(n), *map(pa.array, box), *told], ["doc_id", "kind", "page", "n", *SIDES, "text_blocks", "text_chars"])

    def rows(df: DataFrame, what: int, at: str) -> DataFrame:
        return df.where("box is not null").select("doc_id", F.col("page").cast("long").alias("page"), F.lit(what).alias("what"), F.col(at).cast("long").alias("at"), *[F.col("box")[c].alias(c) for c in SIDES], F.lit(0).cast("long").alias("chars"))

    x, y = ((F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in "xy")
    told = blocks.select("doc_id", "page", F.lit(TEXT).alias("what"), F.col("n").alias("at"), x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"), F.length(T.normal_for_style("text")).cast("long").alias("chars"))
    all_rows = rows(pictures, PICTURE, "block").unionByName(rows(paths, PATH, "n")).unionByName(told)
    all_rows = all_rows.repartition(tasks_for(paths), "doc_id").sortWithinPartitions("doc_id", "page", "what", "at").drop("at")
    return all_rows.mapInArrow(run, f"doc_id {kind}, kind string, page long, n long, x0 double, y0 double, x1 double, y1 double, text_blocks long, text_chars long")


def regions(lines: DataFrame, pictures: DataFrame, paths: DataFrame) -> DataFrame:
    """doc_id, kind (text, equation_line, image or vector), n, page, box, text, text_blocks, text_chars: what style_map.placed_items() takes as blocks."""
    said = cut(said_regions(lines))  # read twice
    shown = shown_regions(pictures, paths, said.where("kind = 'text'"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    box = F.struct(*SIDES).alias("box")
    return said.select("doc_id", "kind", "n", "page", box, "text", none("text_blocks", "long"), none("text_chars", "long")).unionByName(shown.select("doc_id", "kind", "n", "page", box, none("text", "string"), "text_blocks", "text_chars"))

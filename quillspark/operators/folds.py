"""Folds whose every step depends on the ones before: greedy matching, chained filling, growing clusters, list states.

Rows are dealt by document (or page) and sorted within partitions; a task streams through its documents one after the other and holds one at a time.
So many small documents cost no more than their rows.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.session import heavy_tasks


OUT_ROWS = 20_000


def each_document(df: DataFrame, key: str, order: list[str], fold: Callable[[object, list], Iterable[tuple]], schema: str) -> DataFrame:
    """fold(key, rows) over each document's rows, in order, as named tuples of plain Python values; it gives tuples without the key, which comes first in the
    schema. Rows without a key belong to no document and are left out."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    out_schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out_schema, strict=True)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for k, mine in groupby((r for b in batches for r in rows_of(b)), key=lambda r: getattr(r, key)):
            out += ((k, *x) for x in fold(k, list(mine)))
            if len(out) >= OUT_ROWS:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def rows_of(b: pa.RecordBatch) -> Iterator[tuple]:
        row = namedtuple("row", b.schema.names)
        return map(row._make, zip(*(c.to_pylist() for c in b.columns), strict=True))

    return df.where(F.col(key).isNotNull()).repartition(heavy_tasks(df.sparkSession), key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def changed(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row's keys are others than those of the row before; the first row's are. A null is like a null."""
    out = np.zeros(rows.num_rows, dtype=bool)
    out[:1] = True
    for c in (pa.concat_arrays(rows.column(k).chunks) for k in keys if rows.num_rows):
        a, b = c.slice(1), c.slice(0, max(0, len(c) - 1))
        other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] |= other | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return out


def whole_documents(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of batches, sorted by key, in tables that part no document: so that folds may run over many documents at once, and hold a batch and a document."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.Table.from_batches([*(x.slice(x.num_rows - 1) for x in held[-1:]), batch])
        starts = np.flatnonzero(changed(rows, [key]))[1:] - len(held[-1:])  # of documents that begin in the batch, with one before them
        if len(starts):
            yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])]).combine_chunks()
            held, batch = [], batch.slice(starts[-1])
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def list_runs(lines: DataFrame, marked: bool = False) -> DataFrame:
    """doc_id, idx, list_id, level, kind, number: typed list markers as lists. A new list begins where its level has none, the kind or template changes, the number is 1
    or doesn't follow; plain or blank lines end all lists, bullets those of their level and deeper, numbers the deeper ones. lines: doc_id, idx, text, numbered
    (already a real list item: left alone, ends nothing); style and twips too, if the style's name and the indent may deepen a level. If marked, the marker's
    template follows, and marker: how many characters it takes."""
    lines = lines.withColumn("text", T.opening("text"))  # all that a marker is told from, however long the line
    lines = lines.withColumn("__prefix", T.list_prefix("text"))  # read by several columns, found once
    prefix = F.col("__prefix")
    lines = lines.withColumn("__leading", F.coalesce(prefix["leading"], T.leading_blanks("text")))
    leading = F.col("__leading")
    level = T.list_level(leading, "style", F.col("twips")) if "style" in lines.columns else T.indent_level(leading)
    is_bullet = F.coalesce(T.opens_with_bullet("text"), F.lit(False))
    rows = lines.select(
        "doc_id", "idx", F.coalesce("numbered", F.lit(False)).alias("numbered"), (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"), is_bullet.alias("bullet"),
        level.cast("int").alias("level"), prefix["kind"].alias("kind"), prefix["template"].alias("template"), T.prefix_number(prefix).alias("number"), *([T.after_first_word("text").alias("marker")] if marked else []),
    )

    def fold(_: object, mine: list) -> Iterator[tuple]:
        open_lists: dict[int, tuple] = {}
        last_id = 0
        marks = (lambda r: (r.template, r.marker)) if marked else (lambda r: ())
        for r in mine:
            if r.blank:
                open_lists.clear()
            elif r.numbered:
                continue
            elif r.bullet:
                open_lists = {k: v for k, v in open_lists.items() if k < r.level}
                yield r.idx, 0, r.level, "bullet", None, *marks(r)
            elif r.kind is None:
                open_lists.clear()
            else:
                open_lists = {k: v for k, v in open_lists.items() if k <= r.level}
                kind, template, number, own = open_lists.get(r.level, (None, None, None, None))
                if kind != r.kind or template != r.template or r.number == 1 or r.number != number + 1:
                    last_id += 1
                    own = last_id
                open_lists[r.level] = (r.kind, r.template, r.number, own)
                yield r.idx, own, int(r.level), r.kind, int(r.number), *marks(r)

    return each_document(rows, "doc_id", ["idx"], fold, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, idx long, list_id long, level int, kind string, number long" + (", template string, marker int" if marked else ""))


def match_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, pos, target_pos: each row takes the first target left that fits the first tier that any fits: role, part and target; role and target; part and target; target; role and part;
    role. Null where none is left. Both: doc_id, pos, role, source_part, names (array of targets)."""

    def fold(_: object, both: list) -> Iterator[tuple]:
        left = [(t.pos, t.role, t.source_part, set(t.names or ())) for t in both if not t.is_row]
        for r in (x for x in both if x.is_row):
            names = set(r.names or ())
            by_name = (lambda t: t[1] == r.role and t[2] == r.source_part, lambda t: t[1] == r.role, lambda t: bool(r.source_part) and t[2] == r.source_part, lambda t: True)  # noqa: B023
            tiers = [lambda t, f=f: bool(t[3] & names) and f(t) for f in by_name] if names else []  # noqa: B023
            tiers += [lambda t: bool(r.role and r.source_part) and t[1] == r.role and t[2] == r.source_part, lambda t: bool(r.role) and t[1] == r.role]  # noqa: B023
            hit = next((k for tier in tiers for k, t in enumerate(left) if tier(t)), None)
            yield r.pos, None if hit is None else left.pop(hit)[0]

    plain = lambda df: df.select("doc_id", "pos", F.lower(F.trim("role")).alias("role"), F.lower(F.trim(F.coalesce("source_part", F.lit("")))).alias("source_part"), F.transform(F.array_compact("names"), lambda x: F.lower(F.ltrim(F.replace(F.trim(x), F.lit("\\"), F.lit("/")), F.lit("/")))).alias("names"))
    both = plain(rows).withColumn("is_row", F.lit(True)).unionByName(plain(targets).withColumn("is_row", F.lit(False)))
    return each_document(both, "doc_id", ["is_row", "pos"], fold, "doc_id long, pos long, target_pos long")


def grown_clusters(boxes: DataFrame, gap_x: float, gap_y: float) -> DataFrame:
    """page, n, cluster: boxes of a page clustered in their order; a cluster takes in every box within the gaps of its growing union, until none is left."""

    def fold(_: object, mine: list) -> Iterator[tuple]:
        left, cluster = [(r.n, r.x0, r.y0, r.x1, r.y1) for r in mine], 0
        while left:
            (n, *union), *left = left
            yield n, cluster
            grew = True
            while grew:
                grew, rest = False, []
                current = tuple(union)  # one pass is against the union it began with
                for n, x0, y0, x1, y1 in left:
                    if max(current[0] - x1, x0 - current[2], 0) <= gap_x and max(current[1] - y1, y0 - current[3], 0) <= gap_y:
                        union = [min(union[0], x0), min(union[1], y0), max(union[2], x1), max(union[3], y1)]
                        yield n, cluster
                        grew = True
                    else:
                        rest.append((n, x0, y0, x1, y1))
                left = rest
            cluster += 1

    rows = boxes.where("x1 > x0 and y1 > y0").select("page", "n", "x0", "y0", "x1", "y1")
    return each_document(rows, "page", ["n"], fold, "page long, n long, cluster long")


def filled_previews(items: DataFrame) -> DataFrame:
    """doc_id, idx, page, y0, y1: empty items without a place get one between their neighbours, or beside the one they have; filled ones serve those after them. items: doc_id, idx, role, page, y0, y1."""

    def fold(_: object, mine: list) -> Iterator[tuple]:
        rows = [[r.idx, r.role, r.page, r.y0, r.y1] for r in mine]
        known = [r[2] is not None and r[3] is not None for r in rows]
        after: list[int | None] = [None] * len(rows)
        for k in range(len(rows) - 2, -1, -1):
            after[k] = k + 1 if known[k + 1] else after[k + 1]
        last = None
        for k, r in enumerate(rows):
            if r[1] == "empty" and not known[k]:
                before, ahead = (rows[last] if last is not None else None), (rows[after[k]] if after[k] is not None else None)
                if before and ahead and before[2] == ahead[2]:
                    top = min(max(before[4] + 0.004, 0), 0.97)
                    r[2:] = before[2], top, max(min(ahead[3] - 0.004, 1), top + 0.012)
                elif ahead and not before:
                    top = max(ahead[3] - 0.03, 0)
                    r[2:] = ahead[2], top, max(top + 0.015, min(ahead[3] - 0.004, 1))
                elif anchor := ahead or before:
                    top = min(anchor[4] + 0.004, 0.97)
                    r[2:] = anchor[2], top, min(top + 0.02, 0.995)
                known[k] = r[2] is not None
            last = k if known[k] else last
        yield from ((idx, page, y0, y1) for idx, _, page, y0, y1 in rows)

    return each_document(items.select("doc_id", "idx", "role", "page", "y0", "y1"), "doc_id", ["idx"], fold, "doc_id long, idx long, page long, y0 double, y1 double")


def exact_anchors(elements: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, idx, block: each element takes the first block, from behind the last one taken and then from the start, that is not taken and has its text. Both: doc_id, idx, text."""

    def same(a: str, b: str) -> bool:
        short, long = sorted((a, b), key=len)
        return bool(short) and (a == b or len(short) >= 10 and short in long)

    def fold(_: object, both: list) -> Iterator[tuple]:
        free = [(b.idx, b.text) for b in both if not b.is_element]
        at, taken = 0, set()
        for e in (x for x in both if x.is_element):
            hit = next((k for k in (*range(at, len(free)), *range(at)) if k not in taken and same(e.text, free[k][1])), None)
            if hit is not None:
                taken.add(hit)
                at = hit + 1
            yield e.idx, None if hit is None else free[hit][0]

    plain = lambda df: df.select("doc_id", "idx", T.normal_for_style("text").alias("text"))
    both = plain(elements).withColumn("is_element", F.lit(True)).unionByName(plain(blocks).withColumn("is_element", F.lit(False)))
    return each_document(both, "doc_id", ["is_element", "idx"], fold, "doc_id long, idx long, block long")

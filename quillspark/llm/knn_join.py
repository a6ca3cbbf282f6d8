"""Exact top-k inner products of stated queries against all rows, as a Voronoi join.

1. Pivots: a bounded sample of rows, those with the least hashes. Every row goes to the cell of its nearest pivot p and is written as its part
   along p and the length of what is left: x = b p/|p| + x', s = |x'|.
2. Query groups: queries are dealt to the cells of the first few pivots. For a query with parts a and t in the direction of p,
   a b - t s <= q.x <= a b + t s (Cauchy and Schwarz on what is left). Pivots are rows, so the (k + 1)-th best score among them, one being left for the query itself, is one
   that its k-th best can't be below. Of each group, the summary keeps the range of a and the most of t for every pivot, and the least of these scores.
3. Replication: a row is sent to a group only if max(a b) + t s over the group's summary reaches that least score.
4. Local joins: a group's queries and the rows sent to it are dealt to tiles of at most about TILE rows and QUERIES queries; each tile's products are one
   matrix product, and its k best for each query are merged by a window. Ties go to the smaller identifier throughout.

The bounds only spare work: nothing that may be among the k best is left out, and rows that have no structure go to every group. Groups grow as the square root
of the queries, so that rows are sent at most sqrt(queries) / 2 times. What is broadcast (pivots and summaries) is bounded by PIVOT_BYTES and SUMMARY_BYTES whatever the table.

Components are floor(scale x), x as double, held at the ends of 64 bits; products are exact: doubles where no sum can pass 2^53, else Python's whole numbers, and a score beyond 64 bits is held at
their ends. Vectors are continued by zeros to the longest one's length.

Defined results: rows whose vector is null, or has null or non-finite components, take no part, nor do rows without an identifier. A row is never its own
candidate, nor is one of the same identifier; repeated rows are candidates of their own, and a repeated query has its results again. An empty vector scores 0 with all.
A query without candidates has no rows; an empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut

K, SCALE = 5, 256
MOST_PIVOTS, PIVOT_BYTES = 1024, 16 << 20
MOST_GROUPS, SUMMARY_BYTES = 1024, 32 << 20
TILE, QUERIES = 8192, 1024
EXACT = 1 << 53


def takes_part(vector: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd)


def matrix(raw: list[bytes], kind: str, wide: int) -> np.ndarray:
    """Rows of whole numbers from their bytes, continued by zeros."""
    size = np.dtype(kind).itemsize * wide
    return np.frombuffer(b"".join(x.ljust(size, b"\0") for x in raw), dtype=kind).reshape(len(raw), wide)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """int64, exact; held at its ends."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), dtype=np.int64)
    most = int(np.abs(queries.astype(np.float64)).max()) * int(np.abs(rows.astype(np.float64)).max()) * queries.shape[1]
    if most < EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ rows.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of the k best of each query among rows in order of identifier; own marks what doesn't count."""
    counted = ~own
    if scores.shape[1] > k:  # what is below the k-th best can go; ties with it are left to the sort
        seen = np.where(own, np.iinfo(np.int64).min, scores)
        counted &= seen >= np.partition(seen, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
    q, r = np.nonzero(counted)
    order = np.lexsort((r, -scores[q, r].astype(np.float64), q)) if np.abs(scores[q, r].astype(np.float64)).max(initial=0) < EXACT else np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(scores[q[i], r[i]]), r[i])), dtype=np.int64)
    q, r = q[order], r[order]
    first = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - first < k
    return q[keep], r[keep]


class Cells:
    """Pivots, their directions, and rows by cell."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots.astype(np.float64)
        self.length = np.linalg.norm(self.pivots, axis=1)
        self.unit = self.pivots / np.where(self.length > 0, self.length, 1)[:, None]

    def nearest(self, rows: np.ndarray, first: int | None = None) -> np.ndarray:
        most = slice(0, first)
        return np.argmin(self.length[most] ** 2 - 2 * (rows @ self.pivots[most].T), axis=1)

    def parts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row and pivot: the part along it, and the length of what is left."""
        along = rows @ self.unit.T
        return along, np.sqrt(np.maximum(0, (rows * rows).sum(axis=1)[:, None] - along * along))


def pieces(run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one over some rows."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                yield from run(batch.slice(at, 4096))

    return mapped


def search(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, most_pivots: int = MOST_PIVOTS, tile: int = TILE, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: of each query (rows that meet is_query) the k best of all other rows."""
    low = -(1 << 63)
    spark = rows.sparkSession
    numbers = F.transform(F.col(vector_col), lambda x: held(F.floor(scale * x.cast("double"))))
    base = rows.where(takes_part(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), numbers.alias("v"))
    told = base.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"), F.max(F.size("v")).alias("wide"), F.max(F.array_max(F.transform("v", lambda x: F.abs(F.greatest(x, F.lit(low + 1)))))).alias("most")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not told["q"]:
        return spark.createDataFrame([], empty)
    wide, most = told["wide"], told["most"] or 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    size = np.dtype(kind).itemsize

    # 1. cells
    many = max(1, min(most_pivots, math.isqrt(told["n"]), PIVOT_BYTES // (8 * max(1, wide))))
    sample = base.orderBy(F.xxhash64("id", "v"), "id").limit(many).select("v").collect()  # many rows at most
    pivots = np.zeros((len(sample), wide), dtype=np.int64)
    for i, row in enumerate(sample):
        pivots[i, : len(row["v"])] = row["v"]
    shared = spark.sparkContext.broadcast(pivots)
    groups = max(1, min(MOST_GROUPS, len(sample), math.isqrt(told["q"]) // 2, SUMMARY_BYTES // (24 * len(sample))))

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cells = Cells(shared.value)
        v = batch.column("v")
        flat, ends = v.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(np.concatenate([[0], pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)]))
        raw = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        x = matrix(raw, kind, wide).astype(np.float64)
        at = cells.nearest(x)
        along = (x * cells.unit[at]).sum(axis=1)
        left = np.sqrt(np.maximum(0, (x * x).sum(axis=1) - along * along))
        grp = np.where(batch.column("asks").to_numpy(zero_copy_only=False), cells.nearest(x, groups), -1)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(grp.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(along), pa.array(left), pa.array(raw, pa.binary())], ["id", "grp", "cell", "along", "rest", "v"])

    placed = base.mapInArrow(pieces(place), "id long, grp int, cell int, along double, rest double, v binary")
    placed = cut(placed.withColumn("row", F.monotonically_increasing_id()))

    # 2. what each group needs
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, found = Cells(shared.value), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                x = matrix(piece.column("v").to_pylist(), kind, wide)
                scores = products(x, shared.value)
                least = np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, scores.shape[1] - k - 1] if scores.shape[1] > k else np.full(len(x), low)
                along, rest = cells.parts(x.astype(np.float64))
                grp = piece.column("grp").to_numpy()
                for g in np.unique(grp):
                    mine = grp == g
                    now = [along[mine].min(axis=0), along[mine].max(axis=0), rest[mine].max(axis=0), least[mine].min().astype(np.float64)]
                    held_so_far = found.get(g)
                    found[g] = now if held_so_far is None else [np.minimum(held_so_far[0], now[0]), np.maximum(held_so_far[1], now[1]), np.maximum(held_so_far[2], now[2]), min(held_so_far[3], now[3])]
        if found:
            columns = [[int(g) for g in found], *([np.asarray(x[i]).tobytes() for x in found.values()] for i in range(3)), [float(x[3]) for x in found.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:4]), pa.array(columns[4], pa.float64())], ["grp", "low", "high", "rest", "least"])

    def merge(mine: pd.DataFrame) -> pd.DataFrame:
        taken = {c: f(np.array([np.frombuffer(x) for x in mine[c]]), axis=0).tobytes() for c, f in (("low", np.min), ("high", np.max), ("rest", np.max))}
        return pd.DataFrame([{"grp": mine["grp"].iloc[0], **taken, "least": mine["least"].min()}])

    schema = "grp int, low binary, high binary, rest binary, least double"
    summaries = placed.where("grp >= 0").select("grp", "v").mapInArrow(summarise, schema).groupBy("grp").applyInPandas(merge, schema).orderBy("grp").collect()  # groups * pivots * 24 bytes at most
    of_groups = spark.sparkContext.broadcast((np.array([r["grp"] for r in summaries], dtype=np.int32), *(np.array([np.frombuffer(r[c]) for r in summaries]) for c in ("low", "high", "rest")), np.array([r["least"] for r in summaries])))

    def needed(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Places of rows, and the places of the groups that need them."""
        _, lows, highs, rests, least = of_groups.value
        cell, b, s = (piece.column(c).to_numpy() for c in ("cell", "along", "rest"))
        ends = [np.ascontiguousarray(x.T)[cell] for x in (lows, highs, rests)]
        bound = np.maximum(ends[0] * b[:, None], ends[1] * b[:, None]) + ends[2] * s[:, None]
        # a length that was left may be wrong by a root of what a double rounds to
        sizes = (np.maximum(np.abs(ends[0]), np.abs(ends[1])) + ends[2]) * (np.abs(b) + s)[:, None] + np.abs(least)[None, :]
        return np.nonzero(np.maximum(bound, low) + 1e-7 * sizes + 1e-6 >= least[None, :])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(of_groups.value[0]), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                counts += np.bincount(needed(batch.slice(at, 4096))[1], minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(of_groups.value[0]), pa.array(counts)], ["grp", "n"])

    # 3. tiles: a group's rows in blocks, its queries in chunks
    sent = dict(placed.select("cell", "along", "rest").mapInArrow(tally, "grp int, n long").groupBy("grp").agg(F.sum("n")).collect())  # a number for each group
    asking = dict(placed.where("grp >= 0").groupBy("grp").count().collect())
    shape = {g: (max(1, -(-sent[g] // tile)), max(1, -(-asking[g] // queries))) for g in asking}
    shapes = spark.sparkContext.broadcast(shape)

    def replicate(piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, which = needed(piece)
        grp = of_groups.value[0][which]
        number = piece.column("row").to_numpy()
        block = spread(number)[row] % np.array([shapes.value[g][0] for g in of_groups.value[0]], dtype=np.int64)[which]
        chunks = np.array([shapes.value[g][1] for g in of_groups.value[0]], dtype=np.int64)[which]
        again = np.repeat(np.arange(len(row)), chunks)
        chunk = np.arange(len(again)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        taken = pa.array(row[again])
        yield pa.RecordBatch.from_arrays([pa.array(grp[again]), pa.array(block[again]), pa.array(chunk), pa.array(np.full(len(again), -1)), piece.column("id").take(taken), piece.column("v").take(taken)], TILED)

    def ask(piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        grp, number = piece.column("grp").to_numpy(), piece.column("row").to_numpy()
        blocks = np.array([shapes.value[g][0] for g in grp], dtype=np.int64)
        chunk = spread(number) % np.array([shapes.value[g][1] for g in grp], dtype=np.int64)
        again = np.repeat(np.arange(len(grp)), blocks)
        block = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        taken = pa.array(again)
        yield pa.RecordBatch.from_arrays([pa.array(grp[again]), pa.array(block), pa.array(chunk[again]), pa.array(number[again]), piece.column("id").take(taken), piece.column("v").take(taken)], TILED)

    # 4. local joins
    def solve(mine: pd.DataFrame) -> pd.DataFrame:
        asks = mine["asked"].to_numpy() >= 0
        q, rows = mine[asks], mine[~asks].sort_values("id", kind="stable")
        ids, own = rows["id"].to_numpy(), q["id"].to_numpy()
        out, x = [], matrix(rows["v"].tolist(), kind, wide)
        for at in range(0, len(q), 256):  # of a tile's scores, 256 rows are held at a time
            part = slice(at, at + 256)
            scores = products(matrix(q["v"].iloc[part].tolist(), kind, wide), x)
            a, b = best(scores, own[part][:, None] == ids[None, :], k)
            out.append(pd.DataFrame({"asked": q["asked"].to_numpy()[part][a], "query_id": own[part][a], "vec_id": ids[b], "score": scores[a, b]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["asked", "query_id", "vec_id", "score"])

    tiled = "grp int, block long, chunk long, asked long, id long, v binary"
    both = placed.mapInArrow(pieces(replicate), tiled).unionByName(placed.where("grp >= 0").mapInArrow(pieces(ask), tiled))
    near = both.groupBy("grp", "block", "chunk").applyInPandas(solve, "asked long, query_id long, vec_id long, score long")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TILED = ["grp", "block", "chunk", "asked", "id", "v"]


def spread(number: np.ndarray) -> np.ndarray:
    """Row numbers (partition and place) dealt evenly: neighbours in turn, partitions from different starts."""
    return (number >> 33) * 7919 + (number & ((1 << 33) - 1))


def held(x: Column) -> Column:
    """A whole double as a long, held at the ends of 64 bits."""
    return F.when(x >= 9223372036854775807.0, (1 << 63) - 1).when(x <= -9223372036854775808.0, -(1 << 63)).otherwise(x.cast("long"))

"""N-gram Jaccard join: all documents whose sets of word shingles are similar, as connected components, and how many each is similar to.

Exact at any size, in four steps.

1. Classes. Each text becomes a set of hashed shingles; documents with equal sets are one class, named by its smallest document.
2. Routing. Tokens are put in one order for all: the frequent ones last, the others by hash. Similar sets share a token
   among the first n - ceil(p n) + 1 of each, and, counted over all tokens, at least
   ceil(p/(1+p) (n + m)) - ceil(p max(n, m)) + 1 of those. Tokens are dealt to buckets; pairs of classes that meet there are counted,
   summed over buckets, and those with too few in common go. Where a token is frequent, or more than BLOCK classes meet at it, they are tied to
   the smallest of them instead of pairwise, which joins them all; for the frequent tokens each task first does that for what it
   has read, and sends the smallest on, to be tied to those of other tasks. A pair that shares a tied token is in one group whatever it shares besides, and of
   any other pair every shared token is counted. Components of these ties are routing groups: no similar pair lies across two.
3. Signature trees. A group's sets are dealt to bands of sizes, and within a band to chunks of CHUNK sets or CHUNK_BYTES of tokens. Similar sets
   lie in one band or in neighbouring ones; each such pair of chunks is a tile, dealt out by itself, that builds a signature tree and
   joins it with itself by dual traversal (signature_tree.py). Every similarity is checked on whole sets.
4. Components of the links that the trees found, over classes; documents take their class's component and its number of links.

The order of tokens decides the cost and never the result: counts are exact over all documents, and the MOST_FREQUENT most frequent tokens
(a fixed number, whatever the input) are carried to the tasks.

Defined results: a text without words (null, empty, blank) has no shingles, no links and is its own component. Rows that repeat an
identifier are one document: whatever any of its texts is similar to is linked with it; each row gives a row. Links are counted from a row's
text to the documents of equal and similar texts, one with several such texts once for each. A null identifier counts as the
smallest and is returned as null. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import broadcast_if_small, cut, text_slices
from quillspark.llm.components import connected_components
from quillspark.llm.shingles import digest, shingle_sets
from quillspark.llm.signature_tree import SignatureTree

SIZE, PERCENT = 5, 75
BLOCK = 64
MOST_FREQUENT = 400_000
CHUNK, CHUNK_BYTES = 256, 2 << 20
BUCKET_TOKENS, LEAST_BUCKETS = 400_000, 256
HASHED_BYTES = 1 << 20
#: Rows of tiles that a task gets, about, and the most tasks.
TASK_ROWS, MOST_TASKS = 512, 50_000
NULL_ID = -(1 << 63)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def hashed(docs: DataFrame, size: int) -> DataFrame:
    """doc, th, n, h1, h2: the text's hash, the size of each row's set and two hashes that name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, most=HASHED_BYTES):
            sets = shingle_sets(piece.column(1).to_pylist(), size)
            h1, h2 = zip(*map(digest, sets), strict=True)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(map(len, sets), pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["doc", "th", "n", "h1", "h2"])

    return docs.mapInArrow(run, "doc long, th long, n long, h1 long, h2 long")


def dealt(tokens: np.ndarray, shift: int, *more: np.ndarray) -> Iterator[tuple[int, ...]]:
    """Sorted tokens and what goes with them, by bucket, as bytes."""
    bucket = (tokens >> np.uint64(shift)).astype(np.int64)
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(tokens)]])
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield int(bucket[a]), tokens[a:b].tobytes(), *(x[a:b].tobytes() for x in more)


def frequent_tokens(docs: DataFrame, size: int, percent: int, shift: int) -> np.ndarray:
    """The most frequent tokens among the first of each set by hash, by exact counts: those in more than BLOCK documents, at most MOST_FREQUENT.

    A tenth more of each set than its prefix is counted, since frequent tokens make room for the next ones."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, most=HASHED_BYTES):
            sets = shingle_sets(piece.column(1).to_pylist(), size)
            firsts = [x[: prefix_length(len(x), percent) + len(x) // 10] for x in sets if len(x)]
            if firsts:
                tokens, counts = np.unique(np.concatenate(firsts), return_counts=True)
                rows = list(zip(*dealt(tokens, shift, counts.astype(np.int32)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["bucket", "tokens", "counts"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in rows["tokens"]])
        counts = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in rows["counts"]])
        order = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[order], counts[order].astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(tokens)) + 1])
        total = np.add.reduceat(counts, first)
        many = total > BLOCK
        return pd.DataFrame({"token": tokens[first][many].view(np.int64), "n": total[many]})

    found = docs.mapInArrow(emit, "bucket int, tokens binary, counts binary").groupBy("bucket").applyInPandas(count, "token long, n long")
    top = found.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toPandas()["token"]
    return np.sort(top.to_numpy(dtype=np.int64).view(np.uint64))


def ties(docs: DataFrame, frequent: np.ndarray, size: int, percent: int, shift: int) -> DataFrame:
    """a, b (hashes h1 of classes): pairs that may be similar, and what ties the classes of a large block together."""
    buckets = 1 << (64 - shift)  # the numbers from here on are buckets of ties
    late = docs.sparkSession.sparkContext.broadcast(frequent)  # MOST_FREQUENT * 8 bytes at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = late.value
        for piece in text_slices(batches, most=HASHED_BYTES):
            tokens, owners, sizes, often = [], [], [], []
            for x in shingle_sets(piece.column(1).to_pylist(), size):
                if len(x):
                    at = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
                    is_late = known[at] == x if len(known) else np.zeros(len(x), dtype=bool)
                    first = np.concatenate([x[~is_late], x[is_late]])[: prefix_length(len(x), percent)]
                    tokens.append(first)
                    owners.append(np.full(len(first), digest(x)[0], dtype=np.int64))
                    sizes.append(np.full(len(first), len(x), dtype=np.int32))
                    often.append(np.arange(len(first)) >= np.count_nonzero(~is_late))
            if tokens:
                tokens, owners, sizes, often = map(np.concatenate, (tokens, owners, sizes, often))
                order = np.lexsort((owners, tokens))
                tokens, owners, sizes, often = tokens[order], owners[order], sizes[order], often[order]
                opens = np.concatenate([[True], np.diff(tokens) != 0])
                fresh = opens | np.concatenate([[True], np.diff(owners) != 0])  # copies say it once
                tied = fresh & often & ~opens  # only the least of those who have a frequent token goes to its bucket
                fresh &= ~tied
                least = owners[np.flatnonzero(opens)[np.cumsum(opens) - 1][tied]].view(np.uint64)
                rows = list(dealt(tokens[fresh], shift, owners[fresh], sizes[fresh]))
                if tied.any():
                    both = np.unique(np.stack([owners[tied].view(np.uint64), least], axis=1), axis=0)
                    rows += [(k + buckets, a, b, b"") for k, a, b in dealt(both[:, 0].copy(), shift, both[:, 1].copy())]
                rows = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], ["bucket", "tokens", "owners", "sizes"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["bucket"].iloc[0] >= buckets:
            a, b = (np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows[c]]) for c in ("tokens", "owners"))
            return pd.DataFrame({"a": a, "b": b}).drop_duplicates().assign(na=0, nb=0, shared=0)
        tokens = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in rows["tokens"]])
        owners = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows["owners"]])
        sizes = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in rows["sizes"]]).astype(np.int64)
        order = np.lexsort((owners, tokens))
        tokens, owners, sizes = tokens[order], owners[order], sizes[order]
        fresh = np.concatenate([[True], (np.diff(tokens) != 0) | (np.diff(owners) != 0)])
        tokens, owners, sizes = tokens[fresh], owners[fresh], sizes[fresh]
        first = np.concatenate([[0], np.flatnonzero(np.diff(tokens)) + 1])
        many = np.diff(np.concatenate([first, [len(tokens)]]))
        # the owners of a frequent token that are here stand for others, so none of them may be judged by what it shares
        known = late.value
        often = known[np.minimum(np.searchsorted(known, tokens[first]), len(known) - 1)] == tokens[first] if len(known) else np.zeros(len(first), dtype=bool)
        left, right, tied_a, tied_b = [], [], [], []
        for m, tie in np.unique(np.stack([many, often | (many > BLOCK)], axis=1)[many > 1], axis=0):
            at = first[(many == m) & ((often | (many > BLOCK)) == bool(tie))]
            if not tie:
                i, j = np.triu_indices(m, 1)
                for part in np.array_split(at, max(1, len(at) * len(i) // 2_000_000)):
                    a, b = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                    fits = (100 * sizes[a] >= percent * sizes[b]) & (100 * sizes[b] >= percent * sizes[a])
                    left.append(a[fits])
                    right.append(b[fits])
            else:
                rest = (at[:, None] + np.arange(1, m)).ravel()
                tied_a.append(np.repeat(owners[at], m - 1))
                tied_b.append(owners[rest])
        out = []
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            pairs = pd.DataFrame({"a": owners[a], "b": owners[b], "na": sizes[a], "nb": sizes[b]})
            out.append(pairs.groupby(["a", "b", "na", "nb"], sort=False).size().rename("shared").reset_index())
        if tied_a:
            tied = pd.DataFrame({"a": np.concatenate(tied_a), "b": np.concatenate(tied_b)}).drop_duplicates()
            out.append(tied.assign(na=0, nb=0, shared=0))
        return pd.concat(out).astype("int64") if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("a", "b", "na", "nb", "shared")})

    met = docs.mapInArrow(emit, "bucket int, tokens binary, owners binary, sizes binary").groupBy("bucket").applyInPandas(meet, "a long, b long, na long, nb long, shared long")
    summed = met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.min("na").alias("tied"))
    overlap = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    enough = F.col("shared") >= overlap - F.ceil(percent * F.greatest("na", "nb") / 100) + 1
    return summed.where((F.col("tied") == 0) | enough).select("a", "b")


def member_sets(docs: DataFrame, size: int) -> DataFrame:
    """docs (doc, text, and a class's grp, h1, h2, n and weight) with the sets instead of the texts, as bytes."""
    names = ["grp", "doc", "h1", "h2", "n", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, most=HASHED_BYTES):
            sets = [x.tobytes() for x in shingle_sets(piece.column(1).to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "tokens"])

    return docs.select("doc", "text", *names[:1], *names[2:]).mapInArrow(run, "grp long, doc long, h1 long, h2 long, n long, weight long, tokens binary")


def links(members: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """Of similar classes: rows (a, b, links 0) that hold their documents together, and rows (h1, h2, links) of what is similar to a class.
    members: member_sets() of all classes in routing groups; chosen: these classes' grp and n."""
    band = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int")
    sized = chosen.groupBy("grp", band.alias("band")).agg(F.count("*").alias("k"), F.sum(8 * F.col("n")).alias("bytes"))
    chunks = F.greatest(F.ceil(F.col("k") / CHUNK), F.ceil(F.col("bytes") / CHUNK_BYTES), F.lit(1)).cast("int")
    bands = F.map_from_entries(F.collect_list(F.struct("band", chunks.alias("chunks"))))  # sizes fit in some hundred bands
    groups = cut(sized.groupBy("grp").agg(bands.alias("bands"), ((F.sum("k") <= CHUNK) & (F.sum("bytes") <= CHUNK_BYTES)).alias("small"), F.sum("k").alias("k"), F.sum(chunks).alias("chunks")))

    rows = members.withColumn("band", band).join(broadcast_if_small(groups.select("grp", "bands", "small"), 400), "grp")
    place = lambda band, chunk: (band * (1 << 20) + chunk).cast("long")
    rows = rows.withColumn("own", place(F.col("band"), F.pmod(F.col("h1"), F.col("bands")[F.col("band")])))
    near = F.filter(F.array(*[F.col("band") + d for d in (-1, 0, 1)]), lambda b: F.map_contains_key("bands", b))
    others = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0), F.element_at("bands", b) - 1), lambda c: place(b, c))))
    tile = F.when(F.col("small"), F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))))
    tile = tile.otherwise(F.transform(others, lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"))))
    rows = rows.withColumn("tile", F.explode(tile)).select("grp", "tile.i", "tile.j", "own", "doc", "h1", "h2", "weight", "tokens")

    def join(mine: pd.DataFrame) -> pd.DataFrame:
        mine = mine.drop_duplicates(["h1", "h2"])  # repeated rows
        own = mine["own"].to_numpy(dtype=np.int64)
        across = own if mine["i"].iloc[0] != mine["j"].iloc[0] else None  # each chunk has a tile of its own
        sets = [np.frombuffer(x, dtype=np.uint64) for x in mine["tokens"]]
        found, counts = SignatureTree(sets, percent).joined(mine["weight"].to_numpy(dtype=np.int64), across)
        doc = mine["doc"].to_numpy(dtype=np.int64)
        a, b = doc[[x for x, _ in found]], doc[[y for _, y in found]]
        some = mine[counts > 0]
        spans = pd.DataFrame({"a": a, "b": b, "h1": 0, "h2": 0, "links": 0}) if found else pd.DataFrame()
        return pd.concat([spans, pd.DataFrame({"a": some["doc"], "b": some["doc"], "h1": some["h1"], "h2": some["h2"], "links": counts[counts > 0]})]).astype("int64")

    tile_rows = groups.agg(F.sum(F.when(F.col("small"), F.col("k")).otherwise(F.col("k") * F.col("chunks")))).first()[0] or 0
    tasks = min(MOST_TASKS, max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(tile_rows) // TASK_ROWS)))
    return rows.repartition(tasks, "grp", "i", "j").groupBy("grp", "i", "j").applyInPandas(join, "a long, b long, h1 long, h2 long, links long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id and n_links for each row of docs."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    sets = cut(hashed(rows, size))
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 << int(np.ceil(np.log2(max(1, total * 0.35 / BUCKET_TOKENS)))))
    shift = 64 - int(np.log2(buckets))
    classes = sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc").alias("rep"), F.min_by("th", "doc").alias("th"), F.countDistinct("doc").alias("weight"))
    classes = cut(classes)

    frequent = frequent_tokens(rows, size, percent, shift)
    groups = connected_components(ties(rows, frequent, size, percent, shift)).select(F.col("node").alias("h1"), F.col("component").alias("grp"))
    chosen = cut(classes.join(groups, "h1").select("grp", "h1", "h2", "n", "weight", "rep", "th"))
    members = member_sets(rows.join(broadcast_if_small(chosen.withColumnRenamed("rep", "doc"), 64), ["doc", "th"]), size)
    found = cut(links(members, chosen, percent))
    joined = connected_components(found.where("a <> b").select("a", "b").unionByName(_several(sets, classes)))
    counts = found.where("links > 0").groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    told = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(counts, ["h1", "h2"], "left")
    told = cut(told.select("n", "h1", "h2", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")))
    null = lambda c: F.nullif(c, F.lit(NULL_ID))
    mine = sets.select("doc", "n", "h1", "h2").join(told, ["n", "h1", "h2"], "left")
    return mine.select(null(F.col("doc")).alias(id_col), F.col("n").alias("n_shingles"), null(F.coalesce("component", "doc")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose document is the smallest of its component, all columns as they were."""
    own = F.col(id_col).eqNullSafe(F.col("component_id"))
    gone = cut(components(docs, id_col, text_col, size, percent).groupBy(F.col(id_col).alias("__gone")).agg(F.max(own).alias("stays")).where("not stays").select("__gone"))
    return docs.join(broadcast_if_small(gone, 16), F.col(id_col).cast("long").eqNullSafe(F.col("__gone")), "left_anti")


def _several(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: ties between the classes of identifiers that have several texts."""
    many = sets.where("n > 0").groupBy("doc").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("doc")
    at = sets.join(many, "doc").join(classes, ["n", "h1", "h2"]).select("doc", "rep").distinct()
    return at.join(at.groupBy("doc").agg(F.min("rep").alias("a")), "doc").where("a <> rep").select("a", F.col("rep").alias("b"))

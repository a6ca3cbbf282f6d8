"""A Merkle manifest of a dataset: a tree of digests over every group's rows, one over the groups' roots, and each row's proof, by superblock reduction.

1. Leaves. A row's leaf is H of its named columns, H being the lower-case hex SHA-256 of its inputs one after the other (digests as hex text);
   a column is `-` if null, else the length of its UTF-8 form in bytes, `:` and that form. All in SQL; only leaves go further, texts stay where they are.
2. Places. Leaves are dealt out by ranges of (group, identifier, leaf) and sorted; a leaf's index is its place in its partition plus the group's
   rows in the partitions before, of which there is one row for each partition and group.
3. Superblocks. Indices are bucketed by fanout^k; `applyInPandas` collapses the k lowest levels of each bucket to one node and gives each leaf the siblings it
   met there (its lower proof). The buckets' nodes are the leaves of the next round, until each group has one node: log(rows) / k rounds, in
   each of which a task holds fanout^k nodes. No group is ever in one task, however many of the rows it has.
4. Upper proofs are joined down from the last round to the first and appended to the lower ones. The groups' roots are reduced in the same way, as leaves
   of one more tree, whose proofs are appended last.

Levels: while a tree has several nodes, every `fanout` consecutive ones become their H; the last run may be shorter, also a single node, which is hashed by itself. A tree
of one leaf is that leaf. A proof is two arrays of strings, level by level: the joined siblings left and right of the path; fold() takes a leaf up through them, with
SQL functions only.

Defined results: rows are in ascending order of the identifier, null first, then of their leaf; repeated rows are leaves of their own (they may lie in one partition of the
sort, which spills) and have the proof of their own place. A null group is a group; it comes first, then the others by their bytes. An empty table has no leaves and no root. Only the
named columns are read. Identifiers are longs or strings.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import broadcast_if_small, cut

#: Nodes that become one, and levels that a task collapses: it holds FANOUT ** LEVELS nodes.
FANOUT, LEVELS = 2, 10
ROW = (1 << 33) - 1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    said = value.cast("string")
    return F.when(said.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes(grp, ...) with idx, a node's place in its group by `order`, and n, the group's nodes."""
    placed = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("__at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(ROW)))
    runs = placed.groupBy("grp", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    # a row for each partition and group
    starts = runs.selectExpr("grp", "__part", "__first", "sum(__n) over (partition by grp order by __part) - __n as __before", "sum(__n) over (partition by grp) as n")
    starts = cut(starts)
    return placed.join(broadcast_if_small(starts, 100), ["grp", "__part"]).withColumn("idx", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__part", "__first", "__before")


def depth(n: Column, fanout: int) -> Column:
    """Levels from n leaves to their root."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= fanout
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda x: x < n)).cast("int")


def collapsed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """nodes(grp, idx, hash, depth, carried) with their bucket, its node `top` (said by its first row, else null), and what they met on the way: lefts, rights."""
    step = F.least(F.col("depth"), F.lit(levels))
    rows = nodes.select("grp", F.expr(f"idx div {fanout**levels}L").alias("bucket"), "idx", "hash", "depth", step.alias("step"), "carried")

    def collapse(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", ignore_index=True)
        now = rows["hash"].tolist()
        lefts, rights = [[] for _ in now], [[] for _ in now]
        at = list(range(len(now)))  # where each row's path stands
        for _ in range(int(rows["step"].iloc[0])):
            runs = [now[i : i + fanout] for i in range(0, len(now), fanout)]
            for k, i in enumerate(at):
                run, j = runs[i // fanout], i % fanout
                lefts[k].append("".join(run[:j]))
                rights[k].append("".join(run[j + 1 :]))
                at[k] = i // fanout
            now = [hashlib.sha256("".join(run).encode()).hexdigest() for run in runs]
        return rows.assign(lefts=lefts, rights=rights, top=[now[0]] + [None] * (len(rows) - 1))[["grp", "bucket", "idx", "depth", "step", "carried", "lefts", "rights", "top"]]

    return rows.groupBy("grp", "bucket").applyInPandas(collapse, "grp string, bucket long, idx long, depth int, step int, carried string, lefts array<string>, rights array<string>, top string")


def reduced(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Of nodes(grp, idx, n, hash, carried), a group's idx without gaps: (grp, carried, lefts, rights), a row for each, and (grp, root).

    `carried` is any string that comes back with its row."""
    now = nodes.select("grp", "idx", "hash", depth(F.col("n"), fanout).alias("depth"), "carried")
    rounds = []
    while True:
        done = cut(collapsed(now, fanout, levels))
        rounds.append(done)
        now = done.where("top is not null").select("grp", F.col("bucket").alias("idx"), F.col("top").alias("hash"), (F.col("depth") - F.col("step")).alias("depth"), F.lit(None).cast("string").alias("carried"))
        if now.where("depth > 0").isEmpty():
            break
    upper = None
    for done in reversed(rounds):
        if upper is not None:
            above = upper.select("grp", F.col("idx").alias("bucket"), F.col("lefts").alias("__l"), F.col("rights").alias("__r"))
            done = done.join(broadcast_if_small(above, 4096), ["grp", "bucket"])
            done = done.withColumns({"lefts": F.concat("lefts", "__l"), "rights": F.concat("rights", "__r")})
        upper = done.select("grp", "idx", "carried", "lefts", "rights")
    return upper.drop("idx"), now.select("grp", F.col("hash").alias("root"))


def fold(start: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    level = F.arrays_zip(lefts.alias("l"), rights.alias("r"))
    return F.aggregate(level, start, lambda now, x: digest(x["l"], now, x["r"]))


def proof_digest(lefts: Column, rights: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.arrays_zip(lefts.alias("l"), rights.alias("r")), lambda x: F.concat(x["l"], x["r"])), "").cast("binary"), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", also: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """For each row of docs: its id, leaf, subroot (its group's), root, and the proof lefts and rights from leaf to root.
    `also`: string columns over docs that are carried to the rows, such as leaves to be verified."""
    if fanout < 2 or levels < 1:
        raise ValueError("fanout is 2 or more and levels 1 or more")
    also = also or {}
    grp = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("."), F.col(group_col).cast("string")))  # the null group first
    said = F.to_json(F.struct(F.col(id_col).cast("string").alias("id"), *[c.cast("string").alias(f"a{k}") for k, c in enumerate(also.values())]), {"ignoreNullFields": "true"})
    leaves = cut(docs.select(grp.alias("grp"), F.col(id_col).alias("id"), leaf(*map(F.col, fields)).alias("hash"), said.alias("more")))
    carried = F.concat("hash", F.coalesce("more", F.lit("{}")))
    numbered = ranked(leaves, "id", "hash").select("grp", "idx", "n", "hash", carried.alias("carried"))
    proofs, roots = reduced(numbered, fanout, levels)

    tops = ranked(roots.select(F.lit("").alias("grp"), F.col("grp").alias("own"), "root"), "own")
    top_proofs, top_roots = reduced(tops.select("grp", "idx", "n", F.col("root").alias("hash"), F.concat("root", "own").alias("carried")), fanout, levels)
    above = top_proofs.join(F.broadcast(top_roots), "grp")  # one root
    above = cut(above.select(F.substring("carried", 65, 1 << 30).alias("grp"), F.substring("carried", 1, 64).alias("subroot"), "root", F.col("lefts").alias("__l"), F.col("rights").alias("__r")))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join(["id string", *(f"a{k} string" for k in range(len(also)))])
    out = proofs.join(broadcast_if_small(above, 4096), "grp").withColumn("__more", F.from_json(F.substring("carried", 65, 1 << 30), schema))
    return out.select(
        F.col("__more.id").cast(kind).alias(id_col), F.substring("carried", 1, 64).alias("leaf"), "subroot", "root",
        F.concat("lefts", "__l").alias("lefts"), F.concat("rights", "__r").alias("rights"), *[F.col(f"__more.a{k}").alias(name) for k, name in enumerate(also)],
    )


def tampered_leaf(docs_fields: tuple[str, ...] = FIELDS, count: str = "n_chars", id_col: str = "doc_id", every: int = 7) -> Column:
    """The leaf of a row whose `count` was raised by one, where `every` divides the CRC-32 of its identifier in decimal; else null. A null count stays."""
    more = (F.col(count).cast("decimal(38,0)") + 1).cast("string")
    return F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, leaf(*[more if c == count else F.col(c) for c in docs_fields]))

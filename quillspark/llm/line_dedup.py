"""Line deduplication with sharded cuckoo filters over exact reference counts, kept in an index that documents enter and leave.

An index is a folder of three Parquet tables:

* `lines`: the keys each document holds (the exact source of every count),
* `counts`: for each key how often documents hold it, and the smallest and largest of them,
* `filters`: for each shard a cuckoo filter of its shared keys, those that two documents or more hold.

insert() adds a batch's lines to the counts and puts keys that have become shared into the filters of their shards. delete() takes documents
out: the keys that they held are counted anew from the lines that are left, and what is no longer shared is taken out of the filters. Only filters that
change are unpacked; one that is full is built anew from the exact counts of its shard. Every change writes a new version beside the old one and
is done when its last table is, so that a job that dies leaves the index as it was. Inserting and then deleting the same documents
gives the same lines and counts, filters of the same keys, and so the same results.

A document's line goes if its shard's filter knows the key, the exact table confirms it, and a smaller document holds the key. Filters
have no false negatives, so what one doesn't know stays and never reaches the join with the exact table.

Hot lines: counts are pre-aggregated on the map side. A shard's lines are dealt out by document to as many parts as its number of lines
needs, each beside a copy of the shard's filter, so that no task gets more than about PART_LINES lines; the join with the exact table
is a plain one that Spark can split.

Defined results: a null or empty text is one empty line. Lines end at \\n only. A line's key is the line without blanks at its ends, A-Z
lower-cased; keys of fewer than MIN_KEY code points never go. Rows that repeat an identifier are one document to the counts, and
each row gives its own result; a null identifier counts as the smallest. A document that is inserted again holds the lines of both its texts.
Deleting what the index doesn't hold changes nothing. Only the named columns are read; names that begin with two underscores are the operator's own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, broadcast_if_small, count_below, cut, delete_path, let, staging_path

MIN_KEY = 10
BLANKS = " \t\n\x0b\x0c\r"
SHARD_KEYS, PART_LINES = 20_000, 50_000
NULL_ID = -(1 << 63)


class CuckooFilter:
    """16-bit fingerprints in buckets of four, numpy all through; a key's two buckets are i and i xor hash(fingerprint)."""

    SLOTS, KICKS = 4, 200

    def __init__(self, table: np.ndarray):
        self.table = table  # uint16 [a power of two of buckets, SLOTS]; 0 is an empty slot

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter that holds all the (distinct) uint64 keys."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(keys)) / (cls.SLOTS * 0.8)))))
        while True:
            made = cls(np.zeros((buckets, cls.SLOTS), dtype=np.uint16))
            if made.insert(keys):
                return made
            buckets *= 2

    @staticmethod
    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self.mixed(keys)
        prints = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, first, self.other(first, prints)

    def other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (self.mixed(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds the keys; False if the filter is too full to hold them."""
        prints, first, second = self.places(keys)
        left = np.arange(len(keys))
        for bucket in (first, second):
            for _ in range(self.SLOTS):
                if not len(left):
                    return True
                free = self.table[bucket[left]] == 0
                _, once = np.unique(bucket[left], return_index=True)  # one newcomer a bucket at a time
                put = once[free[once].any(axis=1)]
                self.table[bucket[left[put]], free[put].argmax(axis=1)] = prints[left[put]]
                left = np.delete(left, put)
        for k in left:
            at, homeless = int(second[k]), prints[k]
            for kick in range(self.KICKS):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = homeless
                    break
                slot = kick % self.SLOTS
                homeless, self.table[at, slot] = self.table[at, slot], homeless
                at = int(self.other(np.array([at]), np.array([homeless], dtype=np.uint16))[0])
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one copy of each key; only keys that were inserted may be given."""
        for p, a, b in zip(*self.places(keys), strict=True):
            for at in (a, b):
                if len(slot := np.flatnonzero(self.table[at] == p)):
                    self.table[at, slot[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self.places(keys)
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, dtype=np.uint16).reshape(-1, cls.SLOTS).copy())


def keyed(text: Column) -> Column:
    """array<struct<a, b>>: the hashes of each line's key, 128 bits, null for keys that are too short; in order of the lines."""
    keys = F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.transform(keys, lambda key: F.when(F.char_length(key) >= MIN_KEY, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))))


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, a, b: the distinct keys of each row."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc")
    keys = F.array_distinct(F.filter(keyed(F.coalesce(F.col(text_col), F.lit(""))), lambda k: k.isNotNull()))
    return docs.select(doc, F.explode(keys).alias("k")).select("doc", "k.a", "k.b")


def reference_counts(lines: DataFrame) -> DataFrame:
    """a, b, n_docs, first and last document: exact, pre-aggregated before the shuffle."""
    return lines.groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.min("doc").alias("first"), F.max("doc").alias("last"))


def filter_keys(rows: pd.DataFrame) -> np.ndarray:
    """One uint64 for each key, of both its hashes."""
    a, b = (rows[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("a", "b"))
    return a ^ (b * np.uint64(0xD6E8FEB86659FD93))


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("b"), F.lit(shards)).cast("int")


def built_filters(shared: DataFrame, shards: int) -> DataFrame:
    """shard, filter (null for a shard without shared keys) of all shards, from the exact keys."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"shard": int(rows["shard"].iloc[0]), "filter": CuckooFilter.of(filter_keys(rows)).to_bytes()}])

    built = shared.select("a", "b", shard_of(shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, filter binary")
    return shared.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(built, "shard", "left")


def changed_filters(filters: DataFrame, changes: DataFrame, shared: DataFrame, shards: int) -> DataFrame:
    """filters with the keys of changes (a, b, comes) put in or taken out; only shards that change are looked into."""

    def change(before: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        shard, raw, keys = int(mine["shard"].iloc[0]), before["filter"].iloc[0], filter_keys(mine)
        comes = mine["comes"].to_numpy(dtype=bool)
        if raw is None:
            made: CuckooFilter | None = CuckooFilter.of(keys[comes])
        else:
            made = CuckooFilter.from_bytes(raw)
            made.delete(keys[~comes])
            made = made if made.insert(keys[comes]) else None
        return pd.DataFrame([{"shard": shard, "filter": made and made.to_bytes(), "full": made is None}])

    changes = cut(changes.select("a", "b", "comes", shard_of(shards).alias("shard")))
    touched = changes.select("shard").distinct()
    done = filters.join(touched, "shard", "left_semi").groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(change, "shard int, filter binary, full boolean")
    done = cut(done)
    full = done.where("full").select("shard")
    again = built_filters(shared.join(full, shard_of(shards) == full["shard"], "left_semi"), shards).join(full, "shard", "left_semi")
    return filters.join(touched, "shard", "left_anti").unionByName(done.where("not full").drop("full")).unionByName(again)


class LineIndex:
    """The lines, counts and filters of a set of documents, in the newest version under `path`, a folder that all executors share."""

    TABLES = ("lines", "counts", "filters")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.version = max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(at):
            return []
        found = [int(x.getPath().getName()) for x in store.listStatus(at)]
        return [v for v in found if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{v}/filters/_SUCCESS"))]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.version}/{name}")

    def shared(self) -> DataFrame:
        return self.table("counts").where("first < last")

    def _write(self, lines: DataFrame, counts: DataFrame, filters) -> None:
        """A new version; filters(shared, shards) is called when lines and counts are written."""
        at = f"{self.path}/{self.version + 1}"
        read = lambda name, df: (df.write.mode("overwrite").parquet(f"{at}/{name}"), self.spark.read.parquet(f"{at}/{name}"))[1]
        lines = read("lines", lines)
        counts = read("counts", counts(lines) if callable(counts) else counts)
        filters(counts.where("first < last")).write.mode("overwrite").parquet(f"{at}/filters")
        self.version += 1

    def _filters(self, changes: DataFrame):
        """What makes the next version's filters: the old ones changed, or all of them anew where shards have become too large."""
        old = self.table("filters")
        shards = old.count()

        def made(shared: DataFrame) -> DataFrame:
            needed = shards_for(shared)
            return built_filters(shared, needed) if needed > 4 * shards else changed_filters(old, changes, shared, shards)

        return made

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        new = line_keys(docs, id_col, text_col)
        if not self.version:
            self._write(new, reference_counts, lambda shared: built_filters(shared, shards_for(shared)))
            return
        new = cut(new)
        more = reference_counts(new).withColumn("was", F.lit(False))
        both = self.table("counts").withColumn("was", F.col("first") < F.col("last")).unionByName(more).groupBy("a", "b")
        both = cut(both.agg(F.sum("n_docs").alias("n_docs"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("was").alias("was")))
        risen = both.where("first < last and not was").select("a", "b", F.lit(True).alias("comes"))
        self._write(self.table("lines").unionByName(new), both.drop("was"), self._filters(risen))

    def delete(self, gone: DataFrame, id_col: str = "doc_id") -> None:
        """Takes out the documents whose identifiers are in `gone`. Only keys that one of them held are counted anew."""
        if not self.version:
            return
        ids = gone.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc")).distinct()
        lines, counts = self.table("lines"), self.table("counts")
        left = lines.join(ids, "doc", "left_anti")
        touched = cut(lines.join(ids, "doc", "left_semi").select("a", "b").distinct())
        again = cut(reference_counts(left.join(touched, ["a", "b"], "left_semi")))
        fallen = self.shared().join(touched, ["a", "b"], "left_semi").join(again.where("first < last"), ["a", "b"], "left_anti").select("a", "b", F.lit(False).alias("comes"))
        self._write(left, counts.join(touched, ["a", "b"], "left_anti").unionByName(again), self._filters(fallen))

    def dropped(self, lines: DataFrame | None = None) -> DataFrame:
        """doc, a, b of every line key (of the documents that the index holds, or of these lines) that a smaller document of the index holds too."""
        lines = self.table("lines") if lines is None else lines
        filters = self.table("filters").where("filter is not null")
        shards = self.table("filters").count()
        lines = lines.select("doc", "a", "b", shard_of(shards).alias("shard"))
        parts = cut(lines.groupBy("shard").agg(F.ceil(F.count("*") / PART_LINES).cast("int").alias("parts")))
        dealt = lines.join(broadcast_if_small(parts, 16), "shard").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).drop("parts")
        copies = filters.join(broadcast_if_small(parts, 16), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def probe(mine: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            if not len(mine) or not len(state):
                return mine.iloc[:0][["doc", "a", "b"]]
            return mine.loc[CuckooFilter.from_bytes(state["filter"].iloc[0]).contains(filter_keys(mine)), ["doc", "a", "b"]]

        possible = dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(probe, "doc long, a long, b long")
        return possible.join(self.shared().select("a", "b", "first"), ["a", "b"]).where("first < doc").select("doc", "a", "b")


def shards_for(shared: DataFrame) -> int:
    return max(1, -(-shared.count() // SHARD_KEYS))


def with_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: LineIndex | None = None) -> DataFrame:
    """docs, all columns as they were, with __kept (the text without the lines that go), __n_lines and __n_dropped. An index that holds
    these documents, and maybe more, may be given; else one is made of docs and deleted again."""
    own = index or LineIndex(docs.sparkSession, staging_path(docs.sparkSession, "line-index"))
    if index is None:
        own.insert(docs, id_col, text_col)
    gone = own.dropped() if index is None else own.dropped(line_keys(docs, id_col, text_col))
    gone = cut(gone.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("__gone")))
    if index is None:
        delete_path(docs.sparkSession, own.path)
    rows = docs.join(gone, F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)) == gone["doc"], "left").select(*[docs[c] for c in docs.columns], "__gone")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = rows.withColumn("__lines", F.split(text, "\n")).withColumn("__keys", F.when(F.col("__gone").isNotNull(), keyed(text)))
    known = lambda key: F.coalesce(F.get("__gone", count_below(F.col("__gone"), key)) == key, F.lit(False))
    stay = let(F.col("__keys"), lambda keys: F.filter("__lines", lambda line, i: keys[i].isNull() | ~known(keys[i])))
    rows = rows.withColumn("__stay", F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(stay))
    return rows.select(*docs.columns, F.array_join("__stay", "\n").alias("__kept"), F.size("__lines").alias("__n_lines"), (F.size("__lines") - F.size("__stay")).alias("__n_dropped"))


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: LineIndex | None = None) -> DataFrame:
    """id, text without the lines that go, n_lines, n_dropped."""
    kept = with_kept(docs.select(id_col, text_col), id_col, text_col, index)
    return kept.select(id_col, F.col("__kept").alias(text_col), F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"))

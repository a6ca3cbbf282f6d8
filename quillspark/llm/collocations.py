"""Phrase collocation mining by hierarchical pair naming: the frequent phrases of up to `longest` words, their weakest cut, and which a longer one says as well.

1. Blocks. Texts are cut into pieces at punctuation and these into words, and packed into blocks of one language and some BLOCK_WORDS words: a block's own
   vocabulary, its counts, and its words as numbers, pieces kept apart. Blocks are written once; what comes after reads them instead of texts.
2. Names. A word is named over all blocks; a phrase of k words by the pair of names of its first and its last k - 1 words. Every block sends each pair of
   neighbouring names once, with its count, to the bucket of the pair. A bucket adds them up, gives the pairs found `least` times or more
   their names, and sends each block the names of what that block had sent. A block then writes the new names in place of the old ones and goes on to the
   next length. What is shorter than a frequent phrase is as frequent, so nothing is lost where a block drops infrequent names.
3. Pointers. A name is stored with the two that it is made of. Following the left ones gives a phrase's beginnings, the right ones its endings, so that all cuts
   are read off two joins a length; and a phrase lies in a longer one just where it is reached from that, the frequency of which is passed down.

Every exchange is bounded by what blocks hold: a block sends a pair once, however frequent, so no bucket gets more than a row of each block for one pair, and no task
more than a block or a bucket (buckets are as many as there are millions of words). Nothing is broadcast but one row a language, if these are few.

Results: for each group the `top` phrases of 2 to `longest` words with f(phrase) = a >= least, by score descending, a descending, phrase ascending by its bytes.
A cut after k words has score floor(2000000 a / (l + r)), l and r the frequencies of both parts; the lowest one counts, and among equals the smallest k.
Phrases with 100 f(longer) >= share a for some longer candidate are left out. Products are decimals of 38 digits.

Defined results: a null text is empty and has no words; a null group is `und`, together with rows that say so; repeated rows count again; a table without frequent
phrases gives no rows. Identifiers don't matter. A text of any length is cut at its pieces; one piece is never cut. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import broadcast_if_small, cut, text_slices
from quillspark.llm.shingles import ODD, mixed

LONGEST, LEAST, SHARE, TOP = 4, 30, 80, 2000
#: Words of a block, bytes of a text that are split at a time, and words for which there is a bucket.
BLOCK_WORDS, PART, BUCKET_WORDS = 1 << 21, 1 << 20, 1 << 20
LEAST_BUCKETS = 16
#: A-Z become a-z, what ends a piece a full stop.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"." * 10)
STOP = b"."


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte by byte: first all lowest bytes, then the next ones."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def pack_places(places: np.ndarray) -> bytes:
    """Ascending places, as steps."""
    return pack(np.diff(places, prepend=0).astype(np.int32))


def unpack_places(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.int32), dtype=np.int64)


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def unpack_words(raw: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(raw).split(b"\n")


class Vocabulary(dict):
    """word: number; the stop between pieces is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def split_words(raw: bytes) -> Iterator[list[bytes]]:
    """A text's words and stops, about PART bytes at a time; it ends with a stop."""
    raw = raw.translate(TABLE) + STOP
    at = 0
    while at < len(raw):
        end = raw.rfind(STOP, at, at + PART) + 1 or raw.find(STOP, at) + 1
        yield raw[at:end].replace(STOP, b" . ").split()
        at = end


def blocks(docs: DataFrame, text_col: str, group_col: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """block, grp, words, counts, seq (numbers of words from 1, 0 between pieces), all packed, and n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[str, tuple[Vocabulary, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def flush(grp: str) -> pa.RecordBatch:
            nonlocal made
            vocabulary, parts = held.pop(grp)
            del sizes[grp]
            seq = np.concatenate(parts)
            counts = np.bincount(seq, minlength=len(vocabulary))[1:].astype(np.int64)
            made += 1
            row = [(part << 32) + made, grp, pack_words(list(vocabulary)[1:]), pack(counts), pack(seq), int(counts.sum())]
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], ["block", "grp", "words", "counts", "seq", "n_words"])

        for piece in text_slices(batches):
            by_grp: dict[str, list[bytes]] = {}
            for grp, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                by_grp.setdefault(grp, []).append(text)
            for grp, texts in by_grp.items():
                for words in split_words(STOP.join(texts)):
                    if grp not in held:
                        held[grp], sizes[grp] = (Vocabulary({STOP: 0}), []), 0
                    vocabulary, parts = held[grp]
                    parts.append(np.fromiter(map(vocabulary.__getitem__, words), dtype=np.uint32, count=len(words)))
                    sizes[grp] += len(words)
                    if sizes[grp] >= block_words:
                        yield flush(grp)
                while sum(sizes.values()) > 2 * block_words:
                    yield flush(max(sizes, key=sizes.__getitem__))
        for grp in list(held):
            yield flush(grp)

    rows = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("grp"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "block long, grp string, words binary, counts binary, seq binary, n_words long")


SENT = "bucket long, block long, grp string, at binary, words binary, lefts binary, rights binary, counts binary"
#: Rows with an id name a phrase; rows with a block tell that block which of the keys it sent (by their places) have which names.
NAMED = "id long, grp string, word binary, left long, right long, f long, block long, at binary, ids binary"


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places that go there."""
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(bucket[order])) + 1
    for places in np.split(order, ends):
        if len(places):
            yield int(bucket[places[0]]), places


def word_keys(encoded: DataFrame, buckets: int) -> DataFrame:
    """SENT rows of every block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, grp, words, counts = (batch.column(c)[i].as_py() for c in range(4))
                words, counts = unpack_words(words), unpack(counts)
                to = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % buckets
                rows = [(k, block, grp, pack_places(at), pack_words([words[j] for j in at]), None, None, pack(counts[at])) for k, at in by_bucket(to)]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    return encoded.where("n_words > 0").select("block", "grp", "words", "counts").mapInArrow(run, SENT)


KINDS = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
NAMES = [x.split()[0] for x in SENT.split(", ")]


def named(sent: DataFrame, least: int) -> DataFrame:
    """NAMED rows: keys that all blocks together have at least `least` times."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        counts = [unpack(x) for x in rows["counts"]]
        ends = np.cumsum([len(x) for x in counts])
        n, at = np.concatenate(counts), np.concatenate([unpack_places(x) for x in rows["at"]])
        if rows["words"].iloc[0] is not None:
            words = [unpack_words(x) for x in rows["words"]]
            first, key = word_classes(rows["grp"], words)
        else:
            left, right = (np.concatenate([unpack(x) for x in rows[c]]) for c in ("lefts", "rights"))
            first, key = pair_classes(left, right)
        total = np.bincount(key, weights=n, minlength=len(first)).astype(np.int64) if n.sum() < 1 << 53 else np.array([n[key == k].sum() for k in range(len(first))], dtype=np.int64)
        often = total >= least
        ids = np.where(often, (bucket << 32) + np.cumsum(often) - 1, -1)
        owner = np.searchsorted(ends, first[often], side="right")
        grams = pd.DataFrame({"id": ids[often], "grp": rows["grp"].to_numpy()[owner], "f": total[often]})
        if rows["words"].iloc[0] is not None:
            flat = [w for x in words for w in x]
            grams["word"] = [flat[k] for k in first[often]]
        else:
            grams["left"], grams["right"] = left[first[often]], right[first[often]]
        told, known = [], ids[key]
        for block, a, b in zip(rows["block"], np.concatenate([[0], ends[:-1]]), ends, strict=True):
            has = known[a:b] >= 0
            if has.any():
                told.append((block, pack_places(at[a:b][has]), pack(known[a:b][has])))
        out = pd.concat([grams, pd.DataFrame(told, columns=["block", "at", "ids"])]).reindex(columns=[x.split()[0] for x in NAMED.split(", ")])
        return out.astype({c: "Int64" for c in ("id", "left", "right", "f", "block")}).astype(object).where(lambda x: x.notna(), None)

    def word_classes(grps: pd.Series, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        seen, key, first = {}, [], []
        for grp, mine in zip(grps, words, strict=True):
            for word in mine:
                k = seen.setdefault((grp, word), len(first))
                if k == len(first):
                    first.append(len(key))
                key.append(k)
        return np.array(first, dtype=np.int64), np.array(key, dtype=np.int64)

    def pair_classes(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((right, left))
        opens = np.concatenate([[True], (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)])
        key = np.empty(len(order), dtype=np.int64)
        key[order] = np.cumsum(opens) - 1
        return order[opens], key

    return sent.groupBy("bucket").applyInPandas(count, NAMED)


def pairs_of(seq: np.ndarray, known: dict[int, tuple[np.ndarray, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right and count of a block's distinct pairs of neighbouring names of length - 1 words. known: by length, the places among what
    the block had sent of that length, and their names."""
    names = np.full(int(seq.max()) + 1 if len(seq) else 1, -1, dtype=np.int64)
    at, ids = known.get(1, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    names[at + 1] = ids  # words were sent from 0, in seq they begin with 1
    now = np.where(names[seq] >= 0, seq.astype(np.int64), -1)  # numbers within the block; names[now] are those over all blocks
    for k in range(2, length + 1):
        ok = np.flatnonzero((now[:-1] >= 0) & (now[1:] >= 0))
        found, inverse, counts = np.unique(now[ok] * len(names) + now[ok + 1], return_inverse=True, return_counts=True)
        left, right = names[found // len(names)], names[found % len(names)]
        if k == length:
            return left, right, counts
        at, ids = known.get(k, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        names = np.full(len(found) + 1, -1, dtype=np.int64)
        names[at] = ids
        now = np.full(len(now) - 1, -1, dtype=np.int64)
        now[ok] = np.where(names[inverse] >= 0, inverse, -1)
    raise ValueError("length is 2 or more")


def pair_keys(encoded: DataFrame, known: DataFrame, length: int, buckets: int) -> DataFrame:
    """SENT rows of every block's pairs. known(block, length, at, ids): what blocks were told so far."""

    def run(mine: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(told):
            return pd.DataFrame(columns=NAMES)
        block, grp, raw = mine[["block", "grp", "seq"]].iloc[0]
        joined = lambda rows, c, how: np.concatenate([how(x) for x in rows[c]])
        left, right, counts = pairs_of(unpack(raw, np.uint32), {int(k): (joined(x, "at", unpack_places), joined(x, "ids", unpack)) for k, x in told.groupby("length")}, length)
        if not len(left):
            return pd.DataFrame(columns=NAMES)
        to = (mixed(mixed(left.view(np.uint64)) + right.view(np.uint64) * ODD[2]) >> np.uint64(1)).astype(np.int64) % buckets
        return pd.DataFrame([(k, block, grp, pack_places(at), None, pack(left[at]), pack(right[at]), pack(counts[at].astype(np.int64))) for k, at in by_bucket(to)], columns=NAMES)

    return encoded.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(run, SENT)


def named_phrases(docs: DataFrame, text_col: str = "text", group_col: str = "lang", longest: int = LONGEST, least: int = LEAST, block_words: int = BLOCK_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """By length, grp, id, left, right (names of one word less), f, and the word where it is one; and grp, n: all its words."""
    encoded = cut(blocks(docs, text_col, group_col, block_words))
    counted = cut(encoded.groupBy("grp").agg(F.sum("n_words").alias("n")))
    words = counted.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-words // BUCKET_WORDS))
    state = encoded.where("n_words > 0").select("block", "grp", "seq")
    levels, known = [], None
    for length in range(1, longest + 1):
        sent = word_keys(encoded, buckets) if length == 1 else pair_keys(state, known, length, buckets)
        told = cut(named(sent, least))
        levels.append(told.where("id is not null").select("grp", "id", "left", "right", "f", F.col("word").cast("string").alias("word")))
        more = told.where("block is not null").select("block", F.lit(length).alias("length"), "at", "ids")
        known = more if known is None else known.unionByName(more)
    return levels, counted


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 a / (l + r)), exactly."""
    wide = lambda x: x.cast("decimal(20,0)")
    return F.call_function("div", F.lit(2_000_000).cast("decimal(8,0)") * wide(a), wide(l) + wide(r)).cast("long")


def mine(docs: DataFrame, text_col: str = "text", group_col: str = "lang", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int | None = TOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """grp, rank, phrase, a, l, r, n, score. With top None all phrases come back."""
    levels, counted = named_phrases(docs, text_col, group_col, longest, least, block_words)
    one = F.array(F.col("f"))
    below = levels[0].select("id", F.col("word").alias("phrase"), F.col("word").alias("last"), one.alias("starts"), one.alias("ends"))
    found = []
    for k in range(2, longest + 1):
        left = below.select(F.col("id").alias("left"), "phrase", "starts")
        right = below.select(F.col("id").alias("right"), "last", "ends")
        now = levels[k - 1].join(left, "left").join(right, "right")
        now = now.select("grp", "id", "left", "right", "f", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("starts", one).alias("starts"), F.concat("ends", one).alias("ends"))
        now = cut(now)
        cuts = F.array(*[F.struct(score(F.col("f"), F.col("starts")[j - 1], F.col("ends")[k - j - 1]).alias("score"), F.lit(j).alias("k"), F.col("starts")[j - 1].alias("l"), F.col("ends")[k - j - 1].alias("r")) for j in range(1, k)])
        found.append(now.select("grp", "id", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("cut"), F.lit(k).alias("words")))
        below = now
    rows = found[-1]
    for k in range(longest - 1, 1, -1):  # a phrase lies in one that is two words longer only by way of one in between, which is as frequent or more
        longer = levels[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("most")).groupBy("id").agg(F.max("most").alias("most"))
        rows = rows.unionByName(found[k - 2].join(longer, "id", "left").where(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True))).drop("most"))
    order = Window.partitionBy("grp").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(broadcast_if_small(counted, 64), "grp").select("grp", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

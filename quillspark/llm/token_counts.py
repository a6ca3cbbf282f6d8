"""Token counts by section: whole documents are encoded once, and their tokens' character spans joined with the sections' intervals.

Sections are intervals of a document's characters that don't overlap (fields put one after the other, lines, headings' bodies). Tokens of a whole document often
reach over an end of a section, so counting sections one by one would give other numbers. Each token goes where RULE says:

* `first`: to the section that holds its first character,
* `largest`: to the section that holds most of its bytes, the earlier of equals,
* `split`: to every section it touches, by its share of bytes.

What lies in no section is counted as `outside`, so that counts always add up to the document's tokens.

Token spans come from the byte lengths of the vocabulary's entries: a byte-level encoding covers its text without gaps, so the running sum of
lengths is each token's place, and the places of characters' first bytes turn bytes into characters. Tokens and sections both lie in
order, so the interval join is a binary search for each token.

Defined results: a null or empty text has no tokens. Empty sections and sections beyond the text's end count nothing; null sections are none. Rows are handled
one by one, repeated or not. Only the named columns are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import let, running, text_slices

RULES = ("first", "largest", "split")
SECTIONS = "array<struct<start:int,end:int>>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Counter:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each token, and the byte at which each character begins (and one more: the end)."""
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        ends = np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), dtype=np.int64)]) if text else np.zeros(0, dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return starts, ends, np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))

    def count(self, text: str, sections: list[tuple[int, int]], rule: str) -> tuple[int, int, list[float], float]:
        """Tokens, tokens that reach over a section's edge, tokens of each section, tokens outside."""
        starts, ends, characters = self.spans(text)
        if not sections or not len(ends):
            return len(ends), 0, [0.0] * len(sections), float(len(ends))
        edges = characters[np.clip(np.array(sections, dtype=np.int64), 0, len(characters) - 1)]
        low, high = edges[:, 0], np.maximum(edges[:, 0], edges[:, 1])
        # all pieces between edges, in order: outside, section, outside, section, ..., outside
        marks = np.concatenate([[0], np.stack([low, high], axis=1).ravel(), [characters[-1]]])
        if (np.diff(marks) < 0).any():
            raise ValueError("sections overlap or are out of order")
        piece_at = lambda byte: np.searchsorted(marks, byte, side="right") - 1  # noqa: E731  the last piece that begins at or before
        first, last = piece_at(starts), piece_at(ends - 1)
        crossing = int((first != last).sum())
        found = np.zeros(len(marks), dtype=np.float64)
        if rule == "first":
            np.add.at(found, first, 1.0)
        else:
            inside = first == last
            np.add.at(found, first[inside], 1.0)
            for k in np.flatnonzero(~inside):
                pieces = np.arange(first[k], last[k] + 1)
                share = np.minimum(ends[k], marks[pieces + 1]) - np.maximum(starts[k], marks[pieces])
                if rule == "split":
                    found[pieces] += share / (ends[k] - starts[k])
                else:
                    found[pieces[share.argmax()]] += 1
        counts = found[1 : 2 * len(sections) : 2]
        return len(ends), crossing, counts.tolist(), float(found.sum() - counts.sum())


_counters: dict[tuple, Counter] = {}


def attribute(docs: DataFrame, vocabulary_path: str, pattern: str, sections: Column, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_crossing, counts array<double> (of each section, in their order) and outside double, for each row."""
    if rule not in RULES:
        raise ValueError(f"a rule of {RULES} is needed")
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path))  # the vocabulary: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary_path, pattern)
        counter = _counters.get(key) or _counters.setdefault(key, Counter(ranks.value, pattern))
        for piece in text_slices(batches):
            texts, starts, ends = (piece.column(k).to_pylist() for k in (1, 2, 3))
            done = [counter.count(t, list(zip(a, b, strict=True)), rule) for t, a, b in zip(texts, starts, ends, strict=True)]
            n, crossing, counts, outside = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(crossing, pa.int64()), pa.array(counts, pa.list_(pa.float64())), pa.array(outside, pa.float64())], ["id", "n_tokens", "n_crossing", "counts", "outside"])

    none = F.array().cast(SECTIONS)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(sections.cast(SECTIONS), none).alias("s")).select("id", "text", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
    kinds = {"n_tokens": T.LongType(), "n_crossing": T.LongType(), "counts": T.ArrayType(T.DoubleType()), "outside": T.DoubleType()}
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(c, k) for c, k in kinds.items())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def lines(text: Column) -> Column:
    """A text's lines as sections, each with the newline that ends it."""
    sizes = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.char_length(x) + 1)

    def placed(both: Column) -> Column:
        return F.transform(both["ends"], lambda end, i: F.struct((end - F.get(both["sizes"], i)).alias("start"), end.alias("end")))

    return let(sizes, lambda n: let(F.struct(n.alias("sizes"), running(n).alias("ends")), placed)).cast(SECTIONS)


def fields(*columns: str, between: str = "\n") -> tuple[Column, Column]:
    """The text of several fields put one after the other, and the sections they take up in it."""
    texts = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    sections, at = [], F.lit(0)
    for t in texts:
        sections.append(F.struct(at.cast("int").alias("start"), (at + F.char_length(t)).cast("int").alias("end")))
        at = at + F.char_length(t) + len(between)
    return F.concat_ws(between, *texts), F.array(*sections)

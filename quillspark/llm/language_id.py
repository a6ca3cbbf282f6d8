"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of a bounded sample of labelled texts. A text is encoded with
every dictionary, in chunks so that a long text never becomes its own dictionary, and the language whose sizes sum
to the least wins. The margin to the runner-up, as a share of its size, is the score; narrow margins are rejected.

Labelled texts without a letter teach nothing: a language that has no others is not learned and takes no part. Of a labelled text
that is too long a piece is sampled, from its first letter on. A language with a small sample keeps all of it and
bounds no other one's: its dictionary is filled up in front with zero bytes, which no encoded text has, so that all are coded alike.

Defined results: a null text, and a text without a letter, is `und`, scores 0 and is rejected. Equal sizes go to the
first language in order of name, score 0 and are rejected. Where nothing can be learned, everything is `und`. Rows are handled
one by one, so repeated rows give repeated results; columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import text_slices

UNKNOWN = "und"
#: Labelled rows that may be sampled for each language, the bytes that are taken of one at most, and the bytes of a dictionary.
SAMPLE_ROWS, SAMPLE_ROW_BYTES, DICTIONARY_BYTES = 200, 20_000, 48_000
CHUNK_BYTES = 8_000
#: The least score that is accepted.
MIN_MARGIN = 0.001
NO_WORD = re.compile(r"[\W\d_]+")
LETTER = r"\p{L}"
LEVEL = 6


def plain(text: str) -> bytes:
    """What is encoded: lower-cased words, so that capitals, digits and ornaments don't count; nothing if no character is a letter."""
    words = NO_WORD.sub(" ", text.lower()).strip()
    return words.encode("utf-8", "replace") if any(map(str.isalpha, words)) else b""


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language, all of one size. The sample is chosen by a hash of the identifier: SAMPLE_ROWS rows of each
    language are expected, whatever the size of the table."""
    text = F.col(text_col)
    piece = F.regexp_extract(text, rf"(?s){LETTER}.{{0,{SAMPLE_ROW_BYTES // 4 - 1}}}", 0)  # a character has 4 bytes at most
    usable = labelled.select(F.col(id_col).cast("string").alias("id"), text.alias("text"), F.when(F.octet_length(text) <= SAMPLE_ROW_BYTES, text).otherwise(piece).alias("piece"), F.col(lang_col).alias("lang")).where("lang is not null").where(F.col("text").rlike(LETTER))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    grain = 1 << 40
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(grain, grain * SAMPLE_ROWS // n)))])
    rank = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(grain))
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for r in usable.withColumn("rank", rank).where(F.col("rank") < share[F.col("lang")]).select("lang", "rank", "piece").collect():
        if raw := plain(r["piece"]):
            texts.setdefault(r["lang"], []).append((r["rank"], raw))
    joined = {lang: b" ".join(t for _, t in sorted(found))[:DICTIONARY_BYTES] for lang, found in texts.items()}
    size = max(map(len, joined.values()), default=0)
    return {lang: raw.rjust(size, b"\0") for lang, raw in sorted(joined.items())}


class Coder:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(dictionaries)
        self.coders = []
        for lang in self.languages:
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(dictionaries[lang]), source_size=CHUNK_BYTES, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False)
            raw.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=how))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        raw = plain(text or "")
        if not raw or not self.coders:
            return UNKNOWN, 0.0, False
        sizes = [0] * len(self.coders)
        for at in range(0, len(raw), CHUNK_BYTES):
            chunk = raw[at : at + CHUNK_BYTES]
            for k, coder in enumerate(self.coders):
                sizes[k] += len(coder.compress(chunk))
        ranked = sorted(zip(sizes, self.languages, strict=True))
        if len(ranked) == 1:
            return ranked[0][1], 1.0, True
        score = (ranked[1][0] - ranked[0][0]) / ranked[1][0]
        return ranked[0][1], score, score >= MIN_MARGIN


def with_predictions(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", **names: str) -> DataFrame:
    """docs, all columns as they were, and three more: lang_pred, score and accepted, under other names where `names` gives them. Each text goes to the tasks once."""
    called = [names.get(c, c) for c in ("lang_pred", "score", "accepted")]
    kinds = [T.StringType(), T.DoubleType(), T.BooleanType()]
    columns = [f"c{k}" for k in range(len(docs.columns))]
    plain_text = docs.columns.index(text_col)
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(columns, docs.schema.fields, strict=True)), *map(T.StructField, called, kinds)])
    made: dict[int, Coder] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = made.get(0) or made.setdefault(0, Coder(dictionaries))
        for piece in text_slices(batches, column=plain_text):
            found = [coder.predict(x) for x in piece.column(plain_text).to_pylist()]
            lang, score, accepted = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], schema.names)

    said = docs.toDF(*columns).withColumn(columns[plain_text], F.col(columns[plain_text]).cast("string")).mapInArrow(run, schema)
    return said.select(*[F.col(c).alias(name) for c, name in zip(columns, docs.columns, strict=True)], *called)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score and accepted for each row, and the columns named in keep."""
    rows = docs.select(F.col(text_col).cast("string").alias("__text"), id_col, *keep)
    return with_predictions(rows, dictionaries, "__text").drop("__text")


def fold(id_col: str = "doc_id") -> Column:
    """The remainder that says whether a document is held out: 1."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))

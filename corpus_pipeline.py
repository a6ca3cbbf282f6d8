"""The corpus pipeline: stages over documents, each written as Parquet and read again.

language_id     documents whose language can't be told (no letters, or too narrow a margin) go
line_dedup      lines that a smaller document holds too go, and documents of which no line stays; n_chars follows the text
ngram_jaccard   of each group of similar documents the smallest stays
decontaminate   documents that hold a window of a benchmark item go
sentencepiece   what stays is encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256

All stages but the last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontamination, language_id, line_dedup, ngram_jaccard
from quillspark.llm.common import delete_path, staging_path, table
from quillspark.llm.queries import encoded_digests


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = language_id.learn(docs.where(language_id.fold() != 1))
    said = language_id.with_predictions(docs, learned, lang_pred="__lang", score="__score", accepted="__accepted")
    return said.where("__accepted").select(*docs.columns)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.with_kept(docs).where("__n_dropped < __n_lines")
    changed = {"text": F.when(F.col("text").isNotNull(), F.col("__kept")), "n_chars": F.char_length("__kept").cast("long")}
    return kept.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedupe_lines),
    ("ngram_jaccard", join_similar),
    ("decontaminate", decontaminate),
    ("sentencepiece", encode_decode),
]

#: Compression and the subword encoding have no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir. Each stage's table lies in the shared folder until the next one is written, so that a lost executor
    costs no earlier stage; the last one's stays, as the result is read from it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = staging_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs

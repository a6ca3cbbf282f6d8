"""Every stage against a plain version over its own input."""

import sentencepiece
from test_decontamination import brute as contaminated
from test_line_dedup import brute as deduped
from test_ngram_jaccard import brute as components

import corpus_pipeline
from quillspark.llm import language_id, queries


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "ngram_jaccard", "decontaminate", "sentencepiece"]

    known = language_id.Coder(language_id.learn(docs.where(language_id.fold() != 1)))
    one = spark.createDataFrame(stages["language_id"](spark, docs, sf).collect(), docs.schema)
    assert sorted(rows(one)) == sorted(x for x in rows(docs) if known.predict(x[1])[2])

    two = spark.createDataFrame(stages["line_dedup"](spark, one, sf).collect(), docs.schema)
    assert sorted(rows(two)) == sorted((i, t) for i, t, n, k in deduped(rows(one)) if k < n)
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())

    three = spark.createDataFrame(stages["ngram_jaccard"](spark, two, sf).collect(), docs.schema)
    assert {i for i, _ in rows(three)} == {c for _, _, c, _ in components(rows(two))}

    four = spark.createDataFrame(stages["decontaminate"](spark, three, sf).collect(), docs.schema)
    assert {i for i, _ in rows(four)} == {i for i, _, hits, _ in contaminated(rows(three), items) if not hits}
    assert one.columns == two.columns == three.columns == four.columns == columns

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    five = {r["doc_id"]: r["n_tokens"] for r in stages["sentencepiece"](spark, four, sf).collect()}
    assert five == {i: len(library.encode(t, add_eos=True)) for i, t in rows(four)}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == set(five)


def test_odd_rows_through_every_stage(spark, sf, make_docs, odd_rows):
    for name, stage in corpus_pipeline.STAGES:
        for rows in (odd_rows, []):
            docs = make_docs(rows)
            out = stage(spark, docs, sf)
            assert out.count() <= len(rows)
            if name != "sentencepiece":
                assert out.columns == docs.columns

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from llm_data import prose

from quillspark.llm import queries, sentencepiece_codec
from quillspark.llm.sentencepiece_codec import PrefixTableCodec, read_vocabulary

PATH = queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return PrefixTableCodec(read_vocabulary(PATH))


def test_random_texts(library, codec):
    rng = random.Random(1)
    pieces = list(codec.id)
    texts = ["", " ", "  a", "a▁b ▁  c", "\x00\x01", "日本語テキスト🎉🎉 ok", " " * 40 + "x", " " * 33 + "\n \n  \t x", "<s></s><unk> <0x41>", "a" * 3000, "é̀ à  ", "...!!!---"]
    texts += ["".join(rng.choice("abcdet  \n\tthe▁éß日🎉0123.,<>=-_(){}") for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))).replace("▁", " ") for _ in range(1500)]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert codec.encode(text).tolist() == ids, text
        assert codec.decode(codec.encode(text)) == library.decode(ids), text


def test_decode_of_any_ids(library, codec):
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randrange(10))]
        ids = [i for i in ids if i > 2]
        assert codec.decode(np.array(ids, dtype=np.int32)) == library.decode(ids)


def test_query_against_the_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = queries.op4_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_odd_rows(make_docs, odd_rows, library):
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in sentencepiece_codec.encode_decode(make_docs(odd_rows), PATH).collect()), key=repr)
    assert got == sorted(((i, ids := library.encode(t or "", add_eos=True), library.decode(ids)) for i, t in odd_rows), key=repr)
    assert sentencepiece_codec.encode(make_docs([]), PATH).count() == 0


def test_encode_then_decode(make_docs):
    docs = make_docs([(1, prose(1, 20)), (2, None)])
    encoded = sentencepiece_codec.encode(docs, PATH)
    assert {r["doc_id"]: r["decoded"] for r in sentencepiece_codec.decode(encoded, PATH).collect()} == {1: prose(1, 20), 2: ""}


def test_a_worker_tells_vocabularies_of_one_size_apart():
    one = read_vocabulary(PATH)
    other = dict(one, scores=[-s for s in one["scores"]], digest="another")
    assert sentencepiece_codec._codec(one) is sentencepiece_codec._codec(one)
    assert sentencepiece_codec._codec(dict(one)).score != sentencepiece_codec._codec({k: v for k, v in other.items() if k not in ("standing", "pattern")}).score


def test_a_full_cache_starts_anew(library, codec, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CACHE_BYTES", 2000)
    monkeypatch.setattr(sentencepiece_codec, "PAIRS", 20)
    text = prose(3, 400)
    assert codec.encode(text).tolist() == library.encode(text, add_eos=True) and len(codec.cache) < 20


def test_workers_let_go_of_what_they_remember(spark):
    from pyspark.sql import functions as F

    def remembered(batches):
        import pyarrow as pa

        from quillspark.llm import sentencepiece_codec as module

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(c.cache) + len(c.pairs) for c in module._codecs.values())])], ["n"])

    docs = spark.range(200, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"))
    encoded = sentencepiece_codec.encode(docs, PATH)
    assert encoded.where("size(ids) > 0").count() == 200
    assert spark.range(8, numPartitions=4).mapInArrow(remembered, "n long").where("n > 0").count() == 0

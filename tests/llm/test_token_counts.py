import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import queries, token_counts
from quillspark.llm.token_counts import Counter, read_ranks

PATH = queries.tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


@pytest.fixture(scope="module")
def counter():
    return Counter(read_ranks(PATH), public_tokenizers.PATTERN)


def brute(library, text, sections, rule):
    """From the other library's character offsets; for whole characters only."""
    spans = library.encode(text, add_special_tokens=False).offsets
    counts, crossing = [0.0] * len(sections), 0
    for a, b in spans:
        held = [max(0, min(b, e) - max(a, s)) for s, e in sections]
        crossing += sum(held) < b - a and max(held, default=0) > 0 or sum(h > 0 for h in held) > 1
        if rule == "first":
            for k, (s, e) in enumerate(sections):
                counts[k] += s <= a < e
        elif rule == "split":
            for k, h in enumerate(held):
                counts[k] += h / (b - a)
    return len(spans), crossing, counts


@pytest.mark.parametrize("rule", ["first", "split"])
def test_against_another_library(library, counter, rule):
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["the ", "ing", "\n", "\n\n", "  ", ". ", "Hello", "12", "x"]) for _ in range(rng.randrange(40)))
        at = sorted(rng.randrange(len(text) + 1) for _ in range(2 * rng.randrange(1, 6)))
        sections = [s for s in zip(at[::2], at[1::2]) if s[0] < s[1]]
        n, crossing, counts, outside = counter.count(text, sections, rule)
        expected = brute(library, text, sections, rule)
        assert (n, crossing) == expected[:2] and all(abs(x - y) < 1e-9 for x, y in zip(counts, expected[2]))
        assert abs(sum(counts) + outside - n) < 1e-9


def test_largest_goes_to_the_earlier_of_equals(counter):
    assert counter.count("\n\n", [(0, 1), (1, 2)], "largest")[:3] == (1, 1, [1.0, 0.0])  # one token of two newlines
    assert counter.count("hello", [(0, 1), (1, 5)], "largest")[:3] == (1, 1, [0.0, 1.0])


def test_characters_of_many_bytes(library, counter):
    for text in ("日本語テキスト🎉🎉 ok é", "é" * 50):
        assert counter.count(text, [(0, len(text))], "first")[:3] == (len(library.encode(text).ids), 0, [float(len(library.encode(text).ids))])
    n, _, counts, outside = counter.count("🎉a", [(0, 1), (1, 2)], "first")
    assert sum(counts) == n and outside == 0


def test_odd_rows(make_docs, odd_rows, library):
    for sections in (token_counts.lines(F.col("text")), F.lit(None)):
        rows = token_counts.attribute(make_docs(odd_rows), PATH, public_tokenizers.PATTERN, sections).collect()
        assert sorted(r["n_tokens"] for r in rows) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in odd_rows)
        assert all(sum(r["counts"]) + r["outside"] == r["n_tokens"] for r in rows)
    assert token_counts.attribute(make_docs([]), PATH, public_tokenizers.PATTERN, F.lit(None)).count() == 0


def test_fields(make_docs):
    text, sections = token_counts.fields("text", "lang", "source")
    docs = make_docs([(1, "some words here"), (2, None)]).withColumns({"whole": text, "parts": sections})
    rows = {r["doc_id"]: r for r in token_counts.attribute(docs, PATH, public_tokenizers.PATTERN, F.col("parts"), text_col="whole").collect()}
    assert len(rows[1]["counts"]) == 3 and rows[1]["counts"][0] == 3 and rows[2]["counts"][0] == 0


def test_query(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op6_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        sections, at = [], 0
        for line in text.split("\n"):
            sections.append((at, at + len(line) + 1))
            at += len(line) + 1
        n, crossing, counts = brute(library, text, sections, "first")
        assert (r["n_tokens"], r["n_sections"]) == (n, len(sections)) and r["section_tokens"] == ",".join(str(int(x)) for x in counts)


def test_lines_of_a_very_long_text(spark):
    rows = [(1, "ab\n" * 80_000), (2, ""), (3, None), (4, "a\n\nb")]
    got = {r["id"]: [tuple(x) for x in r["s"]] for r in spark.createDataFrame(rows, "id int, text string").select("id", token_counts.lines(F.col("text")).alias("s")).collect()}
    assert got[1] == [(3 * k, 3 * k + 3) for k in range(80_000)] + [(240_000, 240_001)]
    assert got[2] == got[3] == [(0, 1)] and got[4] == [(0, 2), (2, 3), (3, 5)]

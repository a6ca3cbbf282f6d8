"""Collocations against a plain count of all phrases; small blocks, so that phrases are named over many of them."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quillspark.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for longer, b in candidates.items():
            for k in range(2, len(longer)):
                for i in range(len(longer) - k + 1):
                    if 100 * b >= share * candidates[longer[i : i + k]]:
                        gone.add(longer[i : i + k])
        kept = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, phrase.decode(), -a, l, r, n[lang], -score) for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def rows_of(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "the", "é", "日本", "a\x00b", "x", "big", "old"]
    fixed = ["in New York city hall", "big bad wolf", "a a a a a", "the end of the", "x"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", " \r\n", "\x0b", "!?", "; : "]
    rows = []
    for _ in range(n):
        text = "".join((rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words)) + rng.choice(ends) for _ in range(rng.randrange(40)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", None), (" \t.\n", "fr"), *rows[:3], (" ".join(["long word"] * 3000), "en")]


def frame(spark, rows, parts=3):
    schema = "text string, lang string, grp int, block string, id int, n int, f int, phrase int, rank int, word int"
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, 6, 7) for r in rows], schema).repartition(parts)


@pytest.mark.parametrize(("block_words", "parts", "longest", "least", "share", "top"), [(50, 3, 4, 5, 80, 2000), (1 << 19, 1, 4, 30, 80, 7), (300, 5, 3, 2, 50, 40), (7, 2, 5, 3, 100, 2000)])
def test_against_plain(spark, block_words, parts, longest, least, share, top):
    rows = rows_of(block_words, 120)
    got = collocations.mine(frame(spark, rows, parts), longest=longest, least=least, share=share, top=top, block_words=block_words)
    assert got.columns == ["grp", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, longest, least, share, top)
    assert want
    assert found(got) == want


def test_long_text_is_cut_between_pieces_only(spark, monkeypatch):
    text = " ".join(f"left{k % 3} right{k % 2}{'.' if k % 5 == 0 else ''}" for k in range(4000))
    whole = [w for part in collocations.split_words(text.encode()) for w in part]
    monkeypatch.setattr(collocations, "PART", 64)
    parts = list(collocations.split_words(text.encode()))
    assert len(parts) > 100
    assert [w for part in parts for w in part] == whole
    assert all(part[-1] == b"." for part in parts)


def test_many_languages_flush_the_largest(spark):
    rows = [(f"word{k} pair{k} " * 30, f"l{k}") for k in range(40)]
    assert found(collocations.mine(frame(spark, rows, 1), block_words=16)) == plain(rows, 4, 30, 80, 2000)


def test_nothing_frequent_and_empty_table(spark):
    assert found(collocations.mine(frame(spark, [("a b c", "en")]))) == []
    assert found(collocations.mine(frame(spark, []))) == []


def test_score_is_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, l, r = 9_000_000_000_000_001, 9_000_000_000_000_003, 9_100_000_000_000_007
    assert spark.range(1).select(collocations.score(F.lit(a), F.lit(l), F.lit(r)).alias("s")).first().s == 2_000_000 * a // (l + r)

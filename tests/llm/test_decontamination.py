import re

import pytest
from llm_data import prose

from quillspark.llm import decontamination

SEPARATORS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SEPARATORS.split(low) if w]


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for at in range(len(w) - size + 1):
                if (k := tuple(w[at : at + size])) in windows:
                    hit |= set(range(at, at + size))
                    found |= windows[k]
        out.append((i, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


def collected(df):
    return sorted(((r["doc_id"], r["n_words"], r["hits"], r["items"]) for r in df.collect()), key=repr)


ITEMS = [(1, prose(1, 40)), (2, prose(2, 12)), (3, "Alpha1, beta2"), (4, ""), (5, None), (6, "one two three four five six seven"), (10, prose(2, 12)), (2, prose(2, 12)), (7, "same " * 12), (None, prose(3, 14)), (None, prose(4, 11))]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, words int")


@pytest.fixture(scope="module")
def planted(odd_rows):
    w = prose(1, 40).split()
    return odd_rows + [
        (20, prose(7, 30) + " " + " ".join(w[5:15]) + ". " + prose(8, 30)), (21, " ".join(w[5:14])), (22, "x ALPHA1-beta2 y " * 3), (23, "one two three four five six seven"), (24, "one two three four five six"),
        (25, prose(2, 12) + " " + prose(2, 12)), (26, "same " * 30), (27, prose(1, 40) + " tail"), (28, "x " + prose(3, 14)), (29, prose(4, 11) + " " + prose(1, 40)),
    ]


def test_against_brute_force(make_docs, items, planted):
    assert collected(decontamination.decontaminate(make_docs(planted), items)) == brute(planted, ITEMS)


def test_beyond_the_broadcast_bound(make_docs, items, planted, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    assert collected(decontamination.decontaminate(make_docs(planted), items)) == brute(planted, ITEMS)


def test_other_spans(make_docs, items):
    """With a longer span short shared passages are let be."""
    w = prose(1, 40).split()
    docs = make_docs([(1, " ".join(w[0:12])), (2, " ".join(w[0:25]))])
    got = {r["doc_id"]: len(r["hits"]) for r in decontamination.decontaminate(docs, items.where("item_id = 1"), span=20).collect()}
    assert got == {1: 0, 2: 25}


def test_empty_tables(make_docs, items):
    assert decontamination.decontaminate(make_docs([]), items).count() == 0
    assert [r["hits"] for r in decontamination.decontaminate(make_docs([(1, "a b")]), items.limit(0)).collect()] == [[]]


def test_clean_keeps_all_columns(make_docs, items, planted):
    docs = make_docs(planted)
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted((repr(r["doc_id"]) for r in kept.collect())) == sorted(repr(i) for i, _, hit, _ in brute(planted, ITEMS) if not hit)


def test_a_text_of_200000_words_copied_whole(spark):
    """Every window of the document is an item's, so each has a fingerprint to be found among some tens of thousands."""
    import time

    text = prose(77, 200_000)
    docs = spark.createDataFrame([(1, text), (2, "before it " + text[: len(text) // 2] + " after"), (3, prose(78, 500))], "doc_id long, text string")
    items = spark.createDataFrame([("whole", text)], "item_id string, text string")
    began = time.time()
    got = {r.doc_id: (r.n_words, r.n, r.items) for r in decontamination.decontaminate(docs, items).selectExpr("doc_id", "n_words", "size(hits) as n", "items").collect()}
    copied = len(text[: len(text) // 2].split())
    assert got[1] == (200_000, 200_000, ["whole"])
    assert got[2][0] == copied + 3 and copied - 1 <= got[2][1] <= copied and got[2][2] == ["whole"]
    assert got[3] == (500, 0, [])
    assert time.time() - began < 120

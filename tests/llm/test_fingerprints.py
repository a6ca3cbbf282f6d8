import hashlib
import random
import re
from collections import Counter

from llm_data import prose
from pyspark.sql import functions as F

from quillspark.llm import fingerprints, queries


def test_query_against_brute_force(spark, sf):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in queries.op8_fingerprints(spark, sf).collect()}
    assert len(rows) == len(docs)
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 4
        changed = text[: len(text) - cut] + after[:cut]
        assert (rows[i]["n_chars"], rows[i]["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= rows[i]["near_next"] <= 1 and 0 <= rows[i]["in_place_edited"] <= rows[i]["near_edited"] <= 1
    by_text = {}
    for i, text in docs:
        assert by_text.setdefault(text, rows[i]["fingerprint"]) == rows[i]["fingerprint"]
    near = sorted(r["near_edited"] for r in rows.values())
    assert near[len(near) // 2] > 0.7 and sum(r["near_edited"] > r["near_next"] for r in rows.values()) > 0.93 * len(rows)


def said(fingerprint):
    """The anchors that the text of a fingerprint names."""
    return {(h, int(k or 0)) for h, k in re.findall(r"([0-9A-F]{8})(?:~(\d+)~)?", fingerprint)}


def test_near_is_the_likeness_of_the_fingerprints_returned(spark, sf, tmp_path):
    cycle = prose(21, 30) + " "
    texts = [(k, cycle * n) for k, n in enumerate([4, 2, 40, 10, 10])] + [(10, ""), (11, None), (12, " \n"), (13, "a b"), (14, "a b")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (sf, str(tmp_path)):
        rows = sorted(queries.op8_fingerprints(spark, folder).collect(), key=lambda r: r["doc_id"])
        dice = lambda a, b: 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))
        for k, r in enumerate(rows):
            after = rows[(k + 1) % len(rows)]
            own = said(r["fingerprint"])
            assert abs(r["near_edited"] - dice(own, said(r["edited_fingerprint"]))) < 1e-12
            assert abs(r["near_next"] - dice(own, said(after["fingerprint"]))) < 1e-12
            assert r["near_next"] == 1 or r["fingerprint"] != after["fingerprint"]


def ordered(rows):
    return sorted(((-(1 << 63) if i is None else i, t or "") for i, t in rows))


def test_odd_rows_and_their_order(make_docs, odd_rows):
    got = fingerprints.with_next(make_docs(odd_rows)).collect()
    expected = ordered(odd_rows)
    pairs = sorted((t, expected[(k + 1) % len(expected)][1]) for k, (_, t) in enumerate(expected))
    assert sorted((r["text"], r["next_text"]) for r in got) == pairs


def test_order_over_many_buckets(make_docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 3)
    rows = [(i * i * 37 % 1009, f"text {i}") for i in range(200)]
    got = {(r["id"], r["next_text"]) for r in fingerprints.with_next(make_docs(rows)).collect()}
    expected = ordered(rows)
    assert {(i, t) for i, t in got if i == expected[-1][0]} and all((i, expected[(k + 1) % len(expected)][1]) in got for k, (i, _) in enumerate(expected))


def test_one_row_and_none(make_docs):
    assert [r["next_text"] for r in fingerprints.with_next(make_docs([(1, "abc")])).collect()] == ["abc"]
    assert fingerprints.with_next(make_docs([])).count() == 0


def test_anchors_are_free_of_context(spark):
    """A passage has the same anchors wherever it stands, but for those that reach over its edges; and each is a closed syncmer."""
    passage = prose(5, 60)
    df = spark.createDataFrame([(1, passage), (2, prose(6, 33) + " " + passage + " " + prose(7, 21))], "id int, text string")
    a, b = (r["a"] for r in fingerprints.with_anchors(df, "text", "a").orderBy("id").collect())
    moved = {(x["at"] + 33, x["hash"]) for x in a}
    assert a and moved <= {(x["at"], x["hash"]) for x in b}
    assert 0.3 < len(b) / (33 + 60 + 21) < 0.7


def test_likeness(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 3]), ([], []), ([1], []), ([1, 2], [2, 3])], "a array<int>, b array<int>")
    got = [r["x"] for r in df.select(fingerprints.likeness("a", "b").alias("x")).collect()]
    assert got[:3] == [1.0, 1.0, 0.0] and abs(got[3] - 0.5) < 1e-9


def test_positional_matches(spark):
    df = spark.createDataFrame([(prose(1, 30), "start here " + prose(1, 30))], "a string, b string")
    df = fingerprints.with_anchors(fingerprints.with_anchors(df, "a", "x"), "b", "y")
    found = df.select(F.explode(fingerprints.positional_matches("x", "y")).alias("m")).select("m.*").collect()
    assert found and all(r["b_at"] - r["a_at"] == 2 for r in found)


def test_long_texts_are_compared_by_all_their_anchors(spark, tmp_path):
    """A short passage that two long texts share counts in near_next, and repeated anchors are matched one to one."""
    passage = prose(5, 60)
    texts = [(1, prose(11, 3000) + " " + passage + " " + prose(12, 1000)), (2, prose(13, 2000) + " " + passage + " " + prose(14, 900)), (3, "to and fro we go " * 50), (4, "to and fro we go " * 20)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_fingerprints(spark, str(tmp_path)).collect()}
    df = fingerprints.with_anchors(spark.createDataFrame(texts, "id long, text string"), "text", "a")
    anchors = {r["id"]: [x["hash"] for x in r["a"]] for r in df.collect()}
    assert len(anchors[1]) > 1500
    for i, nxt in ((1, 2), (2, 3), (3, 4), (4, 1)):
        a, b = Counter(anchors[i]), Counter(anchors[nxt])
        assert got[i]["fingerprint"] == "".join(f"{x & 0xFFFFFFFF:08X}" + (f"~{k}~" if k else "") for x in sorted(a) for k in range(a[x]))
        assert abs(got[i]["near_next"] - 2 * (a & b).total() / (a.total() + b.total())) < 1e-12
    assert got[1]["near_next"] > 0 and got[3]["near_next"] < 1


def test_numbered_anchors_match_as_placed_ones_do(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(80))) for _ in range(60)] + ["", "a", "to and fro we go " * 40]
    df = spark.createDataFrame([(a, rng.choice(texts)) for a in texts], "a string, b string")
    df = fingerprints.with_anchors(fingerprints.with_anchors(df, "a", "x"), "b", "y").withColumns({"p": fingerprints.placed("x"), "q": fingerprints.placed("y")})
    df = df.withColumns({"m": fingerprints.numbered("p"), "n": fingerprints.numbered("q"), "matches": fingerprints.place_matches(F.col("p"), F.col("q"))})
    for r in df.select("x", "m", F.size(F.array_intersect("m", "n")).alias("common"), F.size("matches").alias("matches")).collect():
        assert r["common"] == r["matches"]
        seen = Counter()
        expected = []
        for h in sorted(x["hash"] for x in r["x"]):
            expected.append((h, seen[h]))
            seen[h] += 1
        assert [(v >> 32, v & 0xFFFFFFFF) for v in r["m"]] == expected


def test_repeated_anchors_are_matched_in_order(spark):
    df = spark.createDataFrame([("to and fro we go " * 9, "to and fro we go " * 4), ("", "a b c d e f"), ("x y", "x y")], "a string, b string")
    df = fingerprints.with_anchors(fingerprints.with_anchors(df, "a", "x"), "b", "y")
    for r in df.select("x", "y", fingerprints.positional_matches("x", "y").alias("m")).collect():
        places = [{}, {}]
        for side, found in zip(places, (r["x"], r["y"]), strict=True):
            for p in found:
                side.setdefault(p["hash"], []).append(p["at"])
        expected = [(i, j, h) for h in places[0] for i, j in zip(places[0][h], places[1].get(h, []))]
        assert sorted(map(tuple, r["m"])) == sorted(expected)


def test_anchors_in_unspaced_runs_do_not_depend_on_the_run(spark):
    """A passage moved by one character inside an unspaced run keeps its anchors; so does all behind an inserted character."""
    rng = random.Random(8)
    runs = ["".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(300)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200)), "".join(chr(rng.randrange(0xE01, 0xE2F)) for _ in range(12)), "".join(chr(rng.randrange(0x20000, 0x20100)) for _ in range(90))]
    df = spark.createDataFrame([(k, run, "x" + run + "yz", run[:5] + "Q" + run[5:]) for k, run in enumerate(runs)], "id int, a string, b string, c string")
    for name in "abc":
        df = fingerprints.with_anchors(df, name, f"{name}_anchors")
    for r in df.orderBy("id").collect():
        a, b, c = ({(x["at"], x["hash"]) for x in r[f"{n}_anchors"]} for n in "abc")
        assert len(a) > (100 if r["id"] == 0 else 3) / 1.5
        assert {(i + 1, h) for i, h in a} <= b
        assert {(i + 1, h) for i, h in a if i >= 5} <= c
    words = spark.createDataFrame([("one two\tthree  internationally 日本語 x",)], "t string").select(fingerprints.tokens(F.col("t")).alias("t")).first()["t"]
    assert words == ["one", "two", "three", *"internationally", "日", "本", "語", "x"]

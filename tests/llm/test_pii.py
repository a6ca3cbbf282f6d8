import hashlib
import random
import re

import numpy as np
from llm_data import prose

from quillspark.llm import pii, queries

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text, re.A):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            fits = True
            if kind == 1:
                fits = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == 2:
                back = digits[::-1]
                fits = 16 <= len(digits) <= 19 and (sum(back[::2]) + sum(sum(map(int, str(2 * d))) for d in back[1::2])) % 10 == 0
            elif kind == 3:
                fits = 8 <= len(digits) <= 15
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_of_random_texts():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@.-1234567890 +()%_A\né") for _ in range(rng.randrange(60)))
        assert sorted(pii.base_spans(text)) == brute(text), text


def test_base_spans_in_reasonable_time():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "a.b-" * 50_000 + "@"):
        pii.base_spans(text)
        list(pii.candidates(text))


def test_odd_rows(make_docs, odd_rows):
    rows = odd_rows + [(30, "mail ana.b@example.com or call +1 (555) 123-4567, host 10.0.0.255"), (31, "write to joe [at] mail [dot] com"), (32, "card 4465758382889437 4465758382889437 or 999.1.1.1")]
    got = pii.detect(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, text in rows:
        if i is not None:
            assert [tuple(x) for x in by_id[i]["base"]] == brute(text or "")
            spans = [tuple(x) for x in by_id[i]["added"]]
            assert all(s < e <= len(text or "") for _, s, e in spans)
            assert not any(s < b and a < e for _, s, e in spans for _, a, b in brute(text or ""))
    assert pii.detect(make_docs([])).count() == 0


def test_estimation_finds_the_reliable_labelers():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.4
    right = (0.95, 0.9, 0.9, 0.6, 0.5, 0.85)
    votes = np.stack([np.where(rng.random(len(truth)) < 0.15, 2, np.where(rng.random(len(truth)) < p, truth, ~truth)) for p in right], axis=1).astype(int)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    personal, given, prior = pii.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.4) < 0.03
    assert ((personal[at.ravel()] > 0.5) == truth).mean() > 0.95
    found = given[:, 1, 1] / (given[:, 1, 1] + given[:, 1, 0])
    assert np.abs(found - right).max() < 0.05


def test_regression_learns_soft_labels():
    x = np.array([[1.0, 0.0], [0.0, 1.0]])
    w = pii.regression(x, np.array([0.9, 0.1]), np.array([100.0, 100.0]))
    p = 1 / (1 + np.exp(-(np.hstack([x, np.ones((2, 1))]) @ w)))
    assert p[0] > 0.8 and p[1] < 0.2


def test_feature_codes_are_bounded():
    assert len(pii.features_of(pii.FEATURE_CODES - 1)) == 20 and sum(pii.features_of(pii.FEATURE_CODES - 1)) == 7


def planted(seed, n):
    """Texts with personal data that the patterns miss, and the like that is none: text, spans, decoys."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    real = [
        lambda: f"{name()} [at] {name()} [dot] com".replace(" ", ""), lambda: f"{name()}.{name()}(at){name()}.org", lambda: f"{name()} at {name()} dot net",
        lambda: f"(2{digits(2)}) 5{digits(2)}-{digits(4)}", lambda: f"0{rng.choice('123')}{digits(2)} {digits(3)} {digits(4)}", lambda: f"{name()}@{name()}.io", lambda: f"+49 30 {digits(7)}",
    ]
    decoys = [lambda: f"version 1.0.{digits(1)}.{digits(2)}", lambda: f"ISBN 978{digits(10)}", lambda: f"order {digits(9)}x", lambda: f"meet at {name()}.{name()}", lambda: f"part-{digits(8)}-{digits(5)}"]
    rows = []
    for k in range(n):
        said = rng.choice(["call", "mail", "contact:", "telefon", "and", "so"])
        found, other = rng.choice(real)(), rng.choice(decoys)()
        text = f"{prose(k, 6)} {other} {prose(k + 1, 5)} {said} {found} {prose(k + 2, 4)}"
        rows.append((k, text, (text.index(found), text.index(found) + len(found)), (text.index(other), text.index(other) + len(other))))
    return rows


def test_recall_and_precision_on_planted_spans(make_docs):
    rows = planted(3, 900)
    found = pii.detect(make_docs([(k, t) for k, t, _, _ in rows])).collect()
    added = {r["doc_id"]: [(s["start"], s["end"]) for s in r["added"]] for r in found}
    got = {r["doc_id"]: added[r["doc_id"]] + [(s["start"], s["end"]) for s in r["base"]] for r in found}
    meets = lambda a, b: a[0] < b[1] and b[0] < a[1]
    caught = sum(any(meets(x, s) for x in got[k]) for k, _, s, _ in rows) / len(rows)
    wrong = sum(any(meets(x, d) for x in added[k]) for k, _, _, d in rows) / len(rows)
    assert caught >= 0.9 and wrong <= 0.1, (caught, wrong)


def test_long_candidates_and_many_of_them(make_docs):
    rows = [(1, "a" * 5000 + "@" + "b" * 3000 + ".com"), (2, "7" * 200_000), (3, "x [at] y.com " * 3000), (4, "1 2 3 4 5 6 7 8 9 " * 5000), (5, "@" * 100_000), (6, " at a" * 30_000)]
    got = {r["doc_id"]: (len(r["base"]), len(r["added"])) for r in pii.detect(make_docs(rows)).collect()}
    assert got[1][0] == 1 and len(got) == 6


def test_query_base_against_plain_loops(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    shown = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
    for r in queries.op5_pii(spark, sf).collect():
        base = sorted(brute(texts[r["doc_id"]]))
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, _, _ in base) for x in range(4)]
        assert r["base_sha256"] == hashlib.sha256(shown(base).encode()).hexdigest()
        spans = [x for x in r["spans"].split(",") if x]
        assert set(shown(base).split(",")) - {""} <= set(spans) and r["n_spans"] == len(spans)

import random
from itertools import combinations

import numpy as np
import pytest
from llm_data import edited, prose

from quillspark.llm import ngram_jaccard
from quillspark.llm.components import connected_components
from quillspark.llm.shingles import shingle_sets
from quillspark.llm.signature_tree import SignatureTree


def plain_set(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """n_shingles, component and number of links of each row, from all pairs."""
    ids = sorted({-(1 << 63) if i is None else i for i, _ in rows})
    sets = [(-(1 << 63) if i is None else i, plain_set(t)) for i, t in rows]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = [{(i, frozenset(a))} for i, a in sets]
    for (k, (i, a)), (m, (j, b)) in combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
            linked[k].add((j, frozenset(b)))
            linked[m].add((i, frozenset(a)))
    null = lambda x: None if x == -(1 << 63) else x
    return sorted(((null(i), len(s), null(root(i)), len(x) - 1) for (i, s), x in zip(sets, linked, strict=True)), key=repr)


def collected(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in df.collect()), key=repr)


def test_odd_rows(make_docs, odd_rows):
    assert collected(ngram_jaccard.components(make_docs(odd_rows))) == brute(odd_rows)


def test_empty_table(make_docs):
    assert ngram_jaccard.components(make_docs([])).count() == 0


def near_copies(groups, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    passage = prose(999, 30)
    for g in range(groups):
        base = prose(1000 + g, rng.choice([8, 40, 120]))
        for k in range(rng.choice([1, 2, 12])):
            text = base if k == 0 else edited(base, n, rng.choice([0, 1, 2, 3, 5]))
            rows.append((n, text + (" " + passage if rng.random() < 0.5 else "")))
            n += 1
    rng.shuffle(rows)
    return rows


def test_near_copies(make_docs):
    rows = near_copies(40, 1)
    assert collected(ngram_jaccard.components(make_docs(rows))) == brute(rows)


@pytest.mark.parametrize(("block", "chunk"), [(3, 4), (2, 300)])
def test_large_blocks_and_tiles(make_docs, monkeypatch, block, chunk):
    """With tiny limits every group is tied and tiled; nothing is lost."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    monkeypatch.setattr(ngram_jaccard, "CHUNK", chunk)
    rows = near_copies(25, 2)
    assert collected(ngram_jaccard.components(make_docs(rows))) == brute(rows)


def test_a_passage_in_every_document(make_docs, monkeypatch):
    """A frequent passage ties all documents; bands and tiles then find the links, whatever the bounds."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 5)
    monkeypatch.setattr(ngram_jaccard, "CHUNK", 8)
    monkeypatch.setattr(ngram_jaccard, "HASHED_BYTES", 2000)
    monkeypatch.setattr("quillspark.llm.common.BROADCAST_BYTES", 0)
    passage = prose(5, 90)
    rows = [(k, passage + " " + prose(1000 + k // 3, 2 + 7 * (k % 9)) + (f" w{k}" if k % 2 else "")) for k in range(120)]
    rows += [(500 + k, edited(passage, k, 1)) for k in range(60)] + [(None, passage), (None, prose(7, 30)), (3, prose(7, 30))]
    assert collected(ngram_jaccard.components(make_docs(rows))) == brute(rows)


def test_representatives_keep_all_columns(make_docs):
    rows = near_copies(10, 3)
    docs = make_docs(rows)
    kept = ngram_jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c, _ in brute(rows)}


def test_tree_finds_what_all_pairs_find():
    rng = random.Random(4)
    base = [np.unique(np.array([rng.randrange(1 << 63) for _ in range(n)], dtype=np.uint64)) for n in (1, 5, 60, 300, 900, 5000)]
    sets = []
    for x in base:
        for _ in range(25):
            keep = x[np.array([rng.random() > rng.choice([0, 0.05, 0.2, 0.5]) for _ in x])] if len(x) > 1 else x
            sets.append(keep)
    sets.append(np.zeros(0, dtype=np.uint64))

    def classes(links):
        parent = list(range(len(sets)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return [root(x) for x in range(len(sets))]

    exact = [(i, j) for i, j in combinations(range(len(sets)), 2) if len(sets[i]) and len(sets[j]) and 100 * (s := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - s)]
    links, counts = SignatureTree(sets, 75).joined()
    assert counts.tolist() == [sum(k in x for x in exact) for k in range(len(sets))]
    assert set(links) | {(b, a) for a, b in links} <= set(exact) | {(b, a) for a, b in exact}
    assert classes(links) == classes(exact)


def test_shingles_do_not_depend_on_neighbours():
    texts = ["a b c", "A B\tC", "a b c d e f", "", " ", "a b c d e f g"]
    alone = [shingle_sets([t.encode()])[0].tolist() for t in texts]
    assert [x.tolist() for x in shingle_sets([t.encode() for t in texts])] == alone
    assert alone[0] == alone[1] and len(alone[2]) == 2 and not alone[3] and not alone[4] and set(alone[2]) < set(alone[5])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in (200, 201, 202)}


def test_components_over_many_tasks(spark, monkeypatch):
    """Paths, stars and random graphs whose edges no task sees together; repeated edges, and nodes on both sides of zero."""
    monkeypatch.setattr("quillspark.llm.components.LOCAL_EDGES", 3)
    rng = random.Random(6)
    nodes = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(400)]
    edges = [(nodes[k], nodes[k + 1]) for k in range(90)] + [(nodes[100], nodes[k]) for k in range(101, 180)] + [(rng.choice(nodes[200:]), rng.choice(nodes[200:])) for _ in range(150)]
    edges = edges * 2
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b and root(a) != root(b):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(13)).collect()
    assert len(got) == len(parent) and {r["node"]: r["component"] for r in got} == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("parts", [1, 8, 32])
def test_links_of_texts_that_share_a_frequent_passage(spark, parts):
    """The passage is frequent in every slice, the texts are too short to have much else, and what links two of them is little more than it."""
    from pyspark.sql import functions as F

    passage = " ".join(f"w{k}" for k in range(10))
    rows = [(2 * i + j, f"{passage} a{i} {'bc'[j]}{i}") for i in range(200) for j in (0, 1)]
    rows += [(1000 + i, f"{' '.join(f'w{k}' for k in range(i % 6, i % 6 + 5))} {' '.join(f'u{i}x{k}' for k in range(12))}") for i in range(4200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, F.hash("doc_id"))
    got = {r.doc_id: r.component_id for r in ngram_jaccard.components(docs).collect()}
    assert {i: c for i, c in got.items() if i < 1000} == {2 * i + j: 2 * i for i in range(200) for j in (0, 1)}
    assert all(i == c for i, c in got.items() if i >= 1000)

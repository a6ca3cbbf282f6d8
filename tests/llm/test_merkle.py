"""The manifest against a plain one, with odd fanouts, few levels a round, nulls, repeated rows and an empty table."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(hashes, fanout):
    """The root, and for each leaf its siblings left and right by level."""
    now, at = list(hashes), list(range(len(hashes)))
    proofs = [[] for _ in now]
    while len(now) > 1:
        runs = [now[i : i + fanout] for i in range(0, len(now), fanout)]
        for k, i in enumerate(at):
            run, j = runs[i // fanout], i % fanout
            proofs[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            at[k] = i // fanout
        now = [H(*run) for run in runs]
    return now[0], proofs


def plain(rows, fanout):
    """rows (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof digest)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, H(*map(said, r)), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])], fanout) for g in order}
    root, above = tree([trees[g][0] for g in order], fanout)
    out = []
    for g, upper in zip(order, above, strict=True):
        subroot, proofs = trees[g]
        for (_, _, leaf, i), proof in zip(sorted(groups[g]), proofs, strict=True):
            out.append((i, leaf, subroot, root, H(*(a + b for a, b in proof + upper))))
    return out


def rows_of(n, langs=("en", None, "de", "é", "zz")):
    out = [(k * 37 % n, "web" if k % 3 else None, "en" if k % 3 else langs[k % len(langs)], k if k % 4 else None, None if k % 11 == 0 else f"text {k} é🎉") for k in range(n)]
    return [*out, out[-1], out[-1], (None, None, None, None, None), (None, "", "", 9223372036854775807, ""), (5, "s", "only", 1, "one leaf")]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, root int, idx string, grp int, n int, hash int, bucket int, id int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5, 6, 7) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("n", "fanout", "levels"), [(60, 2, 2), (40, 3, 1), (25, 2, 10), (1, 2, 3), (70, 7, 2)])
def test_against_plain(spark, n, fanout, levels):
    rows = rows_of(n)
    out = merkle.manifest(table(spark, rows), fanout=fanout, levels=levels)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "lefts", "rights"]
    got = out.withColumn("proof", merkle.proof_digest(F.col("lefts"), F.col("rights"))).withColumn("folded", merkle.fold(F.col("leaf"), F.col("lefts"), F.col("rights"))).collect()
    assert sorted(map(repr, [(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got])) == sorted(map(repr, plain(rows, fanout)))
    assert all(r.folded == r.root for r in got)


def test_tampered_rows_are_told(spark):
    rows = rows_of(80)
    out = merkle.manifest(table(spark, rows, 5), also={"tampered": merkle.tampered_leaf()}, levels=3)
    got = out.withColumn("folded", merkle.fold(F.coalesce("tampered", "leaf"), F.col("lefts"), F.col("rights"))).collect()
    source = defaultdict(list)
    for r in rows:
        source[H(*map(said, r))].append(r)
    for r in got:
        row = source[r.leaf][0]
        raised = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
        assert (r.folded == r.root) == (not raised or row[3] is None)
        if raised:
            assert r.tampered == H(*map(said, (*row[:3], None if row[3] is None else row[3] + 1, row[4])))
    assert any(r.folded != r.root for r in got)


def test_one_group_holds_most_and_one_leaf_is_its_own_root(spark):
    rows = [(k, "s", "en", 1, "t") for k in range(300)] + [(1, "s", "de", 1, "t")]
    got = merkle.manifest(table(spark, rows, 7), levels=4).collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root) for r in got) == sorted(x[:4] for x in plain(rows, 2))
    assert [r.subroot for r in got if r.leaf == H(*map(said, rows[-1]))] == [H(*map(said, rows[-1]))]


def test_empty_table_and_bad_parameters(spark):
    assert merkle.manifest(table(spark, [])).collect() == []
    with pytest.raises(ValueError, match="fanout"):
        merkle.manifest(table(spark, []), fanout=1)


def test_string_identifiers(spark):
    rows = spark.createDataFrame([("b", None), ("a", "x"), ("", "x")], "key string, part string")
    got = merkle.manifest(rows, ("key", "part"), "key", "part").collect()
    first = H(H(said("b"), said(None)), H(H(said(""), said("x")), H(said("a"), said("x"))))
    assert {r.root for r in got} == {first}
    assert {r.key for r in got} == {"a", "b", ""}

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import prose

from quillspark.llm import line_dedup
from quillspark.llm.line_dedup import CuckooFilter, LineIndex

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows):
    number = lambda i: -(1 << 63) if i is None else i
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(number(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == number(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def collected(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect()), key=repr)


def lines_of(n):
    return [(i, "\n".join(["Shared by everyone here", prose(i, 6), prose(i % 7, 6).upper() + " \t", "short", ""] * (1 + i % 2))) for i in range(n)]


def test_odd_rows(make_docs, odd_rows):
    assert collected(line_dedup.dedupe(make_docs(odd_rows))) == brute(odd_rows)


def test_hot_lines_over_many_parts(make_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    monkeypatch.setattr(line_dedup, "PART_LINES", 10)
    monkeypatch.setattr("quillspark.llm.common.BROADCAST_BYTES", 0)
    rows = lines_of(60) + [(200, "\n".join(f"line number {k}" for k in range(3000))), (201, "\n".join(f"Line number {k % 2000}" for k in range(4000)))]
    assert collected(line_dedup.dedupe(make_docs(rows))) == brute(rows)


def test_empty_table(make_docs):
    assert line_dedup.dedupe(make_docs([])).count() == 0


def state(index):
    """Lines and counts as they are; of the filters, which shared keys each knows."""
    rows = lambda df: sorted(map(tuple, df.collect()))
    shards = index.table("filters").count()
    filters = {r["shard"]: r["filter"] for r in index.table("filters").collect()}
    for r in index.shared().withColumn("shard", line_dedup.shard_of(shards)).toPandas().to_dict("records"):
        key = line_dedup.filter_keys(pd.DataFrame([r]))
        assert CuckooFilter.from_bytes(filters[r["shard"]]).contains(key).all()
    held = sum(int((CuckooFilter.from_bytes(f).table != 0).sum()) for f in filters.values() if f)
    assert held == index.shared().count()
    return rows(index.table("lines")), rows(index.table("counts").select("a", "b", "n_docs", "first", "last"))


@pytest.mark.parametrize("shard_keys", [4, 20_000])
def test_insertion_and_deletion_are_reversible(spark, make_docs, monkeypatch, tmp_path, shard_keys):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    rows = lines_of(40)
    index = LineIndex(spark, str(tmp_path / "index"))
    assert index.version == 0
    index.insert(make_docs(rows[:10]))
    one = state(index)
    index.insert(make_docs(rows[10:24] + [(None, rows[30][1])]))
    two = state(index)
    assert collected(line_dedup.dedupe(make_docs(rows[:24] + [(None, rows[30][1])]), index=index)) == brute(rows[:24] + [(None, rows[30][1])])
    index.insert(make_docs(rows[24:]))
    assert LineIndex(spark, index.path).version == 3
    index.delete(make_docs(rows[24:]))
    assert state(index) == two
    index.delete(make_docs(rows[10:24] + [(None, "")]))
    assert state(index) == one
    index.delete(make_docs([(99, "")]))
    assert state(index) == one
    assert collected(line_dedup.dedupe(make_docs(rows[:10]), index=index)) == brute(rows[:10])
    index.delete(make_docs(rows[:10]))
    assert state(index) == ([], [])


def test_a_full_filter_is_built_anew(spark, make_docs, tmp_path):
    index = LineIndex(spark, str(tmp_path / "index"))
    index.insert(make_docs([(1, "the first shared line"), (2, "the first shared line")]))
    many = "\n".join(f"line number {k}" for k in range(300))
    index.insert(make_docs([(3, many), (4, many)]))
    assert len(state(index)[1]) == 301 and index.shared().count() == 301


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
def test_filter_never_forgets(keys):
    keys = np.array(sorted(keys), dtype=np.uint64)
    made = CuckooFilter.from_bytes(CuckooFilter.of(keys).to_bytes())
    assert made.contains(keys).all()
    made.delete(keys[::2])
    assert made.contains(keys[1::2]).all()
    assert int((made.table != 0).sum()) == len(keys[1::2])


def test_filter_rarely_errs():
    rng = np.random.default_rng(1)
    keys, others = (rng.integers(0, 2**63, 50_000, dtype=np.uint64) for _ in range(2))
    assert CuckooFilter.of(np.unique(keys)).contains(others).mean() < 0.001

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from llm_data import prose  # noqa: E402

EXTRA = {"id": 1, "doc": 2, "words": "w", "n": 3, "ids": "x", "th": 4, "key": "k", "row": "r", "score": 0.5, "accepted": False, "grp": 1, "base": "b", "hits": "h", "hit": 1, "component": 9}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, doc int, words string, n int, ids string, th int, key string, row string, score double, accepted boolean, grp int, base string, hits string, hit int, component int"

@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table with further columns whose names clash with those that operators use."""

    def make(rows):
        filled = [(i, t, "en", "s", len(t or ""), *EXTRA.values()) for i, t in rows]
        return spark.createDataFrame(filled, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ties, a very long text, one of a single word, characters beyond ASCII."""
    long_text = "\n".join(prose(k, 12) for k in range(4000))
    return [(1, prose(1, 60)), (2, None), (3, ""), (4, " \n\t "), (5, "One."), (6, prose(1, 60)), (6, prose(1, 60)), (7, long_text), (None, prose(1, 60)), (None, None), (8, "É" * 40 + " 日本語 🎉🎉 ﬁ"), (9, "x" * 30000), (10, "ABC DEF ghi"), (11, "abc def GHI")]

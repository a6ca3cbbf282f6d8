"""The dealt queries that have SQL give what DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from quillspark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    cursor = con.execute(ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in columns]) for r in cursor.fetchall())

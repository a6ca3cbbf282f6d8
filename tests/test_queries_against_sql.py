"""Every query that has SQL gives what DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

LLM = Path(__file__).parent / "llm"
NAMES = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, name):
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns

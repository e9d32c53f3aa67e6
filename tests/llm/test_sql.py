"""The operators' queries with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from folioscope.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLE_SQL[name])
    columns, expected = [d[0] for d in found.description], found.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(expected, key=repr)

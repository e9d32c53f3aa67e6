"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from folioscope.plans.all import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted([tuple(plain(r[i]) for i in order) for r in values], key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE[name])
    columns, expected = [d[0] for d in found.description], found.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, expected)


LONG = "<p>" + "Words that go on. " * 900 + "</p>"


@pytest.mark.parametrize("name", ["f10_f11_page_states", "f60_page_dom"])
def test_long_pages_and_cut_references(spark, tmp_path, name):
    """Loud titles over pages of many characters, headings that end within a reference: as the SQL has them."""
    made = lambda title: f'<!DOCTYPE html>\n<html lang="en"><head><title>{title}</title></head>\n<body><h1>{title}</h1><article>{LONG}<a href="/">x</a></article></body></html>\n'
    html = [made(t) for t in ("LOUD AND LONG", "Plain", "Cut at the&amp;&amp", "Both &quot;x&amp;y&quot", "A wall.")]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").selectExpr("page_id", "concat('https://a.org/', page_id) AS url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    found = con.execute(ORACLE[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in found.description], found.fetchall())

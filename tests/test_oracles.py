"""Every core query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from siltgauge.plans import catalogue, oracles

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    return float(x) if hasattr(x, "to_integral_value") else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", catalogue.NAMES)
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = duck.execute(oracles.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert got == sorted(str([plain(r[names.index(c)]) for c in cols]) for r in rel.fetchall())

"""Every registered query of the library against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

from paperloom.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool | int):
        return repr(int(value))
    return repr(round(value + 0.0, 5)) if isinstance(value, float) else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLES:
        assert got
        return
    duck.execute(registry.ORACLES[name])
    expected = rows_of([d[0] for d in duck.description], duck.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in duck.description)
    assert got == expected

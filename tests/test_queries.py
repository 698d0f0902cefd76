"""Every registered query of the library against its SQL twin on the smallest tables."""

from __future__ import annotations

import os

import pytest

from wayfold.plans import registry

SMOKE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, SMOKE)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(r)) for r in frame.select(*columns).collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    wanted = duck.sql(registry.ORACLE_SQL[name])
    assert columns == sorted(wanted.columns)
    assert got == sorted(repr(r) for r in wanted.project(", ".join(f'"{c}"' for c in columns)).fetchall())

"""Every query that has SQL gives the rows of its SQL at the smallest scale."""

import os

import duckdb
import pytest

from keelson.plans import registry

WHERE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    if not os.path.isdir(WHERE):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{WHERE}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, engine, name):
    frame = registry.QUERIES[name](spark, WHERE)
    got = frame.toArrow().to_pylist()
    if name not in registry.ORACLES:
        assert got
        return
    want = engine.sql(registry.ORACLES[name]).to_arrow_table().to_pylist()
    rows = lambda found: sorted((tuple(plain(r[c]) for c in sorted(frame.columns)) for r in found), key=repr)
    assert rows(got) == rows(want)

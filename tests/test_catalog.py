"""Every query with SQL gives the same rows in both engines; the others run."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    ours = sorted(tuple(map(value, r)) for r in got.select(*columns).collect())
    if name in SQL:
        found = db.execute(SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert ours == sorted(tuple(value(r[i]) for i in at) for r in found.fetchall())


def test_names_and_entry(spark):
    assert set(SQL) <= set(QUERIES)
    assert __spark_entry__.entry(spark).count() > 0

"""Each registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quern.plans import queries as plans
from quern.plans import reports  # noqa: F401  registers its queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 8) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in plans.SQL:
        want = con.sql(plans.SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        order = [want.columns.index(c) for c in df.columns]
        assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

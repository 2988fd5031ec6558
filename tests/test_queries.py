"""Every query of the plans at the smallest scale, against its SQL."""

import os

import duckdb
import pytest

from ontoloom.plans import ALL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def cell(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("plans,name", [(p, k) for p in ALL for k in p.queries])
def test_query(spark, duck, plans, name):
    df = plans.queries[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*columns).collect())
    if name in plans.sql:
        found = duck.execute(plans.sql[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(tuple(cell(r[k]) for k in at) for r in found.fetchall())

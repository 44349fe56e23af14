"""Every query of the engine gives what its SQL gives on the smallest tables."""

import duckdb
import pytest

from roadweave.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


SQL = catalogue.ORACLE_SQL | catalogue.SLOW_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = sorted(repr(tuple(r)) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    out = con.execute(SQL[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in out.fetchall())

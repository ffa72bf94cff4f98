"""Every query with SQL gives the same rows in DuckDB, on the smallest tables."""

import os

import pytest

from photonloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[columns].astype(str).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_sql_belongs_to_queries():
    assert set(queries.ORACLE) <= set(queries.QUERIES)

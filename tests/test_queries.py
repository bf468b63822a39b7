"""Every core query against its SQL in DuckDB at the smallest scale."""

import duckdb
import pytest

from weftline import queries

D = "/root/testdata/sf0.001"


def rows(cols, found):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(([r[i] for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "events", "documents"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, D)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)

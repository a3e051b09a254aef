"""Each query of the nested engine equals its SQL."""

import os

import duckdb
import pytest

from arborframe import queries

DIR = "/root/testdata/sf0.001"


def rows(names, values):
    return sorted((tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for _, v in sorted(zip(names, r))) for r in values))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    df = queries.QUERIES[name](spark, DIR)
    want = con.execute(queries.SQL[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in want.description], want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_pointer_chain(spark, monkeypatch):
    read = []
    chase = queries.links.chase
    monkeypatch.setattr(queries.links, "chase", lambda spark, nodes, *a: read.append(nodes) or chase(spark, nodes, *a))
    df = queries.QUERIES["pointer_chain"](spark, DIR)
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{DIR}/orders.parquet'")
    want = con.execute(queries.SQL["pointer_chain"])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in want.description], want.fetchall())
    assert read[0].count() == spark.read.parquet(f"{DIR}/orders.parquet").count()

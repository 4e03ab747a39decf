"""Queries that SQL can express, against that SQL."""

import os

import duckdb
import pytest

from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(ORACLES[name])
    names = sorted(d[0] for d in rel.description)
    at = [[d[0] for d in rel.description].index(n) for n in names]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted(repr([r[n] for n in names]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in rel.fetchall())

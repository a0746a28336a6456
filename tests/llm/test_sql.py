"""Queries that SQL can express, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from fleetlens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    result = con.sql(queries.ORACLE[name])
    columns = sorted(result.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, result.project(", ".join(columns)).fetchall()))

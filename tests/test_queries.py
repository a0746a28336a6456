"""Every query of the library that has SQL, against DuckDB on the same files; the others give rows and agree with themselves."""

from __future__ import annotations

import math

import duckdb
import pytest

from fleetlens import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    result = duck.sql(registry.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(result.columns)
    assert plain(got.select(*columns).collect()) == plain(result.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_without_sql(spark, name):
    first = plain(registry.QUERIES[name](spark, SF).collect())
    assert first and first == plain(registry.QUERIES[name](spark, SF).collect())


def test_numbers_above_six_digits_are_cut_as_in_the_sql(spark, duck, tmp_path):
    own = f"{tmp_path}/orders.parquet"
    duck.sql(f"copy (select range as o_orderkey, '1-URGENT' as o_orderpriority from range(1000012)) to '{own}'")
    got = registry.QUERIES["generated_catalog"](spark, str(tmp_path)).where("task_id >= 999990 or task_id < 3")
    with duckdb.connect() as con:
        con.sql(f"create view orders as select * from '{own}'")
        want = con.sql(f"select * from ({registry.ORACLE['generated_catalog']}) where task_id >= 999990 or task_id < 3").fetchall()
    assert plain(got.select("task_id", "vehicle_name").collect()) == plain(want)

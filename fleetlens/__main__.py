"""python -m fleetlens list | sql NAME | run NAME TABLES OUT: what there is, a query's SQL, or a query's rows as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from fleetlens import registry


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fleetlens", description="Queries over the tables of a folder.")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="all queries, and which have SQL")
    one = sub.add_parser("sql", help="the SQL of a query")
    one.add_argument("name", choices=sorted(registry.ORACLE))
    run = sub.add_parser("run", help="write a query's rows as Parquet")
    run.add_argument("name", choices=sorted(registry.QUERIES))
    run.add_argument("tables", help="the folder of the tables")
    run.add_argument("out", help="a folder that isn't there yet")
    return p


def main(argv: list[str] | None = None) -> None:
    asked = parser().parse_args(argv)
    if asked.command == "list":
        print("\n".join(f"{name}{'  (SQL)' if name in registry.ORACLE else ''}" for name in sorted(registry.QUERIES)))
    elif asked.command == "sql":
        print(registry.ORACLE[asked.name])
    else:
        spark = SparkSession.builder.appName("fleetlens").getOrCreate()
        registry.QUERIES[asked.name](spark, asked.tables.rstrip("/")).write.parquet(asked.out)


if __name__ == "__main__":
    main()

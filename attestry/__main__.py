"""python -m attestry: list the queries, run one over a folder of tables, or show its plan or its SQL."""

from __future__ import annotations

import argparse

from attestry.plans import archive, checks, exchange, records  # noqa: F401  adds its queries to the catalogue
from attestry.plans.catalog import ORACLES, QUERIES


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="attestry", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    sql = commands.add_parser("sql", help="the SQL that a query's rows equal")
    sql.add_argument("query", choices=sorted(ORACLES))
    for name, text in (("run", "rows of a query"), ("explain", "plan of a query")):
        c = commands.add_parser(name, help=text)
        c.add_argument("query", choices=sorted(QUERIES))
        c.add_argument("data", help="folder of the tables")
    run = commands.choices["run"]
    run.add_argument("--out", help="folder for the rows; without it the first ones are shown")
    run.add_argument("--format", choices=["parquet", "json", "csv"], default="parquet")
    run.add_argument("--overwrite", action="store_true", help="replace what is in the folder")
    return p


def main(given: list[str] | None = None) -> int:
    a = parser().parse_args(given)
    if a.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if a.command == "sql":
        print(ORACLES[a.query].strip())
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"attestry {a.query}").getOrCreate()
    df = QUERIES[a.query](spark, a.data)
    if a.command == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.mode("overwrite" if a.overwrite else "errorifexists").format(a.format).save(a.out)
    else:
        df.show(20, truncate=60)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

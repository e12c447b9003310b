"""Command line: ``python -m tideline list`` and ``python -m tideline run NAME --tables DIR --out PATH``."""

from __future__ import annotations

import argparse
import sys

from .plans.queries import ORACLE_SQL, QUERIES
from .sources.panels import write_table


def main(words: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tideline")
    commands = parser.add_subparsers(dest="command", required=True)
    listing = commands.add_parser("list", help="names of the queries")
    listing.add_argument("--sql", action="store_true", help="only those that SQL can express, with it")
    run = commands.add_parser("run", help="write a query's result")
    run.add_argument("name", choices=sorted(QUERIES))
    run.add_argument("--tables", required=True, help="folder of the parquet tables")
    run.add_argument("--out", required=True)
    run.add_argument("--layout", choices=["parquet", "csv"], default="parquet")
    asked = parser.parse_args(words)
    if asked.command == "list":
        for name in sorted(ORACLE_SQL if asked.sql else QUERIES):
            print(f"-- {name}\n{ORACLE_SQL[name]}\n" if asked.sql else name)
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"tideline {asked.name}").getOrCreate()  # master and settings are those of spark-submit
    write_table(QUERIES[asked.name](spark, asked.tables), asked.out, asked.layout)
    return 0


if __name__ == "__main__":
    sys.exit(main())

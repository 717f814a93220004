"""``python -m gradeflow QUERY --tables FOLDER [--out FOLDER]``: run a registered query; without a name, list them."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import registry
from .sources import records


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gradeflow", description=__doc__)
    parser.add_argument("query", nargs="?", help="name of a query")
    parser.add_argument("--tables", help="folder of the Parquet tables")
    parser.add_argument("--out", help="folder for the result as Parquet, which must not exist; else the first rows are printed")
    parser.add_argument("--rows", type=int, default=20, help="rows to print")
    given = parser.parse_args(arguments)
    found = registry.queries()
    if not given.query:
        print("\n".join(sorted(found)))
        return
    if given.query not in found:
        parser.error(f"unknown query {given.query}")
    if not given.tables:
        parser.error("--tables is needed")
    spark = SparkSession.builder.appName(f"gradeflow {given.query}").getOrCreate()
    rows = found[given.query](spark, given.tables)
    if given.out:
        rows.write.mode("errorifexists").parquet(given.out)
    else:
        print(records.markdown(rows.limit(given.rows)))


if __name__ == "__main__":
    main()

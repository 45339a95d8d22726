"""python -m sparkloom: lists queries, runs one over a folder of tables, or runs the catalogue's stages."""

from __future__ import annotations

import argparse
from collections.abc import Callable


def main(args: list[str] | None = None, queries: dict[str, Callable] | None = None) -> int:
    """queries: those of the core by default."""
    from sparkloom.plans import registry

    queries = registry.queries() if queries is None else queries
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    for name, text in (("query", "one query's result as a Parquet table"), ("stages", "the catalogue's stages, each as a Parquet table")):
        c = sub.add_parser(name, help=text)
        if name == "query":
            c.add_argument("name")
        c.add_argument("--tables", required=True, help="folder of the input tables")
        c.add_argument("--out", required=True, help="folder of the result; an old one is replaced")
    a = p.parse_args(args)
    if a.command == "list":
        print("\n".join(queries))
        return 0
    if a.command == "query" and a.name not in queries:
        p.error(f"there is no query {a.name}; see list")
    from pyspark.sql import SparkSession

    from sparkloom import pipeline
    from sparkloom.shared import ship
    from sparkloom.sources.writers import write_table

    spark = SparkSession.builder.appName(f"sparkloom {a.command}").getOrCreate()
    ship(spark)
    if a.command == "query":
        write_table(queries[a.name](spark, a.tables.rstrip("/")), a.out)
    else:
        pipeline.run(spark, pipeline.CATALOGUE, a.tables.rstrip("/"), a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

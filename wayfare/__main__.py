"""Command line: list the queries, run one or a family into Parquet, or say the SQL of one.

    python -m wayfare list [PREFIX]
    python -m wayfare run NAME_OR_PREFIX --data DIR --out DIR [--master local[8]]
    python -m wayfare sql NAME

A name ending in `*` is a prefix. Output folders are new; nothing is replaced. On a cluster submit the package with
spark-submit and set spark.checkpoint.dir to a folder that the executors share.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from wayfare import registry


def chosen(name: str, known: dict) -> list[str]:
    """The queries of a name or, with a star at its end, of a prefix. An unknown one is an error."""
    found = [k for k in known if k.startswith(name[:-1])] if name.endswith("*") else [name] * (name in known)
    if not found:
        raise SystemExit(f"no query {name!r}")
    return found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wayfare", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parts = parser.add_subparsers(dest="command", required=True)
    parts.add_parser("list").add_argument("prefix", nargs="?", default="")
    run = parts.add_parser("run")
    run.add_argument("name")
    run.add_argument("--data", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--master")
    parts.add_parser("sql").add_argument("name")
    args = parser.parse_args(argv)
    if args.command == "list":
        known = registry.queries()
        for name in sorted(k for k in known if k.startswith(args.prefix)):
            print(name)
        return 0
    if args.command == "sql":
        sql = registry.oracles()
        for name in chosen(args.name, sql):
            print(sql[name])
        return 0
    builder = SparkSession.builder.appName("wayfare").config("spark.sql.session.timeZone", "UTC")
    if args.master:
        builder = builder.master(args.master)
    spark, known = builder.getOrCreate(), registry.queries()
    for name in chosen(args.name, known):
        known[name](spark, args.data).write.mode("errorifexists").parquet(f"{args.out.rstrip('/')}/{name}")
        print(f"{name}: written", file=sys.stderr)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

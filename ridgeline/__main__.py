"""python -m ridgeline list | run NAME SF_DIR [--out PATH] [--explain]: the catalogue's queries from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ridgeline import catalog


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ridgeline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run one query over a folder of tables")
    run.add_argument("name", choices=sorted(catalog.QUERIES))
    run.add_argument("sf_dir")
    run.add_argument("--out", help="write Parquet there instead of showing rows")
    run.add_argument("--explain", action="store_true")
    given = parser.parse_args(arguments)
    if given.command == "list":
        print(*sorted(catalog.QUERIES), sep="\n")
        return 0
    spark = SparkSession.builder.appName("ridgeline").getOrCreate()
    df = catalog.QUERIES[given.name](spark, given.sf_dir)
    if given.explain:
        df.explain("formatted")
    elif given.out:
        df.write.mode("overwrite").parquet(given.out)
    else:
        df.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Run registered queries: python -m quarry SF_DIR QUERY... [--trials N] [--master M] [--log FILE]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quarry import harness, registry


def main() -> None:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    parser.add_argument("sf_dir")
    parser.add_argument("query", nargs="*", help="names; none lists them")
    parser.add_argument("--trials", type=int, default=3)
    parser.add_argument("--master", default="local[*]")
    parser.add_argument("--log", help="append records as JSON lines")
    args = parser.parse_args()
    found = registry.queries()
    if not args.query:
        print("\n".join(sorted(found)))
        return
    spark = SparkSession.builder.master(args.master).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in args.query:
        runs = harness.run(name, lambda q=found[name]: q(spark, args.sf_dir).count(), trials=args.trials)
        for r in runs:
            print(harness.line(r))
        if args.log:
            harness.write(runs, args.log)


if __name__ == "__main__":
    main()

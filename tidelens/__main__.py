"""``python -m tidelens QUERY TABLES [--rows N] [--out PATH]``: run a named query and show its rows or write them as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> int:
    from tidelens.plans import feeds, queries, reports
    from tidelens.streaming import queries as streams

    named = queries.QUERIES | feeds.QUERIES | reports.QUERIES | streams.QUERIES
    p = argparse.ArgumentParser(prog="tidelens", description=__doc__)
    p.add_argument("query", choices=sorted(named))
    p.add_argument("tables", help="folder of the tables")
    p.add_argument("--rows", type=int, default=20)
    p.add_argument("--out")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tidelens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = named[a.query](spark, a.tables)
    df.write.mode("overwrite").parquet(a.out) if a.out else df.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Commands: list the queries, run one over a folder of tables, or build a graph from its stages.

    python -m sparkloom list
    python -m sparkloom run f1_near_miss TABLES OUT
    python -m sparkloom findings TABLES OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from sparkloom.plans import queries
from sparkloom.schema import Graph


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkloom")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="one query, written as parquet")
    run.add_argument("query", choices=sorted(queries.queries()))
    found = commands.add_parser("findings", help="all findings, written as parquet by type")
    for p in (run, found):
        p.add_argument("tables")
        p.add_argument("out")
    asked = parser.parse_args(arguments)
    if asked.command == "list":
        print("\n".join(sorted(queries.queries())))
        return 0
    spark = spark or SparkSession.builder.appName("sparkloom").getOrCreate()
    if asked.command == "run":
        queries.queries()[asked.query](spark, asked.tables).write.mode("overwrite").parquet(asked.out)
    else:
        queries.all_findings(Graph.read(spark, asked.tables).written()).write.mode("overwrite").partitionBy("type").parquet(asked.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

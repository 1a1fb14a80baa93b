"""Command line: python -m tributary list | run QUERY [--data DIR] [--out DIR] | validate MATCHES --required TABLE [--known TABLE] [--candidates FILE]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import Settings
from .operators import evaluate
from .plans.catalogue import QUERIES


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    settings = Settings.from_environment()
    parser = argparse.ArgumentParser(prog="tributary", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run a query and write its rows as Parquet")
    run.add_argument("query", choices=sorted(QUERIES), metavar="QUERY")
    run.add_argument("--data", default=settings.data)
    run.add_argument("--out", default=settings.output)
    check = commands.add_parser("validate", help="check an answer; exit code 1 if it is wrong")
    check.add_argument("matches")
    check.add_argument("--required", required=True, help="Parquet table with s1_id")
    check.add_argument("--known", help="Parquet table with cand_id")
    check.add_argument("--candidates")
    a = parser.parse_args(arguments)
    if a.command == "list":
        print(*sorted(QUERIES), sep="\n")
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    if settings.partitions:
        spark.conf.set("spark.sql.shuffle.partitions", settings.partitions)
    if a.command == "run":
        QUERIES[a.query](spark, a.data).write.mode("overwrite").parquet(f"{a.out}/{a.query}")
        return 0
    known = spark.read.parquet(a.known) if a.known else None
    found = evaluate.validate_answer(spark, a.matches, spark.read.parquet(a.required), known, a.candidates)
    for r in found.where("n > 0").orderBy("severity", "file", "rule").collect():  # a row for each rule at most
        print(f"{r.severity}: {r.file}: {r.rule}: {r.n} ({r.example})")
    return evaluate.exit_code(found)


if __name__ == "__main__":
    sys.exit(main())

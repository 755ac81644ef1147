"""python -m folioscope PATH [--records PARQUET] [--json FOLDER] [--list-rules]: exit 1 if an error is live, 2 on misuse."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import load_settings
from .operators import catalog, rules
from .plans import render
from .plans.audit import audit
from .sources import bibtex

RECORDS = "file_id string, entry_seq int, source string, ord int, title string, authors array<string>, year string, volume string, number string, pages string, journal string, doi string"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioscope")
    parser.add_argument("path", nargs="?")
    parser.add_argument("--records", help="Parquet table of registry records")
    parser.add_argument("--json", help="folder for findings, entries and summary")
    parser.add_argument("--config", default="folioscope.json")
    parser.add_argument("--list-rules", action="store_true")
    args = parser.parse_args(argv)
    if args.list_rules:
        print(*sorted(rules.RULES), sep="\n")
        print(*[f"{c}\t{g}\t{p or '-'}" for c, g, p in catalog.categories()], sep="\n")
        return 0
    if not args.path:
        parser.error("a path is needed")
    spark = SparkSession.builder.appName("folioscope").getOrCreate()
    entries = bibtex.entries(bibtex.parse_files(bibtex.read_files(spark, args.path)))
    if entries.isEmpty():
        print("no entries found", file=sys.stderr)
        return 2
    records = spark.read.parquet(args.records) if args.records else spark.createDataFrame([], RECORDS)
    result = audit(entries, records, load_settings([args.config]))
    if args.json:
        render.as_json(result, args.json)
    for line in render.lines(result):
        print(line)
    return int(not result.findings.filter("severity = 'error' and suppressed_by is null").isEmpty())


if __name__ == "__main__":
    sys.exit(main())

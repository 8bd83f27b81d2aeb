"""Command line: scan, report, json and explain over a source tree."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans.scan import Options, explain, scan
from .reports import FORMATS, render
from .sources.files import LANGUAGES
from .thresholds import PROFILES


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siltgauge", description="How costly a source tree is for language models to read.")
    sub = out.add_subparsers(dest="command", required=True)
    for name, form in (("scan", "text"), ("report", "markdown"), ("json", "json"), ("explain", "json")):
        p = sub.add_parser(name)
        p.add_argument("path")
        if name == "explain":
            p.add_argument("file", help="path below the tree's root")
        else:
            p.add_argument("--format", choices=sorted(FORMATS), default=form)
        p.add_argument("--threshold", choices=sorted(PROFILES), default="normal")
        p.add_argument("--include-tests", action="store_true")
        p.add_argument("--lang", action="append", choices=sorted(LANGUAGES), default=[])
        p.add_argument("--ignore", action="append", default=[], help="regular expression over relative paths")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("siltgauge").getOrCreate()
    options = Options(args.threshold, args.include_tests, tuple(args.lang), tuple(args.ignore))
    if args.command == "explain":
        found = explain(spark, args.path, args.file, options)
        if found is None:
            print(f"no such file: {args.file}", file=sys.stderr)
            return 1
        print(json.dumps(found, indent=2, default=str))
        return 0
    sys.stdout.write(render(scan(spark, args.path, options), args.format))
    return 0

"""python -m treewright compare BEFORE AFTER | tree FOLDER: reports over folders of graph tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import compare
from .schema import MAX_DEPTH


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="treewright")
    commands = top.add_subparsers(dest="command", required=True)
    for name, folders in (("compare", ("before", "after")), ("tree", ("folder",))):
        one = commands.add_parser(name)
        for folder in folders:
            one.add_argument(folder)
        one.add_argument("--entry", action="append", help="a function to start from; all roots by default")
        one.add_argument("--max-depth", type=int, default=MAX_DEPTH)
        one.add_argument("--language", default="rust")
        one.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("treewright").getOrCreate()
    ansi = args.color == "always" or args.color == "auto" and sys.stdout.isatty()
    more = {"entries": args.entry, "max_depth": args.max_depth, "ansi": ansi}
    if args.command == "compare":
        sides = [compare.load_graph(spark, f) for f in (args.before, args.after)]
        sys.stdout.write(compare.report(args.language, (args.before, args.after), *sides, **more))
    else:
        sys.stdout.write(compare.tree_report(args.language, args.folder, compare.load_graph(spark, args.folder), **more))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

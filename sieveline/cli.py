"""index and search commands.

python -m sieveline.cli index DIR -o OUT [--shard-size N] [--include GLOB ...] [--exclude GLOB ...]
python -m sieveline.cli search INDEX ... PATTERN [-f GLOB] [-c N] [-i] [-r]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import index as ix, postings as px, results
from .plans.query import Query, SearchOptions
from .sources import corpus as source


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sieveline")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("directory")
    i.add_argument("-o", "--output", required=True)
    i.add_argument("--shard-size", type=int, default=source.BuilderOptions().shard_max)
    i.add_argument("--include", action="append", default=[])
    i.add_argument("--exclude", action="append", default=[])
    s = sub.add_parser("search")
    s.add_argument("index", nargs="+")
    s.add_argument("pattern")
    s.add_argument("-f", "--file")
    s.add_argument("-c", "--context", type=int, default=0)
    s.add_argument("-i", "--ignore-case", action="store_true")
    s.add_argument("-r", "--regex", action="store_true")
    return p


def run(spark: SparkSession, args: argparse.Namespace, out=sys.stdout) -> None:
    if args.command == "index":
        corpus = source.from_directory(spark, args.directory, args.include, args.exclude)
        for r in ix.IndexBuilder(source.BuilderOptions(shard_max=args.shard_size)).build(corpus, args.output).orderBy("skip_reason").collect():
            print(f"{r['skip_reason']}: {r['files']} files, {r['bytes']} bytes", file=out)
        return
    query = Query(args.pattern, args.regex, SearchOptions(not args.ignore_case, 0, args.context, args.file))
    corpus = px.narrowed(ix.Index(spark, args.index), query)
    if args.context:
        rows = results.context_lines(corpus, query).orderBy("file_idx", "line", "part")
    else:
        rows = results.match_lines(corpus, query).orderBy("file_idx", "byte_offset")
    for r in rows.select(F.col("rendered")).toLocalIterator():
        print(r[0], file=out)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sieveline").getOrCreate()
    try:
        run(spark, args)
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

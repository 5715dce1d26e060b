"""Command line: stats, preview, convert and validate taxonomies in JSON or OWL."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from taxograft.operators.closure import root_paths
from taxograft.operators.space import preview_rows
from taxograft.session import build_session
from taxograft.sources.taxonomies import load, to_json


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="taxograft", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, text in (("stats", "count nodes, edges, roots and leaves"), ("preview", "list the tree"), ("convert", "write as JSON"), ("validate", "report cycles, missing labels and orphans")):
        one = sub.add_parser(name, help=text)
        one.add_argument("path")
        if name == "convert":
            one.add_argument("target")
        if name == "preview":
            one.add_argument("--depth", type=int, default=3)
    args = parser.parse_args(argv)
    spark = build_session(None if argv is None else "local[2]")
    taxonomy = load(spark, args.path)
    if args.command == "stats":
        row = taxonomy.stats().first()
        print(", ".join(f"{n[2:]}: {row[n]}" for n in row.asDict()))
    elif args.command == "preview":
        rows = preview_rows(root_paths(taxonomy.nodes, taxonomy.edges, args.depth), taxonomy.nodes)
        for r in rows.orderBy("sort_key").toLocalIterator():
            print("  " * r["depth"] + f"{r['label']} ({r['id']})")
    elif args.command == "convert":
        if not args.target.endswith(".json"):
            print("only .json can be written", file=sys.stderr)
            return 1
        to_json(taxonomy, args.target)
    else:
        found = taxonomy.validate().orderBy("severity", "finding", "id").collect() if taxonomy.validate().limit(1).count() else []
        for r in found:
            print(f"{r['severity'].upper()}: {r['finding']} {r['id']}")
        n = taxonomy.validate().where(F.col("severity").isNotNull()).count()
        print(f"{n} findings")
        return 1 if n else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())

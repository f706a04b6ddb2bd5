"""Command line: index, search, stats, directory, clear, help of filters."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.plans.index import Index, Settings


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("command", choices=["index", "search", "stats", "directory", "clear", "filters"])
    p.add_argument("project", nargs="?", default="")
    p.add_argument("argument", nargs="?", default="", help="a directory to index, or a query")
    p.add_argument("--tables", default="tessera-tables")
    p.add_argument("--limit", type=int, default=5)
    p.add_argument("--files", default="")
    p.add_argument("--types", default="")
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    if a.command == "filters":
        print(search.filter_help())
        return
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    index = Index(spark, Settings(a.tables))
    if a.command == "index":
        print(json.dumps(index.update(a.project, a.argument, a.force)))
    elif a.command == "clear":
        index.clear(a.project)
    elif a.command == "directory":
        print(index.directory(a.project))
    elif a.command == "stats":
        print(json.dumps(index.statistics(a.project).first().asDict()))
    elif a.argument.strip():
        best = search.search(index.chunks(a.project), index.query([a.argument]), F.current_timestamp(), a.limit, a.files, a.types)
        for r in best.collect():
            print(f"{r['score']:.4f} {r['file_path']}:{r['start_line']}-{r['end_line']} {r['chunk_type']}")


if __name__ == "__main__":
    main()

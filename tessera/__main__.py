"""Command line: index a tree and ask it questions."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("--index", required=True, help="folder of the index")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("index")
    build.add_argument("root")
    build.add_argument("--ignore", action="append", default=[])
    commands.add_parser("status")
    find = commands.add_parser("find")
    find.add_argument("query")
    find.add_argument("--kind")
    find.add_argument("--limit", type=int, default=30)
    for name in ("refs", "callers", "callees", "dependencies", "affected", "get"):
        commands.add_parser(name).add_argument("id")
    for name in ("matches", "context"):
        task = commands.add_parser(name)
        task.add_argument("task")
        task.add_argument("--limit", type=int, default=20)
        task.add_argument("--budget", type=int, default=3000)
        task.add_argument("--intent", default="understand")
    a = parser.parse_args(argv)

    from .plans.api import Engine

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    engine = Engine(spark, a.index)
    one = lambda: spark.createDataFrame([(a.id,)], "id string")
    presets = {"refs": ("in", "reference"), "callers": ("in", "call"), "callees": ("out", "call"), "dependencies": ("out", None)}
    if a.command in ("index", "status"):
        print(json.dumps(engine.index(a.root, a.ignore) if a.command == "index" else engine.status()))
        return 0
    if a.command == "find":
        rows = engine.find(a.query, a.kind, a.limit)
    elif a.command in presets:
        rows = engine.relations(one(), *presets[a.command])
    elif a.command == "affected":
        rows = engine.affected(one())
    elif a.command == "get":
        rows = engine.get(one())
    else:
        tasks = spark.createDataFrame([(1, a.task)], "task_id long, text string")
        rows = engine.task_matches(tasks, a.limit) if a.command == "matches" else engine.task_context(tasks, a.budget, a.intent).orderBy("place")
    for line in rows.toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

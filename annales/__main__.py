"""Command line: python -m annales <command> --data <folder of tables>."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annales.functions.text import year_range_label
from annales.operators import graph, periods
from annales.plans import pipeline, views
from annales.session import local_session
from annales.sources.files import exists

TABLES = ("articles", "chunks", "entities", "triplets", "periods")


def _show(df: DataFrame, limit: int = 100) -> None:
    for row in df.limit(limit).collect():
        print("\t".join("" if v is None else str(v) for v in row))


def doctor(spark: SparkSession, args: argparse.Namespace) -> int:
    """Whether Spark runs and every table of the folder can be read."""
    missing = [t for t in TABLES if not exists(spark, f"{args.data}/{t}.parquet")]
    print(f"spark {spark.version}, {len(TABLES) - len(missing)} of {len(TABLES)} tables" + (f", missing: {', '.join(missing)}" if missing else ""))
    return 1 if missing else 0


def list_periods(spark: SparkSession, args: argparse.Namespace) -> int:
    """Periods in order; --check fails where years between them belong to none."""
    dim = views.periods(spark, args.data)
    _show(dim.orderBy("position").select("id", "name", year_range_label(dim["start_year"], dim["end_year"])))
    found = periods.gaps(dim.where("NOT parallel")).collect() if args.check else []
    for gap in found:
        print(f"gap {gap['gap_start']} to {gap['gap_end']}", file=sys.stderr)
    return 1 if found else 0


def stats(spark: SparkSession, args: argparse.Namespace) -> int:
    nodes, edges, dim = views.entities(spark, args.data), views.edges(spark, args.data), views.periods(spark, args.data)
    if args.by_period:
        _show(graph.period_shares(periods.in_period(nodes, dim), dim).orderBy("period_id"))
    else:
        _show(graph.table_counts(articles=views.articles(spark, args.data), chunks=views.chunks(spark, args.data), entities=nodes, relations=edges, periods=dim))
    return 0


def ask(spark: SparkSession, args: argparse.Namespace) -> int:
    asked = spark.createDataFrame([("q", args.question)], "query_id string, query string")
    row = pipeline.answer(asked, pipeline.open_store(spark, args.data), mode=args.mode).first()
    print(json.dumps(row.asDict(), ensure_ascii=False) if args.json else row["answer"])
    return 0


def build(spark: SparkSession, args: argparse.Namespace) -> int:
    """Reads, checks and counts every stage's tables from --skip-to on; stops at the first that fails."""
    counted = {"ingest": views.articles, "parse": views.articles, "chunk": views.chunks, "extract": views.triplets, "resolve": views.names, "load": views.edges, "embed": views.chunks}
    steps: dict[str, Callable[[], object]] = {name: lambda name=name, f=f: print(f"{name}\t{f(spark, args.data).count()}") for name, f in counted.items()}
    names = pipeline.build(steps, args.skip_to, args.dry_run)
    if args.dry_run:
        print("\n".join(names))
    return 0


def serve(spark: SparkSession, args: argparse.Namespace) -> int:
    from annales import api

    api.serve(api.Service(spark, pipeline.open_store(spark, args.data)), args.host, args.port).serve_forever()
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("annales")
    out.add_argument("--data", required=True, help="folder of tables")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor").set_defaults(run=doctor)
    one = commands.add_parser("periods")
    one.add_argument("--check", action="store_true")
    one.set_defaults(run=list_periods)
    one = commands.add_parser("stats")
    one.add_argument("--by-period", action="store_true")
    one.set_defaults(run=stats)
    one = commands.add_parser("ask")
    one.add_argument("question")
    one.add_argument("--mode", choices=("graph", "vector"), default="graph")
    one.add_argument("--json", action="store_true")
    one.set_defaults(run=ask)
    one = commands.add_parser("build")
    one.add_argument("--skip-to", choices=pipeline.STAGES)
    one.add_argument("--dry-run", action="store_true")
    one.set_defaults(run=build)
    one = commands.add_parser("serve")
    one.add_argument("--host", default="127.0.0.1")
    one.add_argument("--port", type=int, default=8000)
    one.set_defaults(run=serve)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(spark or SparkSession.getActiveSession() or local_session(), args)


if __name__ == "__main__":
    sys.exit(main())

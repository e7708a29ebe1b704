"""Command line: ``python -m weftline scan|deps|report|search FOLDER ...`` over models and reports below a folder."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.lookup import Ambiguous, NotFound
from weftline.plans import config, scan
from weftline.sinks import writers
from weftline.sources import dispatch


def load(spark: SparkSession, folder: str) -> scan.Analysis:
    """All models and reports below a folder, each report against the model it is paired with."""
    models, reports = dispatch.model_facts(spark, folder), dispatch.report_facts(spark, folder)
    pairs = scan.pair_reports(dispatch.datasets(reports), dispatch.named_models(spark, models)).where("model is not null").select("report", "model")
    return scan.analyse(models, reports, pairs)


def lines(rows: DataFrame, column: str) -> list[str]:
    """What is printed: a view for people, as long as it is."""
    return [r[column] for r in rows.select(column).toLocalIterator()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: clean; 1: findings, or a name that is not found; 2: incomplete, or wrong usage."""
    parser = argparse.ArgumentParser(prog="weftline")
    parser.add_argument("command", choices=["scan", "deps", "report", "search"])
    parser.add_argument("folder")
    parser.add_argument("text", nargs="?")
    parser.add_argument("--format", choices=["text", "json", "sarif", "markdown", "commands", "removable"], default="text")
    parser.add_argument("--type", action="append")
    parser.add_argument("--ignore", action="append")
    parser.add_argument("--impact", action="store_true")
    parser.add_argument("--depth", type=int)
    parser.add_argument("--regex", action="store_true")
    parser.add_argument("--case", action="store_true")
    a = parser.parse_args(argv)
    settings = config.load(Path.cwd())
    spark = spark or SparkSession.builder.getOrCreate()
    found = load(spark, a.folder)
    kinds, ignore = a.type or settings.types, (a.ignore or []) + settings.ignore
    try:
        if a.command == "scan":
            if a.format == "text":
                rows = scan.select_kinds(scan.unused(found), kinds)
                rows = rows.join(scan.ignored(found.objects, ignore).select("id"), "id", "left_anti") if ignore else rows
                out = lines(rows.orderBy("model", "kind_rank", "seq"), "display") + [f"broken: {x}" for x in lines(scan.broken(found), "target")]
            elif a.format == "json":
                out = lines(writers.scan_json(found), "document")
            elif a.format == "removable":
                out = lines(writers.removable(found), "value")
            else:
                rows = writers.issues(found)
                out = lines(*{"sarif": (writers.sarif(rows), "document"), "markdown": (writers.markdown(rows), "document"), "commands": (writers.commands(rows), "value")}[a.format])
            print("\n".join(out))
            return {"clean": 0, "findings": 1, "incomplete": 2}[scan.verdict(found, kinds, ignore)]
        if a.command == "report":
            print("\n".join(lines(writers.inventory_json(scan.inventory(found, match=[a.text] if a.text else None)), "document")))
        elif a.command == "search":
            print("\n".join(lines(writers.search_json(scan.search(found, a.text or "", a.regex, a.case, kinds)), "value")))
        else:
            nodes, _ = scan.deps(found, a.text or "", a.depth, a.impact, a.type)
            print("\n".join(lines(nodes.join(found.objects.select("id", "display"), "id").orderBy("depth", "display"), "display")))
        return 0
    except (NotFound, Ambiguous) as e:
        print(e, file=sys.stderr)
        return 1
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

"""Command line: run a module over a file, query a table, turn a log into Parquet.

    python -m millrace run CONFIG INPUT -o DIR [--format jsonl|csv|parquet]
    python -m millrace row CONFIG JSON
    python -m millrace sql FILE "SELECT ... FROM data"
    python -m millrace log-to-parquet FOLDER OUT

CONFIG is TOML or JSON: {"module": "package.name:ATTRIBUTE", "path": "folder for the tables"}.
"""

from __future__ import annotations

import argparse
import importlib
import json
import tomllib
from pathlib import Path

from pyspark.sql import SparkSession

from millrace.plans.pipeline import Pipeline
from millrace.plans.sqlview import query_data
from millrace.sources.files import read_any
from millrace.sources.logfile import log_to_parquet


def load(path: str) -> dict:
    text = Path(path).read_text()
    return tomllib.loads(text) if path.endswith(".toml") else json.loads(text)


def pipeline(spark: SparkSession, config: dict) -> Pipeline:
    place, _, name = config["module"].partition(":")
    return Pipeline(spark, config["path"], getattr(importlib.import_module(place), name))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in (("run", ["config", "input"]), ("row", ["config", "json"]), ("sql", ["file", "text"]), ("log-to-parquet", ["folder", "out"])):
        c = commands.add_parser(name)
        for p in places:
            c.add_argument(p)
        if name == "run":
            c.add_argument("-o", "--output", required=True)
            c.add_argument("--format", default="jsonl", choices=["jsonl", "csv", "parquet"])
    a = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "run":
        line = pipeline(spark, load(a.config))
        line.write_results(line.bulk(a.input), a.output, a.format)
    elif a.command == "row":
        print(json.dumps(pipeline(spark, load(a.config)).one(a.json), default=str))
    elif a.command == "sql":
        query_data(read_any(spark, a.file, strict=False), a.text).show(truncate=False)
    else:
        log_to_parquet(spark, a.folder, a.out)


if __name__ == "__main__":
    main()

"""``python -m chronolith.plans.cli scan|parse|model|forecast|export``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from chronolith.plans import export, ingest, model


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chronolith")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, fields in {"scan": ("root", "stubs"), "parse": ("root", "out", "identity"), "model": ("source", "out"), "forecast": ("source", "out"), "export": ("source", "out")}.items():
        sub = commands.add_parser(name)
        for f in fields:
            sub.add_argument(f)
        if name == "forecast":
            sub.add_argument("--horizons", type=int, nargs="+", default=[1, 3, 7, 14])
    a = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "scan":
        found = ingest.scan(spark, a.root, a.stubs)
        print(json.dumps(found, indent=2, ensure_ascii=False))
        return 0
    if a.command == "parse":
        done = ingest.parse(spark, a.root, a.out, a.identity)
        print(json.dumps(done, indent=2))
        return int(any(v != "written" for v in done.values()))
    if a.command == "model":
        model.run(spark, a.source, a.out)
    elif a.command == "forecast":
        model.run_forecast(spark, a.source, a.out, a.horizons)
    else:
        export.run(spark, a.source, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())

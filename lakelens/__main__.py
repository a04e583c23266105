"""python -m lakelens LAKE [QUESTION...]: index a folder of files and answer questions, given or typed."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from lakelens.plans.engine import Engine
from lakelens.sources.catalog import Catalog


def show(out: dict) -> None:
    if "datasets" in out and "task" in out:
        for d in out["datasets"]:
            print(f"{d['score']:8.3f}  {d['dataset']}  " + ", ".join(f"{m['desired']}={m['column']}" for m in d["matches"]))
        return
    if out.get("error"):
        print("error:", out["error"])
        return
    print(json.dumps(out["plan"]["steps"], ensure_ascii=False, default=str))
    print("\t".join(out["columns"]))
    for row in out["rows"]:
        print("\t".join(map(str, row)))


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("lakelens").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(Catalog.of_lake(spark, args[0])).build()
    for dataset, error in engine.errors.items():
        print(f"left out {dataset}: {error}", file=sys.stderr)
    for question in args[1:] or iter(lambda: input("? ").strip(), ""):
        show(engine.handle(question))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

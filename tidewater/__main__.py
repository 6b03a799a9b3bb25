"""python -m tidewater [--store PATH] [--sql] [--format table|json|csv] [--parquet NAME=PATH[:KEY,...]]... STATEMENT..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from tidewater.engine import Engine, Modified
from tidewater.sources.sinks import FORMATS, lines


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidewater", description=__doc__)
    p.add_argument("--store")
    p.add_argument("--sql", action="store_true")
    p.add_argument("--format", choices=FORMATS, default="table")
    p.add_argument("--parquet", action="append", default=[])
    p.add_argument("statement", nargs="+")
    a = p.parse_args(args)
    engine = Engine(spark or SparkSession.builder.appName("tidewater").getOrCreate(), a.store)
    for item in a.parquet:
        name, _, rest = item.partition("=")
        path, _, key = rest.rpartition(":") if ":" in rest.rsplit("/", 1)[-1] else (rest, "", "")
        engine.register(name, engine.spark.read.parquet(path), tuple(k for k in key.split(",") if k))
    for text in a.statement:
        out = engine.execute(text, sql=a.sql)
        if isinstance(out, DataFrame):
            print(*lines(out, a.format), sep="\n")
        else:
            print(f"{out.count} row(s) changed" if isinstance(out, Modified) else out.text)


if __name__ == "__main__":
    main()

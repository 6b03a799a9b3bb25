"""Results as text, and copies of a store."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans.nodes import LanguageError
from tidewater.sources.catalog import Catalog

FORMATS = ("table", "json", "csv")


def lines(df: DataFrame, form: str = "table", limit: int | None = 1000) -> Iterator[str]:
    """A result for a terminal, row by row; ``limit`` None gives all rows, a partition at a time."""
    if form not in FORMATS:
        raise LanguageError(f"a format is one of {', '.join(FORMATS)}")
    shown = df if limit is None else df.limit(limit)
    if form == "json":
        yield from shown.toJSON().toLocalIterator() if limit is None else shown.toJSON().collect()
        return
    rows = shown.toLocalIterator() if limit is None else shown.collect()
    if form == "csv":
        quote = lambda v: "" if v is None else json.dumps(str(v), ensure_ascii=False).replace('\\"', '""') if any(c in str(v) for c in ',"\n\r') else str(v)
        yield ",".join(map(quote, df.columns))
        for r in rows:
            yield ",".join(map(quote, r))
        return
    cells = [["" if v is None else str(v) for v in r] for r in rows]
    widths = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(df.columns)]
    yield " | ".join(c.ljust(w) for c, w in zip(df.columns, widths, strict=True))
    yield "-+-".join("-" * w for w in widths)
    for r in cells:
        yield " | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True))


def export(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a result from the executors: parquet, orc, json or csv with a header."""
    writer = df.write.option("header", "true") if form == "csv" else df.write
    writer.format(form).save(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _copy(source: Catalog, path: str) -> int:
    """Copy the segments that ``path`` doesn't have, from the executors, then the catalog; returns how many were copied."""
    target, copied = Catalog(source.spark, path), 0
    target.restore(source.snapshot())
    for t in target.tables.values():
        own = []
        for segment in t.segments:
            to = f"{path}/{t.name}/{segment.rsplit('/', 1)[-1]}"
            if not _exists(source.spark, f"{to}/_SUCCESS"):
                source.spark.read.parquet(segment).write.mode("overwrite").parquet(to)
                copied += 1
            own.append(to)
        t.segments = own
    target.save()
    return copied


def backup(catalog: Catalog, path: str) -> int:
    """Copy a store.  Segments never change, so a second back-up to a path copies only new ones."""
    return _copy(catalog, path)


def restore(spark: SparkSession, saved: str, path: str) -> Catalog:
    """A store at ``path`` as it was when it was saved."""
    if Catalog(spark, path).version:
        raise LanguageError(f"'{path}' holds a store already")
    _copy(Catalog(spark, saved), path)
    return Catalog(spark, path)

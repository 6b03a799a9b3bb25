"""A bounded sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of a sample: rows of each class, and characters of a row's text; longer texts aren't learnt from, but are scored.
ROWS_PER_CLASS, MOST_CHARS = 1500, 100_000


def fold(doc_id, folds: int):
    """crc32 of the doc_id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learnt_from, rows_per_class: int = ROWS_PER_CLASS, most_chars: int = MOST_CHARS) -> list[tuple[str, int]]:
    """At most ``rows_per_class`` (text, label) rows of each class, on the driver.

    The doc_ids with the smallest hashes are taken, so that the sample is the
    same each time.  ``learnt_from``: a condition on labels.  Null labels and
    doc_ids aren't learnt from; of a doc_id's repeated labels the larger counts,
    of its repeated documents the text that sorts first.
    """
    known = labels.where(learnt_from & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    order = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")]
    chosen = known.where("label = 0").orderBy(*order).limit(rows_per_class).unionByName(known.where("label = 1").orderBy(*order).limit(rows_per_class))
    # at most 2 * rows_per_class ids, whatever the input
    texts = docs.select("doc_id", "text").where(F.length("text") <= most_chars).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: r["doc_id"])]

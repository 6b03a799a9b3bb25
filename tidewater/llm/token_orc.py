"""Token ids of documents as ORC files.

A row is a document: its ids are a list of integers, which ORC stores with
integer run-length encoding (its second version packs them to the bits they
need).  Files are in ascending doc_id order with row indexes and Bloom filters
on doc_id, so that a look-up skips files, stripes and row groups by metadata,
and small stripes let many tasks read one file.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.bpe import encoder
from tidewater.llm.shared import Scratch, map_batches, slices

#: The id that ends a document.
END_ID = 0
#: How the files are written.
ORC_OPTIONS = {
    "compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.create.index": "true", "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.encoding.strategy": "COMPRESSION",
}
FILE_SCHEMA = "doc_id long, ids array<int>, n_tokens long, shard long, shard_start long"


def _encode(path: str | None, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        shard, start, end = TaskContext.get().partitionId(), 0, np.array([end_id], dtype="<u4").tobytes()
        own = encoder(path)
        for batch in slices(batches):
            ids = [own.encode(t) + end for t in batch.column(1).to_pylist()]
            lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            starts = start + np.concatenate([[0], np.cumsum(lengths)[:-1]])
            start += int(lengths.sum())
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(lengths), pa.array(np.full(len(ids), shard, dtype=np.int64)), pa.array(starts.astype(np.int64))],
                ["doc_id", "ids", "n_tokens", "shard", "shard_start"],
            )

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode every row of ``docs`` (doc_id, text, ...) into ORC files under ``path``.

    Null text: an empty one, so just the end id.  Rows are in ascending doc_id
    order, null doc_ids first, and of equal doc_ids by the text's hash.  Empty
    table: files without rows.  Other columns aren't read.  A shard is a range
    of doc_ids; shard_start counts the ids before a document in its shard.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    map_batches(placed, _encode(tokenizer, end_id), FILE_SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows: doc_id, ids, n_tokens, shard, and start, the number of ids of all documents before.

    Only the two small columns are read for the shards' totals, of which there is one row a file: as many as the write had
    partitions, and of 16 bytes, which is why they're summed in one task and broadcast.
    """
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "shard").select("doc_id", "ids", "n_tokens", "shard", (F.col("offset") + F.col("shard_start")).alias("start"))


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of some documents; the filter reaches ORC's indexes and Bloom filters.

    A doc_id that stands on several rows gives all of them, one that isn't there
    none, and nulls can't be looked up.  Ids of an empty or null text: the end
    id.  A very long document is one row, read whole.  No files' rows: no rows.
    """
    return spark.read.schema(FILE_SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def crc32_of(values: pa.Array) -> list[int]:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    ends = np.cumsum(np.asarray(values.value_lengths()))
    view, at, out = memoryview(flat).cast("B"), 0, []
    for end in ends.tolist():
        out.append(zlib.crc32(view[at * 4 : end * 4]))
        at = end
    return out


def _digest(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc32_of(batch.column(3)), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the token files of ``docs`` in the shared folder, read them back, and return doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone.  Null doc_ids come first; equal
    ones are ordered by their text's hash, and each row has its own start.  A
    very long text is one row of the files, in memory once as text and once as
    ids.  Empty table: no rows.  Other columns aren't read.
    """
    spark = docs.sparkSession
    path = Scratch(spark, "token-orc").new_path("files")
    write_token_files(docs, path, tokenizer, end_id)
    rows = read_token_files(spark, path)
    return map_batches(rows.select("doc_id", "start", "n_tokens", "ids"), _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Token ids in ORC files.

Documents are range-partitioned by id, encoded, and written in ascending order.
ORC stores the ids with integer run-length encoding in stripes that readers
open in parallel; row indexes and a Bloom filter on the document id let a
lookup skip stripes and row groups without reading ids.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrain.llm import bpe
from tracegrain.plans.materialize import shared_dir, staged

#: Layout of the files: bytes of a stripe, rows of a row group, and the filter's error.
STRIPE_BYTES, ROW_GROUP, BLOOM_FPP = 16 << 20, 1000, 0.01
SCHEMA = "doc_id long, shard int, seq long, ids array<int>"


def write(df: DataFrame, vocabulary: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> str:
    """Encode ``df`` under a byte-level vocabulary and write its ids in ascending id order; returns the folder.

    Rows of equal id are ordered by text, null ids come first; a null text is
    empty. ``shard`` and ``seq`` hold each document's place in the whole order.
    A text is one row of the file, however long; columns besides id and text are
    left out. An empty table writes no rows.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    shared = spark.sparkContext.broadcast(vocabulary)  # a file of fixed size

    def place(batches):  # encodes and numbers in one go
        shard, seq = TaskContext.get().partitionId(), 0
        for (ids,), lists in bpe.encoded(batches, shared.value, tail):
            n = len(ids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(seq, seq + n, dtype=np.int64)), lists], names=["doc_id", "shard", "seq", "ids"])
            seq += n

    out = ordered.mapInArrow(place, SCHEMA).write.format("orc")
    for key, value in {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": BLOOM_FPP, "orc.create.index": "true", "orc.row.index.stride": ROW_GROUP, "orc.stripe.size": STRIPE_BYTES, "compression": "zstd"}.items():
        out = out.option(key, str(value))
    out.save(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, seq and ids; filters on doc_id are pushed to the stripes."""
    return spark.read.schema(SCHEMA).orc(path)


def _digest(batches):
    for b in batches:
        lists = b.column(3)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        ends = np.cumsum([0, *(np.asarray(lists.value_lengths().fill_null(0)))])
        crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "shard", "seq", "n_tokens", "ids_crc32"])


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files.

    ``start`` counts the ids of all documents before it: sums of whole shards
    (a row a shard) plus a running sum inside the shard.
    """
    rows = read(spark, path).mapInArrow(_digest, "doc_id long, shard int, seq long, n_tokens long, ids_crc32 long")
    rows = staged(rows, "token-catalogue")
    before = (Window.unboundedPreceding, -1)
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(*before)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("seq").rowsBetween(*before)), F.lit(0))
    return rows.withColumn("within", within).join(base, "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")

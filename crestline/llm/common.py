"""Helpers that the corpus operators share: durable cuts, ordered buckets, digests."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.session import durable, shared_folder

__all__ = ["durable", "shared_folder", "documents", "with_bucket", "slices", "scratch", "discard"]

#: Rows that one ordered range should hold, and the most split points that go through the driver: beyond 4e8 rows ranges
#: grow (to some 500 MB at 100 TB of documents), which tasks stream and spill.
BUCKET_ROWS, MAX_SPLITS = 2048, 200_000
#: Where null keys are in the order: under all others.
LOWEST = -1.7976931348623157e308


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet")


def with_bucket(df: DataFrame, key: str, tie: Column, out: str = "bucket", rows: int = BUCKET_ROWS) -> DataFrame:
    """Deal the numeric `key` into ascending ranges of about `rows` rows each, numbered (with gaps) in the long column `out`.

    The split points are quantiles of all rows (at most MAX_SPLITS of them reach the driver). Null
    keys are lowest. Equal keys share a range unless they fill more than one: then they have
    ranges of their own, dealt by `tie`, a 64-bit hash; rows equal in both stay together.
    """
    parts = max(1, min(MAX_SPLITS, -(-df.count() // rows)))
    if parts == 1:
        return df.withColumn(out, F.lit(0).cast("long"))
    value = "__bucket_value"
    held = df.withColumn(value, F.coalesce(F.greatest(F.col(key).cast("double"), F.lit(LOWEST)), F.lit(LOWEST)))
    got = held.approxQuantile(value, [i / parts for i in range(1, parts)], 0.25 / parts)
    # whole numbers beyond 2**53 can be equal as doubles without being so
    fills = {v: n + 1 for v, n in Counter(got).items() if n > 1 and (abs(v) < 2**53 or v == LOWEST)}
    cuts = sorted({x for x in got if np.isfinite(x)} | {float(np.nextafter(v, np.inf)) for v in fills if np.isfinite(v)})
    dealt = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=value, outputCol=f"{value}_at").transform(held)
    place = F.col(f"{value}_at").cast("long") * F.lit(1 << 24)
    if fills:
        shares = df.sparkSession.createDataFrame([(v, n) for v, n in fills.items()], "__bucket_hot double, __bucket_share long")
        dealt = dealt.join(F.broadcast(shares), F.col(value) == F.col("__bucket_hot"), "left").drop("__bucket_hot")  # at most MAX_SPLITS rows
        place = place + F.coalesce(F.pmod(tie, F.col("__bucket_share")), F.lit(0))
    return dealt.withColumn(out, place).drop(value, f"{value}_at", "__bucket_share")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about `limit` characters of text each, at least a row, and their texts (null: empty)."""
    texts, at = [t or "" for t in batch.column(column).to_pylist()], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
            size += len(texts[end])
            end += 1
        yield batch.slice(at, end - at), texts[at:end]
        at = end


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a written table: in the cluster's shared folder, in a local one only in a local session where none is set."""
    return f"{shared_folder(spark) or tempfile.mkdtemp(prefix='crestline-')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that scratch() named and nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

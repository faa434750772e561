"""Merkle fixity audit of WARC archives.

A record's hash is a leaf; nodes above it cover fixed, aligned offset ranges, each
FAN_OUT times as long as below, and hash their children in order. Replicas compare roots, and
only the children of nodes that differ are compared further, down to the records. Each replica
has its own offsets: a record that was lost, added or grew moves all that follow it in its
archive, so records of suspect ranges are matched by their ids, not by where they lie.

Trees are plain tables keyed by (archive, level, range), so levels are joins on those keys; a node
has at most FAN_OUT children, and a lowest range at most as many records as fit in its bytes.
Records are hashed and measured where they are read; only narrow rows are ordered and shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from crestline.llm.common import durable

#: Bytes of a lowest offset range, children of a node, records of an archive file.
RANGE, FAN_OUT, ARCHIVE_RECORDS = 65_536, 16, 1024


def record_id(key: Column, target: Column, payload: Column, kind: str = "resource") -> Column:
    """The id of a record: a hash of what it was made of, and its kind unless that is resource. Nulls are empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (key, target, payload)]
    return F.concat(F.lit("urn:sha1:"), F.sha1(F.concat(*parts).cast("binary")), F.lit("" if kind == "resource" else f":{kind}"))


def warc_record(key: Column, target: Column, payload: Column, kind: str = "resource", content_type: str = "text/html") -> Column:
    """A WARC/1.0 record as text. A null payload is empty, a null target an empty URI."""
    body, uri = F.coalesce(payload, F.lit("")), F.coalesce(target, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Record-ID: <"), record_id(key, target, payload, kind),
        F.lit(f">\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def in_archives(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add `archive` and `place` to narrow rows: their exact number by `order` (nulls first), and the file of ARCHIVE_RECORDS that it falls in.

    Rows are range-partitioned and sorted once; equal rows are spread by a row number, so that no key is one task.
    Only the number of rows of each partition reaches the driver.
    """
    keys = [*[F.col(c).asc_nulls_first() for c in order], F.col("__n")]
    dealt = rows.withColumn("__n", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], names=[*b.schema.names, "__part", "__at"])
            at += n

    held = durable(dealt.mapInArrow(run, StructType([*rows.schema.fields, StructField("__part", IntegerType()), StructField("__at", LongType())])))
    before, bases = 0, []
    for r in held.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():
        bases.append((r["__part"], before))
        before += r.n
    spread = held.join(F.broadcast(rows.sparkSession.createDataFrame(bases, "__part int, __base long")), "__part")  # a row for each partition
    place = F.col("__base") + F.col("__at")
    return spread.select(*rows.columns, F.floor(place / F.lit(ARCHIVE_RECORDS)).cast("long").alias("archive"), place.alias("place"))


def lay_out(records: DataFrame) -> DataFrame:
    """Leaves with their `offset`: records (archive, place, length, ...) of an archive end to end by place."""
    before = Window.partitionBy("archive").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("place")


def tree(leaf_rows: DataFrame) -> list[DataFrame]:
    """Nodes (archive, node, hash) of each level, from the lowest ranges to the roots (node 0)."""
    span = leaf_rows.select("archive", F.expr(f"`offset` div {RANGE}").alias("node"), "offset", "hash", "length")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "hash")))
    joined = lambda c, part: F.sha2(F.array_join(F.transform(c, part), "|"), 256)
    low = span.groupBy("archive", "node").agg(joined(ordered, lambda x: F.concat_ws(":", x["offset"].cast("string"), x["length"].cast("string"), x["hash"])).alias("hash"))
    levels = [durable(low)]
    while not levels[-1].where("node > 0").isEmpty():
        up = levels[-1].select("archive", F.expr(f"node div {FAN_OUT}").alias("up"), "node", "hash")
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        levels.append(durable(up.groupBy("archive", F.col("up").alias("node")).agg(joined(children, lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])).alias("hash"))))
    return levels


def differing(one: DataFrame, other: DataFrame, within: DataFrame | None) -> DataFrame:
    """(archive, node) whose hashes differ or that only one side has; `within` restricts both sides to those parents."""
    if within is not None:
        parents = within.withColumnRenamed("node", "parent")
        one, other = (t.withColumn("parent", F.expr(f"node div {FAN_OUT}")).join(parents, ["archive", "parent"], "left_semi") for t in (one, other))
    a, b = one.select("archive", "node", F.col("hash").alias("a")), other.select("archive", "node", F.col("hash").alias("b"))
    return a.join(b, ["archive", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "node")


def audit(one: DataFrame, other: DataFrame, keep: list[str], record: str | None = None) -> DataFrame:
    """Records at which two replicas differ: archive, offset, length, keep..., status (changed, missing, extra), hash_one, hash_other.

    `one` and `other` are leaves (archive, offset, length, hash, keep...). Records are matched by their id, the column
    `record`, equal ids of an archive in their order; without one by their offset, which both replicas must
    then share. A record that only moved is no difference. Offset and length are those of `one`, of `other`
    for extra records. Replicas that are equal give no rows; an empty replica gives all of the other's records.
    """
    one, other = durable(one), durable(other)
    a, b = tree(one), tree(other)
    height = max(len(a), len(b))
    for levels in (a, b):
        while len(levels) < height:  # a lower tree's root is its own parent
            levels.append(levels[-1])
    suspect = None
    for k in range(height - 1, -1, -1):
        suspect = durable(differing(a[k], b[k], suspect))
        if suspect.isEmpty():
            break
    spans = suspect.withColumnRenamed("node", "span")
    left, right = (t.withColumn("span", F.expr(f"`offset` div {RANGE}")).join(spans, ["archive", "span"], "left_semi").drop("span") for t in (one, other))
    if record is not None:
        nth = F.row_number().over(Window.partitionBy("archive", record).orderBy("offset"))
        left, right = (t.withColumn("__same", F.struct(F.coalesce(F.col(record), F.lit("")), nth)) for t in (left, right))
    else:
        left, right = (t.withColumn("__same", F.col("offset")) for t in (left, right))
    left = left.select("archive", "__same", F.col("hash").alias("hash_one"), F.struct("offset", "length", *keep).alias("x"))
    right = right.select("archive", "__same", F.col("hash").alias("hash_other"), F.struct("offset", "length", *keep).alias("y"))
    both = left.join(right, ["archive", "__same"], "full").where(~F.col("hash_one").eqNullSafe(F.col("hash_other")))
    status = F.when(F.col("hash_other").isNull(), "missing").when(F.col("hash_one").isNull(), "extra").otherwise("changed")
    value = F.coalesce("x", "y")
    return both.select("archive", value["offset"].alias("offset"), value["length"].alias("length"), *[value[c].alias(c) for c in keep], status.alias("status"), "hash_one", "hash_other")

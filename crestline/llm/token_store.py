"""Token-id files with bit-plane shuffling.

A chunk is a run of whole documents in ascending doc_id. Its ids are cut into fixed-size
blocks; a block is transposed into bit planes (or byte planes), the planes above the largest
id are left out, and each plane is one zstandard frame. Chunks are rows of a Parquet folder, so
any store that Spark writes to will do; a chunk index beside it holds each chunk's first
position, so that read() of some documents opens only the chunks that hold them.

Layout: <path>/chunks (bucket, seq, n_ids, doc_ids, lengths, blocks), <path>/index (bucket, seq,
n_docs, n_ids, start).
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.llm import common
from crestline.llm import segments as S

#: Ids in a block, ids from which on a chunk is full, zstandard level.
BLOCK, CHUNK_IDS, LEVEL = 65_536, 1_000_000, 3

CHUNK_SCHEMA = "bucket long, seq int, n_ids long, doc_ids array<long>, lengths array<long>, blocks array<struct<n:int,planes:array<binary>>>"


def pack_block(ids: np.ndarray, plane: str = "bit") -> list[bytes]:
    """The compressed planes of one block of unsigned 32-bit ids, lowest first."""
    size = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    data = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(len(ids), 4)
    if plane == "byte":
        rows = [np.ascontiguousarray(data[:, i]) for i in range(-(-size // 8))]
    else:
        bits = np.unpackbits(data[:, : -(-size // 8)], axis=1, bitorder="little")
        rows = list(np.packbits(bits.T[:size], axis=1, bitorder="little"))
    press = zstandard.ZstdCompressor(level=LEVEL)
    return [press.compress(r.tobytes()) for r in rows]


def unpack_block(planes: list[bytes], n: int, plane: str = "bit") -> np.ndarray:
    """The ids of a block; the inverse of pack_block."""
    expand = zstandard.ZstdDecompressor()
    data = np.zeros((n, 4), np.uint8)
    rows = [np.frombuffer(expand.decompress(p), np.uint8) for p in planes]
    if plane == "byte":
        for i, r in enumerate(rows):
            data[:, i] = r
    elif rows:
        bits = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], axis=1)
        packed = np.packbits(bits, axis=1, bitorder="little")
        data[:, : packed.shape[1]] = packed
    return data.reshape(-1).view("<u4").copy()


@functools.cache
def _encoder(path: str) -> tuple[S.Encoder, dict[str, int]]:
    first, table, special, _ = S.byte_bpe(path)
    return S.Encoder(S.ByteSplitter(), lambda codes, lengths: S.byte_units(codes, lengths, first, table)), special


def encode(df: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """(bucket, doc_id, ids): the ids of each whole text, little-endian and as narrow as they allow, with the end id."""
    schema = "bucket long, doc_id long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, special = _encoder(tokenizer)
        tail = [] if end_id is None else [end_id]
        for batch in batches:
            for b, texts in common.slices(batch):
                ids = [np.r_[x, tail].astype("<u4") for x in encoder.encode(texts, special)]
                # first byte: the width in bytes
                cells = [b"\x02" + x.astype("<u2").tobytes() if not len(x) or x.max() < 65_536 else b"\x04" + x.tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([b.column("bucket").cast(pa.int64()), b.column("doc_id").cast(pa.int64()), pa.array(cells, pa.binary())], names=["bucket", "doc_id", "ids"])

    return df.select("bucket", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _pack(plane: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, docs, held, size = None, 0, [], [], 0

        def chunk() -> pa.RecordBatch:
            ids = np.concatenate(held) if held else np.zeros(0, "<u4")
            blocks = [{"n": len(x := ids[i : i + BLOCK]), "planes": pack_block(x, plane)} for i in range(0, len(ids), BLOCK)]
            row = {"bucket": [now], "seq": [seq], "n_ids": [len(ids)], "doc_ids": [docs], "lengths": [[len(x) for x in held]], "blocks": [blocks]}
            return pa.RecordBatch.from_pydict(row, schema=_ARROW)

        for b in batches:
            for bucket, doc, cell in zip(b.column("bucket").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if docs and (bucket != now or size >= CHUNK_IDS):
                    yield chunk()
                    seq, docs, held, size = seq + 1 if bucket == now else 0, [], [], 0
                elif bucket != now:
                    seq = 0
                now = bucket
                held.append(np.frombuffer(cell, f"<u{cell[0]}", offset=1))
                docs.append(doc)
                size += len(held[-1])
        if docs:
            yield chunk()

    return run


_ARROW = pa.schema([
    ("bucket", pa.int64()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("blocks", pa.list_(pa.struct([("n", pa.int32()), ("planes", pa.list_(pa.binary()))]))),
])


def write(df: DataFrame, path: str, tokenizer: str, end_id: int | None = None, plane: str = "bit") -> None:
    """Write the ids of df's texts (columns doc_id, text) in ascending doc_id to `path`.

    Null texts are empty; null doc_ids come first; equal doc_ids follow each other
    by the hash range of their texts, then by their ids; an empty table gives an empty file; other columns are not read. Texts are encoded
    where they are read; the ids are shuffled once.
    """
    spark = df.sparkSession
    dealt = common.with_bucket(df.select("doc_id", "text"), "doc_id", F.xxhash64("text"))
    ordered = encode(dealt, tokenizer, end_id).repartition("bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    ordered.mapInArrow(_pack(plane), CHUNK_SCHEMA).write.parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks").select("bucket", "seq", F.size("doc_ids").alias("n_docs"), "n_ids")
    in_bucket = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # of at most MAX_SPLITS buckets
    totals = chunks.groupBy("bucket").agg(F.sum("n_ids").alias("all_ids"))
    totals = totals.select("bucket", F.coalesce(F.sum("all_ids").over(before), F.lit(0)).alias("first"))
    index = chunks.withColumn("inside", F.coalesce(F.sum("n_ids").over(in_bucket), F.lit(0))).join(totals, "bucket")
    index.select("bucket", "seq", "n_docs", "n_ids", (F.col("first") + F.col("inside")).alias("start")).write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str, plane: str = "bit", with_ids: bool = False, positions: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the planes.

    With `positions` (first, last + 1) of the whole run of ids, only documents with an id there come,
    and only the chunks that the index names are opened.
    """
    schema = "bucket long, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = np.concatenate([unpack_block(x["planes"], x["n"], plane) for x in row["blocks"]] or [np.zeros(0, "<u4")])
                lengths = np.array(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                each = [ids[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                columns = [
                    pa.array([row["bucket"]] * len(each), pa.int64()), pa.array([row["seq"]] * len(each), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts), pa.array(lengths), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "seq", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    index = spark.read.schema("bucket long, seq int, n_docs int, n_ids long, start long").parquet(f"{path}/index")
    if positions is not None:
        first, last = positions
        index = index.where((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first))
        low, high = index.agg(F.min("bucket"), F.max("bucket")).first()
        wanted = F.col("bucket").between(low, high) if low is not None else F.lit(False)  # reaches the scan
        chunks = chunks.where(wanted).join(index.select("bucket", "seq"), ["bucket", "seq"], "left_semi").select(*chunks.columns)
    docs = chunks.mapInArrow(run, schema)
    out = docs.join(index.select("bucket", "seq", "start"), ["bucket", "seq"]).withColumn("start", F.col("start") + F.col("inside"))
    if positions is not None:
        out = out.where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)

"""Document fingerprints by content-defined chunking.

A gear hash over the UTF-8 bytes proposes boundaries; chunking is normalised: a strict mask
holds before the wanted size, a loose one after it, within a least and a greatest size. A
fingerprint is the set of its chunks' digests, each with the bytes that it covers in the text;
containment is the bytes of the shared digests over all of the document's own. An insertion
moves the boundaries only near it. All texts have one scale, fine enough for texts of a few words.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import with_bucket

#: Least, wanted and greatest bytes of a chunk; bits of the strict and the loose mask. Chunks have 8 bytes on average.
LEAST, WANTED, MOST, STRICT, LOOSE = 2, 8, 16, 3, 2
#: Low bits of a digest that hold the bytes it covers (a string of Spark has fewer than 2**31), and bits of hash above them.
COVERED, HASH = 32, 32
#: Characters of fingerprints that a batch of rows holds.
HELD = 2_000_000
#: Bytes that the gear hash is computed for at a time, and that one of its values depends on; boundaries look at its low 16 bits only.
BLOCK, REACH = 1 << 20, 32


@functools.cache
def _gears() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


@functools.cache
def _digest_gears() -> tuple[np.ndarray, np.ndarray]:
    """A random number per byte, and powers of an odd number for each place in a chunk."""
    value = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(MOST, np.uint64(0x9E3779B97F4A7C15))], dtype=np.uint64)
    return value, power


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash after each byte: sum of gear[byte] << distance over the last 32 bytes."""
    h = _gears()[data]
    shift = 1
    while shift < REACH:  # windows double: 1, 2, 4, ... 32 bytes
        moved = h[:-shift] << np.uint32(shift)
        h[shift:] += moved
        shift *= 2
    return h


def boundaries(data: np.ndarray, least: int, wanted: int, most: int, strict_bits: int, loose_bits: int) -> list[int]:
    """The ends of the chunks of `data`."""
    n = len(data)
    strict, loose = [], []
    for start in range(0, n, BLOCK):
        lead = min(start, REACH - 1)
        seen = gear_hashes(data[start - lead : start + BLOCK])[lead:].astype(np.uint16)  # these bits depend on the last 16 bytes
        at = np.flatnonzero(seen < 1 << (16 - loose_bits))
        loose += (at + start + 1).tolist()
        strict += (at[seen[at] < 1 << (16 - strict_bits)] + start + 1).tolist()
    ends, at = [], 0
    while n - at > least:
        i = bisect_left(strict, at + least)
        if i < len(strict) and strict[i] < at + wanted:
            end = strict[i]
        else:
            i = bisect_left(loose, at + wanted)
            end = min(loose[i] if i < len(loose) else n, at + most, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def fingerprint(text: str) -> np.ndarray:
    """Sorted distinct chunk digests as unsigned numbers: HASH bits above the bytes that its chunks cover in the text."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    ends = np.array(boundaries(data, LEAST, WANTED, MOST, STRICT, LOOSE))
    starts = np.r_[0, ends[:-1]]
    value, power = _digest_gears()
    with np.errstate(over="ignore"):
        h = np.add.reduceat(value[data] * power[np.arange(len(data)) - np.repeat(starts, ends - starts)], starts)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    digest, which = np.unique(h >> np.uint64(64 - HASH), return_inverse=True)
    covers = np.bincount(which, ends - starts).astype(np.uint64)
    return (digest << np.uint64(COVERED)) | covers


def containment(own: np.ndarray, other: np.ndarray) -> float:
    """Share of `own`'s bytes in chunks that `other` has too; 1 for two empty texts, 0 for one."""
    if not len(own) or not len(other):
        return float(len(own) == len(other))
    size = (own & np.uint64((1 << COVERED) - 1)).astype(np.int64)
    mine, others = own >> np.uint64(COVERED), other >> np.uint64(COVERED)
    at = np.searchsorted(others, mine)
    at[at == len(others)] = 0
    return float(size[others[at] == mine].sum() / size.sum())


def as_text(print_: np.ndarray) -> str:
    """Base64 of a fingerprint: the number of digests, their hashes in ascending order (4 bytes each, highest first), the bytes that each covers.

    Numbers have seven bits a byte, lowest first, the top bit set on all but the last: most digests take five bytes.
    An empty fingerprint is an empty string.
    """
    if not len(print_):
        return ""
    hashes = (print_ >> np.uint64(COVERED)).astype(">u4").tobytes()
    covers = print_ & np.uint64((1 << COVERED) - 1)
    return base64.b64encode(_numbers(np.array([len(print_)], np.uint64)) + hashes + _numbers(covers)).decode()


def from_text(text: str) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(base64.b64decode(text), np.uint8)
    head = int(np.argmax(data < 128)) + 1
    n = int(_read(data[:head])[0])
    hashes = data[head : head + 4 * n].view(">u4").astype(np.uint64)
    return hashes << np.uint64(COVERED) | _read(data[head + 4 * n :])


def _numbers(values: np.ndarray) -> bytes:
    if not (values > 127).any():
        return values.astype(np.uint8).tobytes()
    long = sum((values >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(1, 10)) + 1
    at = np.cumsum(long) - long
    out = np.zeros(int(long.sum()), np.uint8)
    for k in range(int(long.max(initial=0))):
        more = long > k
        out[at[more] + k] = (values[more] >> np.uint64(7 * k)) & np.uint64(127) | (long[more] > k + 1) * np.uint64(128)
    return out.tobytes()


def _read(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128) + 1
    starts = np.r_[0, ends][:-1]
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    parts = (data & 127).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64))
    return np.add.reduceat(parts, starts)


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much as there is of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, doc_id, text, halo) so that within a bucket, by descending doc_id, each row's next document follows it.

    Every bucket has a copy of the row that comes next after it (halo 1); the last document's
    next is the first. Null doc_ids come last; equal doc_ids follow each other in no set order.
    The number of buckets is bounded, so only bounded data meets in the driver.
    """
    dealt = with_bucket(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "doc_id", F.xxhash64("text"))
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("k"), F.col("doc_id").isNotNull().alias("n"))
    tops = {r.bucket: (r.top.k, r.top.n) for r in dealt.groupBy("bucket").agg(F.max(order).alias("top")).collect()}
    present = sorted(tops, reverse=True)
    # the first row of a bucket (in descending order) is also the halo of the bucket before
    above = {b: present[i - 1] for i, b in enumerate(present)}
    pairs = docs.sparkSession.createDataFrame([(b, tops[b][0], tops[b][1], above[b]) for b in present] or [(-1, 0, True, -1)], "bucket long, k long, n boolean, above long")
    own = dealt.withColumn("k", F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).withColumn("n", F.col("doc_id").isNotNull())
    marked = own.join(F.broadcast(pairs), ["bucket", "k", "n"], "left")  # a row for each of at most MAX_SPLITS buckets
    to = F.when(F.col("above").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("h")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("h")), F.struct(F.col("above").alias("b"), F.lit(1).alias("h")))
    )
    return marked.withColumn("to", F.explode(to)).select(F.col("to.b").alias("bucket"), "doc_id", "text", F.col("to.h").alias("halo"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness; SCHEMA has the columns.

    Null and empty texts have an empty fingerprint; whole texts are read, however long; repeated
    rows come out as often; an empty table gives no rows; other columns are not read. One shuffle
    moves the texts, by ranges of doc_id; each text is chunked once, its edited text once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0  # characters of the fingerprints in rows
        last = None  # bucket, doc_id, text, print, halo
        for b in batches:
            for bucket, doc, text, halo in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if last is not None and last[0] == bucket and last[4] and halo:
                    continue  # equal doc_ids: the first of them is the next document
                mark = fingerprint(text)
                if last is not None and last[0] == bucket and not last[4]:
                    rows.append(_compare(last[1], last[2], last[3], text, mark))
                    held += len(rows[-1][3]) + len(rows[-1][4])
                    if held >= HELD:
                        yield _batch(rows)
                        rows, held = [], 0
                last = (bucket, doc, text, mark, halo)
        if rows:
            yield _batch(rows)

    order = ["bucket", "halo", F.desc_nulls_last("doc_id"), "text"]
    return with_next(docs).repartition("bucket").sortWithinPartitions(*order).select("bucket", "doc_id", "text", "halo").mapInArrow(run, SCHEMA)


def _compare(doc, text, mark, following, follow_mark) -> tuple:
    new = edited(text, following)
    new_mark = fingerprint(new)
    return doc, len(text), hashlib.sha256(new.encode()).hexdigest(), as_text(mark), as_text(new_mark), containment(mark, new_mark), containment(mark, follow_mark)


_TYPES = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=[n for n, _ in _TYPES])

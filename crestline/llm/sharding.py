"""Best-fit-decreasing packing of indivisible groups into fixed-capacity shards.

One packing of all groups would be one task, so it runs twice. First each bay (a hash share of
the groups, about BAY_GROUPS of them) packs its groups, largest first, into crates: a group enters the
crate with the tightest remaining capacity that holds it, found in a balanced tree. Then crates are
packed the same way: into a number of shards all of them (some CRATES and more for a shard, and one
and more for a bay), into shards of a capacity only what bays left less than half full.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.llm.common import durable

#: Crates for each shard, groups and rows that one task should pack or number.
CRATES, BAY_GROUPS, BLOCK_ROWS = 256, 50_000, 50_000


class BinTree:
    """An AVL tree of (remaining capacity, bin); the tightest bin that fits is its successor search."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # a node is [key, left, right, height]

    def tightest(self, size: int):
        """The least (remaining, bin) with remaining >= size, or None."""
        node, found = self.root, None
        while node:
            if node[0][0] >= size:
                found, node = node[0], node[1]
            else:
                node = node[2]
        return found

    def add(self, key) -> None:
        self.root = self._add(self.root, key)

    def remove(self, key) -> None:
        self.root = self._remove(self.root, key)

    def _add(self, node, key):
        if node is None:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._add(node[side], key)
        return self._level(node)

    def _remove(self, node, key):
        if key == node[0]:
            if node[1] is None or node[2] is None:
                return node[1] or node[2]
            low = node[2]
            while low[1]:
                low = low[1]
            node[0], key = low[0], low[0]
            node[2] = self._remove(node[2], key)
        else:
            side = 1 if key < node[0] else 2
            node[side] = self._remove(node[side], key)
        return self._level(node)

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _turn(self, node, up: int):
        """Rotate so that the child on side `up` takes the node's place."""
        down = 3 - up
        child = node[up]
        node[up], child[down] = child[down], node
        for n in (node, child):
            n[3] = 1 + max(self._height(n[1]), self._height(n[2]))
        return child

    def _level(self, node):
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        lean = self._height(node[1]) - self._height(node[2])
        if abs(lean) < 2:
            return node
        heavy = 1 if lean > 0 else 2
        if self._height(node[heavy][heavy]) < self._height(node[heavy][3 - heavy]):
            node[heavy] = self._turn(node[heavy], 3 - heavy)
        return self._turn(node, heavy)


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> list[int]:
    """The bin of each size; sizes must come in descending order. A size over the capacity gets a bin of its own."""
    tree, bins, out = BinTree(), 0, []
    for s in sizes:
        fit = tree.tightest(s)
        if fit is None:
            left, at = capacity - s, bins
            bins += 1
        else:
            tree.remove(fit)
            left, at = fit[0] - s, fit[1]
        if left > 0:
            tree.add((left, at))
        out.append(at)
    return out


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size (descending), with sizes of shards as near equal as best fit makes them.

    Sizes of at least an equal share of what is left get shards of their own; for the rest the
    least capacity that needs no more shards than there are is found by bisection.
    """
    out, rest, left, at = [0] * len(sizes), sum(sizes), shards, 0
    while at < len(sizes) and left > 1 and sizes[at] * left >= rest:
        out[at] = shards - left
        rest, left, at = rest - sizes[at], left - 1, at + 1
    tail, first = sizes[at:], shards - left
    if not tail:
        return out
    low, high = max(tail[0], -(-rest // left)), rest
    found = [0] * len(tail)
    step = max(1, low // 4096)
    cap = low
    while cap < high:  # widen until it fits, then narrow
        if max(got := best_fit_decreasing(tail, cap)) < left:
            found, high = got, cap
            break
        low, cap, step = cap, cap + step, step * 2
    while high - low > 1 and high - low > low // 100_000:
        if max(got := best_fit_decreasing(tail, mid := (low + high) // 2)) < left:
            found, high = got, mid
        else:
            low = mid
    return out[:at] + [first + b for b in found]


def shard_groups(rows: DataFrame, group: list[str], size: str, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """Add `shard` to rows so that rows equal in `group` (no nulls) stay together.

    `size` is each row's own size (a positive long); a group's is their sum. With `shards`,
    exactly that many shards near equal in size; with `capacity`, as few shards of that
    capacity as best fit finds. A group larger than a shard has one alone. An empty table gives
    no rows. `rows` is read more than once: pass a written or checkpointed table.
    """
    spark = rows.sparkSession
    groups = rows.groupBy(*group).agg(F.sum(size).alias("__bytes"), F.count("*").alias("__rows"))
    total, n, n_rows = groups.agg(F.coalesce(F.sum("__bytes"), F.lit(0)), F.count("*"), F.coalesce(F.sum("__rows"), F.lit(0))).first()
    if (shards is None) == (not capacity):
        raise ValueError("either shards or capacity is needed")
    crate = max(1, -(-total // shards) // CRATES) if shards else capacity
    bays = max(1, -(-n // BAY_GROUPS))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.select(*group).schema)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        """One bay's groups into crates; for even shards the smallest groups, of about two crates together, into small ones."""
        frame = frame.sort_values(["__bytes", *group], ascending=[False, *[True] * len(group)], kind="stable").reset_index(drop=True)
        sizes = frame["__bytes"].to_numpy()
        after = sizes[::-1].cumsum()[::-1]
        head = len(sizes) if capacity else int(np.searchsorted(-after, -2 * crate)) if len(sizes) else 0
        big = best_fit_decreasing(sizes[:head].tolist(), crate)
        small = best_fit_decreasing(sizes[head:].tolist(), max(1, crate // 32))
        first = max(big, default=-1) + 1
        frame["__crate"] = np.array(big + [first + b for b in small], dtype="int64")
        return frame

    packed = durable(
        groups.withColumn("__bay", F.pmod(F.xxhash64(*group), F.lit(bays)).cast("int"))
        .groupBy("__bay")
        .applyInPandas(pack, f"{kinds}, __bytes long, __rows long, __bay int, __crate long")
    )
    crates = packed.groupBy("__bay", "__crate").agg(F.sum("__bytes").alias("b"))
    if shards:
        listed = crates.orderBy(F.desc("b"), "__bay", "__crate").collect()
        places = pack_into([r.b for r in listed], shards)
        where = spark.createDataFrame([(r["__bay"], r["__crate"], p) for r, p in zip(listed, places, strict=True)], "__bay int, __crate long, shard int")
        placed = packed.join(F.broadcast(where), ["__bay", "__crate"])  # CRATES and more for a shard, one and more for a bay
    else:
        placed = packed.join(_capacity_shards(crates, capacity), ["__bay", "__crate"])
    # groups with a good share of a shard's bytes or rows are few and may be hot: they need no shuffle
    heavy = (F.col("__bytes") * F.lit(HOT) > total) | (F.col("__rows") * F.lit(HOT) > n_rows)
    large = placed.where(heavy).select(*group, F.col("shard").alias("__large"))
    small = placed.where(~heavy).select(*group, "shard")
    known = rows.join(F.broadcast(large), group, "left")
    hot = known.where(F.col("__large").isNotNull()).withColumnRenamed("__large", "shard")
    cold = known.where(F.col("__large").isNull()).drop("__large").join(small, group)
    return hot.select(*rows.columns, "shard").unionByName(cold.select(*rows.columns, "shard"))


#: A group with more than this part of all bytes or rows is joined by broadcast: at most twice as many groups.
HOT = 4096


def _capacity_shards(crates: DataFrame, capacity: int) -> DataFrame:
    """(__bay, __crate, shard) of crates (__bay, __crate, b) that are shards of the capacity.

    Crates at least half full are numbered where they are, by bay; of the others a bay has one or so (any two
    would have gone into one), and they are packed together in the driver.
    """
    spark = crates.sparkSession
    crates = durable(crates)
    full = F.col("b") * 2 > capacity
    before, bases = 0, []
    for r in crates.where(full).groupBy("__bay").agg(F.count("*").alias("n")).orderBy("__bay").collect():
        bases.append((r["__bay"], before))
        before += r.n
    first = F.broadcast(spark.createDataFrame(bases, "__bay int, __base long"))  # a row for each bay
    at = F.row_number().over(Window.partitionBy("__bay").orderBy("__crate")) - 1
    numbered = crates.where(full).withColumn("__at", at).join(first, "__bay").select("__bay", "__crate", (F.col("__base") + F.col("__at")).cast("int").alias("shard"))
    left = crates.where(~full).orderBy(F.desc("b"), "__bay", "__crate").collect()
    places = best_fit_decreasing([r.b for r in left], capacity)
    merged = spark.createDataFrame([(r["__bay"], r["__crate"], before + p) for r, p in zip(left, places, strict=True)], "__bay int, __crate long, shard int")
    return numbered.unionByName(merged)


def number_slots(rows: DataFrame, order: list[str], n: int, shards: int, out: str = "slot") -> DataFrame:
    """Add the place of each row in its `shard`, from 0 without gaps, by (hash block, order).

    Blocks are numbered apart and offset by the rows of the blocks before, so that no shard is one task.
    """
    blocks = max(1, -(-n // (shards * BLOCK_ROWS)))
    held = rows.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("shard", "__block").count().select("shard", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    place = F.row_number().over(Window.partitionBy("shard", "__block").orderBy(*order)) - 1
    return held.withColumn("__place", place).join(offsets, ["shard", "__block"]).withColumn(out, (F.col("__offset") + F.col("__place")).cast("long")).drop("__block", "__place", "__offset")


def shard_texts(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents, by the law of near equal bytes.

    Equal texts stay together (they are compared by length and 96 bits of hashes; a null text
    counts as empty). Size is the UTF-8 length plus 1. Null and repeated doc_ids are rows like others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = durable(docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__text")))
    placed = durable(shard_groups(rows, ["__text", "text_crc32", "size"], "size", shards=shards))
    numbered = number_slots(placed, ["doc_id", "text_crc32", "size"], rows.count(), shards)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))

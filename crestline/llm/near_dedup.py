"""Near-duplicate components by a chosen-path set similarity join.

Each text is its set of distinct five-word shingles. Texts with equal sets are one
representative. Independent trees branch the representatives: a node's members go on to the
child that their minwise token at that level names, until a node is small. Members of small
nodes are compared by sketches of minwise tokens, and what could be linked is put in one block;
a block's full sets are then compared exhaustively, by inverted lists, and only confirmed links
unite documents. The percent of a link is the caller's; the number of trees is what the wanted
recall needs at the deepest level for it, and the bound of sketches follows from it too.

Hot groups: equal sets are collapsed before anything is paired; a node that stays large at the
deepest level is one block without comparison; a block too large for a task is compared node by
node. Of a node too large for a task all members are first compared with one pivot; those
confirmed need no comparison with each other, and the rest meets every member by pairs of parts.
No pair is dropped for size.

Sets are made from texts twice: for sketches, and in full for the representatives in blocks. The
second pass skips texts by a bitmap of wanted ids, so that no text is shuffled; null and
repeated ids only make it read more of them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import durable

#: Bits of the bitmap of wanted ids for each of them, and the most it may have (128 MB, which the driver holds and sends to each worker).
ID_BITS, MOST_BITS = 16, 1 << 30
SHINGLE, LEVELS, COORDINATES = 5, 3, 64
#: Links have 100 * intersection >= percent * union; this is the percent of the query op6.
PERCENT = 85
RECALL = 0.99998
#: Members of a node that is compared by sketches; members and shingles that are compared in full in one task.
LEAF, PART, PART_SHINGLES = 2048, 2048, 3_000_000
#: A pair at the threshold is taken for a link by its sketches down to so many deviations under its mean agreement.
DEVIATIONS = 5.7

_U = np.uint64


def trees(percent: int) -> int:
    """Trees for a recall of RECALL of links at the threshold: 12 at 85, 16 at 80."""
    if not 0 < percent < 100:
        raise ValueError(f"percent must lie between 0 and 100: {percent}")
    n = math.ceil(math.log(1 - RECALL) / math.log(1 - (percent / 100) ** LEVELS))
    if n * LEVELS > COORDINATES:
        raise ValueError(f"{percent} percent needs {n} trees, more than {COORDINATES} coordinates give")
    return n


def agree(percent: int) -> int:
    """Least equal coordinates of two sketches that could be linked: 38 of 64 at 85 (54 on average), 32 at 80 (51)."""
    p = percent / 100
    return math.floor(COORDINATES * p - DEVIATIONS * math.sqrt(COORDINATES * p * (1 - p)))


AGREE = agree(PERCENT)


@functools.cache
def _tables():
    rng = np.random.default_rng(4711)
    odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)
    lower = np.arange(256)
    lower[65:91] += 32
    split = np.zeros(256, bool)
    split[[32, *range(9, 14)]] = True
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[_U(1), np.full(4095, _U(0xD1342543DE82EF95))], dtype=np.uint64)
    return odd(256)[lower], split, power, odd(SHINGLE), odd(COORDINATES), odd(COORDINATES)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles (of the whole, if there are fewer words)."""
    none = np.zeros(0, np.uint64)
    if not text:
        return none
    value, split, power, weight, *_ = _tables()
    data = np.frombuffer(text.encode(), np.uint8)
    word = ~split[data]
    start = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    if not len(start):
        return none
    with np.errstate(over="ignore"):
        at = np.flatnonzero(word)
        first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        size = np.diff(np.r_[first, len(at)])
        place = np.arange(len(at)) - np.repeat(first, size)
        if (top := int(size.max())) > len(power):
            power = np.cumprod(np.r_[_U(1), np.full(top, power[1])], dtype=np.uint64)
        words = _mix(np.add.reduceat(value[data[at]] * power[place], first) + size.astype(np.uint64))
        n = len(words)
        if n < SHINGLE:
            return _mix((words * weight[:n]).sum(keepdims=True, dtype=np.uint64) + _U(n))
        total = words[: n - SHINGLE + 1] * weight[0]
        for k in range(1, SHINGLE):
            total = total + words[k : n - SHINGLE + 1 + k] * weight[k]
        return np.unique(_mix(total))


def minwise(items: np.ndarray) -> np.ndarray:
    """The least value of each of COORDINATES hash functions over the set."""
    *_, salt, factor = _tables()
    out = np.full(COORDINATES, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for i in range(0, len(items), 8192):
            part = items[i : i + 8192]
            np.minimum(out, ((part[None, :] ^ salt[:, None]) * factor[:, None]).min(axis=1), out=out)
    return out


def signature(items: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set, as two signed longs."""
    with np.errstate(over="ignore"):
        a, b = _mix(items + _U(1)).sum(dtype=np.uint64), _mix(items ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def describe(docs: DataFrame, n_trees: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, n, s1, s2, tokens, sketch, keys...): a row number, the set's size and signature, tree tokens, sketch, and long columns of docs as they are."""
    schema = "row long, doc_id long, n long, s1 long, s2 long, tokens array<long>, sketch binary" + "".join(f", `{k}` long" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("row", "n", "s1", "s2", "tokens", "sketch")}
            for t in b.column("text").to_pylist():
                items = shingles(t)
                least = minwise(items)
                s1, s2 = signature(items)
                with np.errstate(over="ignore"):
                    sketch = ((least * _U(0x9E3779B97F4A7C15)) >> _U(56)).astype(np.uint8).tobytes()
                tokens = least[: n_trees * LEVELS].astype(np.int64) if len(items) else None
                for k, v in zip(out, (row, len(items), s1, s2, tokens, sketch), strict=True):
                    out[k].append(v)
                row += 1
            kinds = {"row": pa.int64(), "n": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "tokens": pa.list_(pa.int64()), "sketch": pa.binary()}
            columns = {k: pa.array(v, kinds[k]) for k, v in out.items()}
            made = [columns["row"], b.column("doc_id"), *[columns[k] for k in ("n", "s1", "s2", "tokens", "sketch")], *[b.column(k) for k in keys]]
            yield pa.RecordBatch.from_arrays(made, names=["row", "doc_id", "n", "s1", "s2", "tokens", "sketch", *keys])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys).mapInArrow(run, schema)


def nodes(sets: DataFrame, n_trees: int) -> tuple[DataFrame, DataFrame]:
    """(node, row) of the small nodes with two members or more, and of the nodes still large at the deepest level."""
    level = sets.select("row", F.posexplode(F.expr(f"transform(sequence(0, {n_trees - 1}), t -> slice(tokens, t * {LEVELS} + 1, {LEVELS}))")).alias("tree", "path"))
    level = level.select("row", "path", F.xxhash64("tree", F.col("path")[0]).alias("node"))
    leaves = []
    for depth in range(1, LEVELS + 1):
        sizes = level.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
        level = durable(level.join(sizes, "node"))
        leaves.append(level.where(F.col("m") <= LEAF).select("node", "row"))
        large = level.where(F.col("m") > LEAF).drop("m")
        if depth == LEVELS or large.isEmpty():
            break
        level = large.select("row", "path", F.xxhash64("node", F.col("path")[depth]).alias("node"))
    small = functools.reduce(DataFrame.unionByName, leaves)
    return small, large.select("node", "row")


def _grouped(batches: Iterator[pa.RecordBatch], key: int = 0):
    """Runs of equal keys, as lists of columns' values; batches come sorted by the key."""
    held: list[list] = []
    now = None
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        keys = columns[key]
        i = 0
        while i < len(keys):
            j = i
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            if held and keys[i] != now:
                yield now, held
                held = []
            now = keys[i]
            if held:
                for h, c in zip(held, columns, strict=True):
                    h.extend(c[i:j])
            else:
                held = [c[i:j] for c in columns]
            i = j
    if held:
        yield now, held


def _plausible(percent: int):
    """Of each node, edges (row, least row) inside the groups that sketches could link."""
    least = agree(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, rows, sketches, ns) in _grouped(batches):
            order = np.argsort(np.array(rows), kind="stable")
            rows_, n = np.array(rows)[order], np.array(ns)[order]
            marks = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(rows), COORDINATES)[order]
            left = np.arange(len(rows))
            a, b = [], []
            while len(left) > 1:
                root, todo, left = left[0], [left[0]], left[1:]
                while todo and len(left):
                    i = todo.pop()
                    near = ((marks[left] == marks[i]).sum(axis=1) >= least) & (100 * np.minimum(n[left], n[i]) >= percent * np.maximum(n[left], n[i]))
                    hit = left[near]
                    left = left[~near]
                    todo.extend(hit.tolist())
                    a.append(rows_[hit])
                    b.append(np.full(len(hit), rows_[root]))
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(row, root): the least row of each row's component. Labels spread along edges and jump to their label's label; no edge reaches the driver."""
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("row"), F.least("a", "m").alias("root")))
    while True:
        seen = both.join(labels.withColumnRenamed("row", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        spread = labels.join(seen, labels.row == seen.a).select("row", F.least("root", "m").alias("new"), F.col("root").alias("old"))
        jump = spread.select(F.col("row").alias("j"), F.col("new").alias("to"))
        moved = durable(spread.join(jump, spread.new == jump.j).select("row", F.least("new", "to").alias("root"), "old"))
        labels = moved.select("row", "root")
        if moved.where("root != old").isEmpty():
            return labels


def _roots(rows: list[int], sets: list[np.ndarray], percent: int, seek: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed components of some sets: each distinct row and the least row it is linked to.

    Inverted lists give a set's intersection with all others at once. With `seek` only links of rows marked so are sought.
    """
    rows_, first = np.unique(np.array(rows, np.int64), return_index=True)
    sets = [sets[i] for i in first]
    sought = set(range(len(sets))) if seek is None else set(np.flatnonzero(np.isin(rows_, np.array(rows, np.int64)[np.array(seek, bool)])).tolist())
    size = np.array([len(s) for s in sets])
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    bounds = np.flatnonzero(np.r_[True, items[1:] != items[:-1], True]) if len(items) else np.zeros(1, np.int64)
    distinct = items[bounds[:-1]]
    for i, s in enumerate(sets):
        if i not in sought:
            continue
        at = np.searchsorted(distinct, s)
        start, length = bounds[at], bounds[at + 1] - bounds[at]
        shared = length > 1
        start, length = start[shared], length[shared]
        if not len(start):
            continue
        ends = np.cumsum(length)
        common = np.bincount(owner[np.arange(ends[-1]) + np.repeat(start - (ends - length), length)], minlength=len(sets))
        for j in np.flatnonzero(100 * common >= percent * (size + size[i] - common)).tolist():
            if j != i and (p := find(i)) != (q := find(j)):
                parent[max(p, q)] = min(p, q)
    return rows_, rows_[[find(i) for i in range(len(sets))]] if len(sets) else rows_


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, rows, sets) in _grouped(batches):
            a, b = _roots(rows, [np.frombuffer(s, np.uint64) for s in sets], percent)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash of a doc_id in ids, by blocks of 32,768 bits that the executors build."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    blocks = ids.select(F.floor(at / F.lit(32_768)).cast("int").alias("block"), (at % 32_768).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("held"))
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks.toLocalIterator():
        part = np.frombuffer(r.held, np.uint8)[: len(out) - r.block * 4096]
        out[r.block * 4096 : r.block * 4096 + len(part)] = part
    return out


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, items) for the representatives in wanted (row, doc_id, s1, s2), recomputed from their texts.

    Texts are read where they are, and skipped by a bitmap of the wanted ids (of MOST_BITS at most: with more ids
    more texts are made into sets, none is missed). Sets meet their rows on the signature, once each, so that
    null and repeated ids cost a pass over their texts and nothing more.
    """
    bits = min(MOST_BITS, max(32_768, 1 << math.ceil(math.log2(1 + ID_BITS * wanted.count()))))
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("doc_id"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = held.value, set()
        for b in batches:
            at = b.column(0).to_numpy()
            marks, sets = [], []
            for i in np.flatnonzero(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                items = shingles(b.column(1)[i].as_py())
                mark = signature(items)
                if len(items) and mark not in seen:
                    seen.add(mark)
                    marks.append(mark)
                    sets.append(items.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array(sets, pa.binary())], names=["s1", "s2", "items"])

    texts = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits)).alias("at"), "text").where("text IS NOT NULL")
    made = texts.mapInArrow(run, "s1 long, s2 long, items binary")
    return made.join(wanted.select("row", "s1", "s2"), ["s1", "s2"]).groupBy("row").agg(F.first("items").alias("items"))


def near_groups(docs: DataFrame, percent: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n, group, keys...) of each row of docs: its set's size and a number that the rows of its component share.

    Documents without words have no group. `keys` are long columns of docs that come along.
    """
    edge = "a long, b long"
    n_trees = trees(percent)
    sets = durable(describe(docs, n_trees, keys))
    groups = durable(sets.where("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("rep")))
    reps = sets.join(groups.select(F.col("rep").alias("row")), "row", "left_semi")
    small, large = nodes(reps.select("row", "tokens"), n_trees)
    members = small.join(reps.select("row", "sketch", "n"), "row").select("node", "row", "sketch", "n")
    edges = members.repartition("node").sortWithinPartitions("node").mapInArrow(_plausible(percent), edge)
    star = large.groupBy("node").agg(F.min("row").alias("b"))  # too large to compare: one block
    edges = edges.unionByName(large.join(star, "node").select(F.col("row").alias("a"), "b"))
    blocks = components(edges)

    known = reps.select("row", "doc_id", "n", "s1", "s2")
    placed = durable(blocks.join(known, "row"))
    weights = placed.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    heavy = weights.where((F.col("m") > PART) | (F.col("w") > PART_SHINGLES)).select("root")
    items = durable(full_sets(docs, placed.select("row", "doc_id", "s1", "s2")))
    light = placed.join(heavy, "root", "left_anti").select(F.col("root").alias("block"), "row").join(items, "row").select("block", "row", "items")
    roots = light.repartition("block").sortWithinPartitions("block").mapInArrow(_confirm(percent), edge).select(F.col("a").alias("row"), F.col("b").alias("root"))
    hard = durable(placed.join(heavy, "root", "left_semi").select("row", "n"))
    if not hard.isEmpty():
        roots = roots.unionByName(components(_node_links(small.unionByName(large), hard, items, percent)))
    roots = durable(roots)
    named = groups.join(roots.withColumnRenamed("row", "rep"), "rep", "left").select("s1", "s2", F.coalesce("root", "rep").alias("group"))
    return sets.select("doc_id", "n", "s1", "s2", *keys).join(named, ["s1", "s2"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("group")).alias("group"), *keys)


def near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. Links are of a Jaccard similarity from percent on.

    Documents without words are linked with nothing; null doc_ids count only where a component has no
    other id; repeated rows come out as often and are all kept or all not. Other columns are not read.
    """
    found = durable(near_groups(docs, percent))
    least = found.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = found.join(least, "group", "left")
    component = F.when(F.col("group").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _pivot_links(percent: int):
    """Of each task, whose first row is the pivot, the members that are linked to it: (node, row, pivot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = pivot = own = None
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for task, first, node, row, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                items = np.frombuffer(data, np.uint64)
                if task != now:
                    now, pivot, own = task, row, items
                    continue
                common = np.isin(items, own, assume_unique=True).sum()
                if row != pivot and 100 * common >= percent * (len(items) + len(own) - common):
                    for column, value in zip(out, (node, row, pivot), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["node", "row", "pivot"])

    return run


def _sought(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, rows, sets, seek) in _grouped(batches):
            a, b = _roots(rows, [np.frombuffer(s, np.uint64) for s in sets], percent, seek)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _node_links(memberships: DataFrame, hard: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) of the rows in blocks too large for a task, from their nodes.

    A node is cut into parts that fit a task. All members are compared with the node's pivot, its least row, part by
    part; those that are linked to it are one class. What is left is compared with every member: its parts
    meet all parts. So a group of near copies of one text costs one comparison a member.
    """
    held = durable(memberships.join(hard, "row"))
    n_parts = lambda: F.greatest(F.ceil(F.count("*") / (PART / 2)), F.ceil(F.sum("n") / (PART_SHINGLES / 2))).cast("int")
    parts = held.groupBy("node").agg(n_parts().alias("parts"), F.min("row").alias("pivot"))
    dealt = durable(held.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).select("node", "row", "n", "parts", "part", "pivot"))
    with_items = dealt.join(items, "row")
    first = with_items.where("row = pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = first.withColumn("at", F.lit(0)).unionByName(with_items.where("row <> pivot").withColumn("at", F.lit(1))).withColumn("task", F.xxhash64("node", "part"))
    near = tasks.repartition("task").sortWithinPartitions("task", "at").select("task", "at", "node", "row", "items").mapInArrow(_pivot_links(percent), "node long, row long, pivot long")
    near = durable(near)
    links = near.select(F.col("row").alias("a"), F.col("pivot").alias("b"))
    rest = dealt.where("row <> pivot").join(near.select("node", "row"), ["node", "row"], "left_anti")
    if rest.isEmpty():
        return links
    cut = rest.groupBy("node").agg(n_parts().alias("cuts"))
    rest = rest.join(cut, "node").withColumn("cut", F.pmod(F.xxhash64("row", F.lit(1)), F.col("cuts")).cast("int"))
    seeking = rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("node", "part", "cut", "row", F.lit(True).alias("seek"))
    met = dealt.join(cut, "node").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("node", "part", "cut", "row", F.lit(False).alias("seek"))
    pairs = seeking.unionByName(met).select(F.xxhash64("node", "part", "cut").alias("task"), "row", "seek")
    compared = pairs.join(items, "row").select("task", "row", "items", "seek").repartition("task").sortWithinPartitions("task").mapInArrow(_sought(percent), "a long, b long")
    return links.unionByName(compared)

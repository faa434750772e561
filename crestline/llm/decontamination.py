"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by documents: each row is a segment of documents with, for every term, the
ascending list of its positions (documents are laid end to end with a gap between). A phrase is
found by intersecting its terms' lists, each shifted by the term's offset, from the term that is
rarest in the segment on; phrases with a term that the segment lacks are left out before.

The index is built once and checkpointed; the benchmark's windows are a table of distinct phrases
that travels in blocks of bounded size, and the hits of all blocks are united by document.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import durable

#: Words of a window; words from which on a segment is full.
WINDOW, SEGMENT_WORDS = 10, 400_000
#: Windows and bytes of their words that one block has about: what the driver and each worker hold at a time.
BLOCK_WINDOWS, BLOCK_BYTES = 200_000, 32_000_000
#: Places that are intersected at a time when many phrases are sought.
CANDIDATES = 2_000_000
#: A word: letters a-z, digits and all that is not ASCII, after lower-casing A-Z; read in UTF-8, whose other bytes are all over 0x7F.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SEGMENT = "segment string, doc_ids array<long>, n_words array<long>, term_sizes array<int>, terms array<string>, positions binary"
_SEGMENT = pa.schema([("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("term_sizes", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("positions", pa.binary())])


def _encoded_words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode().lower()) if text else []  # lower() of bytes changes A-Z only


def words_of(text: str | None) -> list[str]:
    return [w.decode() for w in _encoded_words(text)]


class _Segment:
    """Documents being indexed: positions of the wanted terms, documents WINDOW apart from each other."""

    def __init__(self, wanted: dict[bytes, int] | None, gap: int):
        self.wanted, self.gap = wanted, gap
        self.clear()

    def clear(self) -> None:
        self.docs, self.sizes, self.at = [], [], 0
        self.ids, self.places = [], []
        self.own: dict[bytes, int] = defaultdict(itertools.count().__next__) if self.wanted is None else self.wanted

    def add(self, doc, text) -> None:
        words = _encoded_words(text)
        number = self.own.__getitem__ if self.wanted is None else functools.partial(_number, self.own)
        ids = np.fromiter(map(number, words), np.int32, len(words))
        places = np.flatnonzero(ids >= 0)
        self.ids.append(ids[places])
        self.places.append((places + self.at).astype(np.int64))
        self.docs.append(doc)
        self.sizes.append(len(words))
        self.at += len(words) + self.gap

    def row(self, number: int) -> pa.RecordBatch:
        ids, places = np.concatenate(self.ids), np.concatenate(self.places)
        order = np.argsort(ids, kind="stable")
        ids, places = ids[order], places[order]
        present, size = np.unique(ids, return_counts=True)
        names = list(self.own)
        # differences within a term, which are small
        step = np.diff(places, prepend=0)
        step[np.cumsum(size) - size] = places[np.cumsum(size) - size]
        segment = f"{TaskContext.get().partitionId()}-{number}"
        terms = pa.array(names, pa.binary()).cast(pa.string()).take(pa.array(present))
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        columns = [pa.array([segment]), one(pa.array(self.docs, pa.int64())), one(pa.array(self.sizes, pa.int64())), one(pa.array(size, pa.int32())), one(terms), pa.array([pack(step)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=_SEGMENT)


def _number(own: dict[bytes, int], word: bytes) -> int:
    return own.get(word, -1)


def pack(steps: np.ndarray) -> bytes:
    """Non-negative integers, one byte each where they fit: 255 marks one that follows in full."""
    small = np.minimum(steps, 255).astype(np.uint8)
    return len(small).to_bytes(8, "little") + small.tobytes() + steps[steps >= 255].astype("<i8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    steps = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    steps[steps == 255] = np.frombuffer(data, "<i8", offset=8 + n)
    return steps


def build_index(docs: DataFrame, terms: list[str] | None = None, gap: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The segments of an index over whole texts; `terms` restricts it to those, None takes all.

    Documents are taken as they are read: no shuffle. Null and empty texts have no words but are
    in doc_ids; a very long text makes a segment of its own; `gap` must be at least the longest phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = _Segment(None if terms is None else {t.encode(): i for i, t in enumerate(terms)}, gap), 0
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.add(doc, t)
                if held.at >= SEGMENT_WORDS:
                    yield held.row(number)
                    held.clear()
                    number += 1
        if held.docs:
            yield held.row(number)

    return durable(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SEGMENT))


class Postings:
    """One segment opened for reading: a row of the index, with lists or Arrow arrays in it."""

    def __init__(self, row: dict):
        self.docs, self.sizes = row["doc_ids"], np.asarray(row["n_words"], np.int64)
        self.terms, self.size = row["terms"], np.asarray(row["term_sizes"], np.int64)
        steps = unpack(row["positions"])
        self.ends = np.cumsum(self.size)
        total = np.cumsum(steps)
        before = np.r_[0, total][self.ends - self.size] if len(self.size) else self.size
        self.places = total - np.repeat(before, self.size)

    @functools.cached_property
    def range(self) -> dict[str, int]:
        """The number of each term."""
        return {t: i for i, t in enumerate(self.terms.to_pylist() if isinstance(self.terms, pa.Array) else self.terms)}

    def numbered(self, i: int) -> np.ndarray:
        return self.places[self.ends[i] - self.size[i] : self.ends[i]]

    def of(self, term: str) -> np.ndarray:
        i = self.range.get(term, -1)
        return self.numbered(i) if i >= 0 else self.places[:0]

    def starts(self, gap: int) -> np.ndarray:
        return np.cumsum(self.sizes + gap) - (self.sizes + gap)

    def phrase(self, terms: list[tuple[int, int]]) -> np.ndarray:
        """Where a phrase begins, given (offset, number of a term) from the rarest term on: lists shifted by their offsets, intersected."""
        found = self.numbered(terms[0][1]) - terms[0][0]
        for offset, term in terms[1:]:
            if not len(found):
                break
            shifted = self.numbered(term)
            at = np.searchsorted(shifted, found + offset)
            at[at == len(shifted)] = len(shifted) - 1
            found = found[shifted[at] == found + offset]
        return found[found >= 0]

    @functools.cached_property
    def term_at(self) -> np.ndarray:
        """The number of the term at each place, -1 between documents: all lists at once, to ask whether one holds a place."""
        out = np.full(int(self.places.max(initial=-1)) + 1, -1, np.int32)
        out[self.places] = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        return out

    def phrases(self, terms: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of many phrases begin where: rows of term numbers, of which the first lengths[k] count.

        The lists of all rarest terms, shifted by their offsets, are intersected with those of the second rarest and then of
        the others, CANDIDATES places at a time.
        """
        inside = np.arange(terms.shape[1])[None, :] < lengths[:, None]
        often = np.where(inside, self.size[np.where(inside, terms, 0)], np.iinfo(np.int64).max)
        rarest = often.argmin(axis=1)
        every, pick = np.arange(len(terms)), terms[np.arange(len(terms)), rarest]
        often[every, rarest] = np.iinfo(np.int64).max
        second = often.argmin(axis=1)
        count = self.size[pick]
        # where the second rarest must be, from a place of the rarest on; a phrase of one word asks for that word again
        alone = lengths == 1
        apart, other = np.where(alone, 0, second - rarest).astype(np.int32), np.where(alone, pick, terms[every, second]).astype(np.int32)
        table = np.pad(self.term_at, terms.shape[1], constant_values=-1)
        upto, found, begin = np.cumsum(count), [], 0
        while begin < len(terms):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + CANDIDATES, side="right")))
            n = count[begin:end]
            at = np.arange(int(n.sum()), dtype=np.int32)
            at += np.repeat((self.ends[pick[begin:end]] - np.cumsum(n)).astype(np.int32), n)
            at = self.places[at]
            kept = np.flatnonzero(table[at + np.repeat(apart[begin:end] + terms.shape[1], n)] == np.repeat(other[begin:end], n))
            which = begin + np.searchsorted(np.cumsum(n), kept, side="right")
            at = at[kept] - rarest[which]
            for k in range(terms.shape[1]):
                if not len(at):
                    break
                which, at = self._holding(which, at, terms, np.full(len(terms), k), lengths)
            found.append((which, at))
            begin = end
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (every, every)

    def _holding(self, which: np.ndarray, at: np.ndarray, terms: np.ndarray, offset: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The begins `at` of phrases `which` whose term at their offset is there; one beyond a phrase's end is."""
        o = offset[which]
        place = at + o
        ok = (at >= 0) & (place < len(self.term_at))
        ok[ok] = self.term_at[place[ok]] == terms[which[ok], o[ok]]
        ok |= (o >= lengths[which]) & (at >= 0)
        return which[ok], at[ok]

    def near(self, terms: list[str], within: int) -> np.ndarray:
        """Places of the first term's occurrences that have every other term within so many words, in any order."""
        found = self.of(terms[0])
        for term in terms[1:]:
            other = self.of(term)
            if not len(found) or not len(other):
                return found[:0]
            at = np.searchsorted(other, found - within)
            ok = at < len(other)
            ok[ok] = other[at[ok]] <= found[ok] + within
            found = found[ok]
        return found


def windows_of(words: list[str], size: int = WINDOW) -> Iterator[list[str]]:
    """All runs of `size` words; the whole of a shorter text; nothing of an empty one."""
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield words[i : i + size]


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(words, items): the distinct windows of all items (item_id, text), and the ids that have each. A null item_id is the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = list(windows_of(words_of(text), size))
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string())), pa.array([item] * len(part), pa.string())], names=["words", "item"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text IS NOT NULL")
    return named.mapInArrow(run, "words array<string>, item string").groupBy("words").agg(F.collect_set("item").alias("items"))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of the index in a batch, with their lists as Arrow arrays."""
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i] for c in batch.schema.names}
        yield {c: v.values if isinstance(v, pa.ListScalar) else v.as_py() for c, v in row.items()}


class _Block:
    """Phrases as one matrix of term numbers, rows padded with the number after the last term."""

    def __init__(self, table: pa.Table, size: int):
        flat = lambda name: table.column(name).combine_chunks()
        lists = flat("words")
        terms = lists.flatten().dictionary_encode()
        self.terms: list[str] = terms.dictionary.to_pylist()
        self.length = np.diff(lists.offsets.to_numpy())
        self.phrases = np.full((len(lists), size), len(self.terms), np.int32)
        self.phrases[np.arange(size)[None, :] < self.length[:, None]] = terms.indices.to_numpy()
        ids = flat("items")
        names = ids.flatten().dictionary_encode()
        self.names: list[str] = names.dictionary.to_pylist()
        self.ids, self.first = names.indices.to_numpy(), ids.offsets.to_numpy()
        order = sorted(range(len(self.names)), key=self.names.__getitem__)
        self.sorted_names = [self.names[i] for i in order]
        self.rank = np.argsort(np.array(order, np.int64))

    def items_of(self, phrase: int) -> list[str]:
        return [self.names[i] for i in self.ids[self.first[phrase] : self.first[phrase + 1]].tolist()]


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (sorted strings of the items with a window in it).

    `items` has item_id and text; their distinct windows are taken in blocks (BLOCK_WINDOWS, BLOCK_BYTES),
    each sought in the whole index, and the blocks' hits are united. A null item_id is the empty
    string; null and empty texts have no words; repeated items count once; repeated documents and
    null doc_ids are rows like others and come out as often; other columns are not read.
    """
    index = build_index(docs.select("doc_id", "text"), gap=size)
    phrases = durable(windows(items, size))
    total = F.sum(F.octet_length(F.concat_ws(" ", "words")) + 8 * F.size("items"))
    count, weight = phrases.agg(F.count("*"), F.coalesce(total, F.lit(0))).first()
    blocks = max(-(-count // BLOCK_WINDOWS), -(-int(weight) // BLOCK_BYTES))
    found = None
    for k in range(blocks):
        part = phrases if blocks == 1 else phrases.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k)
        hits = _search(index, _Block(part.toArrow(), size), size)
        found = hits if found is None else found.unionByName(hits)
    every = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("at", "x"))
    every = every.select("segment", "at", F.col("x.doc_ids").alias("doc_id"), F.col("x.n_words").alias("n_words"))
    if found is None:
        return every.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"))
    united = found.groupBy("segment", "at").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate("spans", start, lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")), lambda s: s["n"])
    united = united.select("segment", "at", covered.alias("n_hit"), "item_ids")
    none = F.array().cast("array<string>")
    return every.join(united, ["segment", "at"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))


def _search(index: DataFrame, block: _Block, size: int) -> DataFrame:
    """Of each document that has a phrase of the block: segment, at, the spans of its words in any phrase, the items."""
    shared = index.sparkSession.sparkContext.broadcast(block)
    kinds = pa.schema([("segment", pa.string()), ("at", pa.int32()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("item_ids", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        asked = pa.array(block.terms, pa.string())
        for b in batches:
            for row in _rows(b):
                seg = Postings(row)
                number = np.r_[pc.fill_null(pc.index_in(asked, value_set=seg.terms), -1).to_numpy(), 0]  # the last is the padding's
                present = np.flatnonzero((number >= 0)[block.phrases].all(axis=1))
                which, at = seg.phrases(number[block.phrases[present]], block.length[present])
                if len(at):
                    yield _hits(row["segment"], seg.starts(size), present[which], at, block, kinds)

    return index.mapInArrow(run, "segment string, at int, spans array<struct<a:long,b:long>>, item_ids array<string>")


def _hits(segment: str, first: np.ndarray, phrase: np.ndarray, at: np.ndarray, block: _Block, kinds: pa.Schema) -> pa.RecordBatch:
    """Of each document with hits its number, the spans of its words in any of them (those that touch as one), and the items."""
    doc = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((at, doc))
    begin, end = at[order], at[order] + block.length[phrase[order]]
    # documents lie apart, so that spans of two never touch
    reach = np.maximum.accumulate(end)
    new = np.r_[True, begin[1:] > reach[:-1]]
    of = doc[order][new]
    starts, stops = begin[new] - first[of], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]] - first[of]
    docs, n_spans = np.unique(of, return_counts=True)
    spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(stops)], names=["a", "b"])
    # items of the distinct phrases of each document
    pairs = np.unique(np.stack([doc, phrase], axis=1), axis=0)
    n_items = block.first[pairs[:, 1] + 1] - block.first[pairs[:, 1]]
    ends = np.cumsum(n_items)
    item = block.ids[np.repeat(block.first[pairs[:, 1]] - (ends - n_items), n_items) + np.arange(ends[-1])]
    held = np.unique(np.stack([np.repeat(pairs[:, 0], n_items), block.rank[item]], axis=1), axis=0)
    names = pa.array(block.sorted_names, pa.string()).take(pa.array(held[:, 1]))
    lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)
    columns = [pa.array([segment] * len(docs)), pa.array(docs.astype(np.int32)), lists(n_spans, spans), lists(np.unique(held[:, 0], return_counts=True)[1], names)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


def report(found: DataFrame) -> DataFrame:
    """The digest columns of `matches`."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def proximity(docs: DataFrame, queries: list[list[str]], within: int) -> DataFrame:
    """(doc_id, query, n): how often each list of words meets within so many words in each document that has it."""
    terms = sorted({w for q in queries for w in q})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                seg = Postings(row)
                first = seg.starts(within + 1)
                for k, q in enumerate(queries):
                    at = seg.near(q, within)
                    d, n = np.unique(np.searchsorted(first, at, side="right") - 1, return_counts=True)
                    if len(d):
                        yield pa.RecordBatch.from_arrays([pa.array([seg.docs[i] for i in d.tolist()], pa.int64()), pa.array([k] * len(d), pa.int32()), pa.array(n.astype(np.int64))], names=["doc_id", "query", "n"])

    return build_index(docs, terms, gap=within + 1).mapInArrow(run, "doc_id long, query int, n long")


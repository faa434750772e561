"""Ranked lexical search: exact top documents of every item by pruned inner products of impact vectors.

A document is a vector of impacts over terms, an item one of term weights, and a score their inner
product. Vectors are laid out by length, longest first, and read in buckets of neighbours. For an item
and the score that its best documents reach already,

* a bucket goes if the item's length times the longest vector's is less (Cauchy-Schwarz), or if the sum
  of its weights times the bucket's largest impact of each term is;
* inside, the item's heaviest terms are added up by the bucket's postings, the rest is bounded by
  Cauchy-Schwarz on what remains of both vectors, and documents under the bound go;
* survivors are scored again in 64-bit integers.

The longest vectors are searched first; the scores they reach are where the search of the others starts,
and vectors too short for any item are not read. Impacts are kept for the terms of one block of items
(BLOCK_PAIRS terms of items): with more, documents are read once a block.

Cases: null and empty texts have no terms, and neither count nor are found; rows of `items` with one id
(null too) are one item of all their terms; rows of documents with one id are documents of their own and
of equal scores null ids are last. Items without a match have no rows. Bounds are taken with a slack over
rounding and keep what ties, so that the result is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.llm.common import discard, durable, scratch

#: Documents of an item's result; terms of items in a block; documents and impacts of a bucket; share of vectors searched first.
TOP, BLOCK_PAIRS, BUCKET, BUCKET_IMPACTS, FIRST = 10, 500_000, 4_096, 1_000_000, 0.1
#: Share of an item's squared length that the terms hold which are added up before the bound; relative slack of bounds.
FOCUS, SLACK = 0.8, 1e-9

_KEPT = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
VECTOR = "doc_id long, length double, terms array<int>, impacts array<int>"
_FOUND = "item int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all that is not ASCII, in UTF-8, A-Z in lower case."""
    return text.encode().translate(_KEPT).split() if text else []


class Item:
    """An item's terms by falling weight, and the lengths that bounds need."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(-weights, kind="stable")
        self.terms, self.weights = terms[order], weights[order]
        rest = np.cumsum(np.square(self.weights[::-1].astype(float)))[::-1]
        self.length = math.sqrt(rest[0])
        self.focus = int(np.searchsorted(-rest, -(1 - FOCUS) * rest[0], side="left"))  # the first place from which on little is left
        self.rest = math.sqrt(rest[self.focus]) if self.focus < len(rest) else 0.0


class Bucket:
    """Vectors of like length: by document, and as postings by term."""

    def __init__(self, docs: np.ndarray, known: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.docs, self.known, self.terms, self.impacts = docs, known, terms, impacts
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        rows = np.repeat(np.arange(len(docs)), sizes)
        self.squares = np.bincount(rows, weights=np.square(impacts.astype(float)), minlength=len(docs))
        self.longest = math.sqrt(self.squares.max())
        order = np.argsort(terms, kind="stable")
        self.rows, self.posted = rows[order], impacts[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=n_terms))])
        self.top = np.zeros(n_terms, np.int64)
        present = np.flatnonzero(np.diff(self.first))
        self.top[present] = np.maximum.reduceat(self.posted, self.first[present])

    def search(self, item: Item, least: int, weight_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of all documents that can reach `least` (at least 1); `weight_of` is a zeroed array over terms."""
        heavy, w = item.terms[: item.focus], item.weights[: item.focus]
        sizes = self.first[heavy + 1] - self.first[heavy]
        at = _ranges(self.first[heavy], sizes)
        rows, impacts = self.rows[at], self.posted[at].astype(float)
        added = np.bincount(rows, weights=impacts * np.repeat(w, sizes), minlength=len(self.docs))
        left = self.squares - np.bincount(rows, weights=impacts * impacts, minlength=len(self.docs))
        most = added + item.rest * np.sqrt(np.maximum(left, 0.0) + SLACK * self.squares)
        kept = np.flatnonzero(most * (1 + SLACK) >= least)
        sizes = self.end[kept] - self.begin[kept]
        at = _ranges(self.begin[kept], sizes)
        weight_of[item.terms] = item.weights
        sums = np.concatenate([[0], np.cumsum(self.impacts[at] * weight_of[self.terms[at]])])
        weight_of[item.terms] = 0
        ends = np.cumsum(sizes)
        scores = sums[ends] - sums[ends - sizes]
        good = scores >= least
        return kept[good], scores[good]


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places from begin on, sizes many each, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Search:
    """The running best documents of every item over the buckets that a task reads."""

    def __init__(self, items: list[Item], least: np.ndarray, n_terms: int, top: int):
        self.items, self.least, self.top, self.n_terms = items, np.maximum(least, 1), top, n_terms
        self.lengths = np.array([i.length for i in items])
        self.terms, self.weights = np.concatenate([i.terms for i in items]), np.concatenate([i.weights for i in items])
        self.starts = np.cumsum([0, *(len(i.terms) for i in items[:-1])])
        self.weight_of = np.zeros(n_terms, np.int64)
        self.best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.looked = self.pruned = 0

    def add(self, bucket: Bucket) -> None:
        least = self.least / (1 + SLACK)
        alive = self.lengths * bucket.longest >= least
        alive &= np.add.reduceat(bucket.top[self.terms] * self.weights, self.starts) >= self.least
        self.looked += len(alive)
        self.pruned += int((~alive).sum())
        for i in np.flatnonzero(alive):
            rows, scores = bucket.search(self.items[i], int(self.least[i]), self.weight_of)
            if not len(rows):
                continue
            found = (scores, ~bucket.known[rows], bucket.docs[rows])
            if i in self.best:
                found = tuple(np.concatenate(x) for x in zip(self.best[i], found, strict=True))
            order = np.lexsort((found[2], found[1], -found[0]))[: self.top]
            self.best[i] = tuple(x[order] for x in found)
            if len(order) == self.top:
                self.least[i] = max(self.least[i], self.best[i][0][-1])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for i, (scores, unknown, docs) in self.best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), i, np.int32)), pa.array(docs, mask=unknown), pa.array(scores)], names=["item", "doc_id", "score"])


def buckets(batch: pa.RecordBatch, n_terms: int) -> Iterator[Bucket]:
    """The vectors of a batch in buckets of at most BUCKET documents and about BUCKET_IMPACTS impacts."""
    known = np.asarray(batch.column(0).is_valid())
    docs = batch.column(0).fill_null(0).to_numpy()
    offsets = batch.column(2).offsets.to_numpy().astype(np.int64)
    terms, impacts = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
    shift, at = int(batch.column(3).offsets[0].as_py()) - int(offsets[0]), 0
    while at < len(docs):
        end = min(at + BUCKET, max(at + 1, int(np.searchsorted(offsets, offsets[at] + BUCKET_IMPACTS, side="right")) - 1))
        span = slice(offsets[at], offsets[end])
        yield Bucket(docs[at:end], known[at:end], np.diff(offsets[at : end + 1]), terms[span].astype(np.int64), impacts[span.start + shift : span.stop + shift].astype(np.int64), n_terms)
        at = end


def _counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and of each term of the vocabulary the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wanted = Counter(), vocabulary.keys()
        for b in batches:
            for text in b.column(0):
                if words := terms_of(text.as_py()):
                    held[-1] += 1
                    held[-2] += len(words)
                    held.update(map(vocabulary.__getitem__, wanted & set(words)))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

    got = {r.term: r.n for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term of the block
    return got.get(-1, 0), got.get(-2, 0), np.array([got.get(i, 0) for i in range(len(vocabulary))], np.int64)


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], n_docs: int, n_words: int) -> DataFrame:
    """VECTOR of each document that holds a term of the vocabulary with an impact above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = terms_of(text.as_py())
                tf = Counter(map(number, words))
                tf.pop(None, None)
                if not tf:
                    continue
                m = 10 + 90 * len(words) * n_docs // n_words
                terms, often = np.fromiter(tf.keys(), np.int32, len(tf)), np.fromiter(tf.values(), np.int64, len(tf))
                impacts = 1_000_000_000 * often // (1000 * often + 8 * m)
                terms, impacts = terms[impacts > 0], impacts[impacts > 0]
                if len(terms):
                    rows.append((doc, math.sqrt(float(np.square(impacts.astype(float)).sum())), terms, impacts.astype(np.int32)))
            if rows:
                sizes = np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([r[k] for r in rows]))) for k in (2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), *lists], names=["doc_id", "length", "terms", "impacts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, VECTOR)


def _searched(laid_out: DataFrame, items: list[Item], least: np.ndarray, n_terms: int, top: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Search(items, least, n_terms, top)
        for b in batches:
            for bucket in buckets(b, n_terms):
                held.add(bucket)
        yield from held.rows()

    return laid_out.select("doc_id", "length", "terms", "impacts").mapInArrow(run, _FOUND)


def _of_block(docs: DataFrame, pairs: list, top: int) -> DataFrame | None:
    """item_id, doc_id, score of the best documents of one block of items: a few more than `top` of each; None without any."""
    spark = docs.sparkSession
    words = sorted({r.term.encode() for r in pairs})
    n_docs, n_words, df = _counts(docs, {t: i for i, t in enumerate(words)})
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)
    used = np.flatnonzero(weights > 0)
    if not len(used):
        return None
    vocabulary = {words[i]: k for k, i in enumerate(used)}
    weights = weights[used]
    of: dict[int | None, list[int]] = {}
    for r in pairs:
        if (k := vocabulary.get(r.term.encode())) is not None:
            of.setdefault(r.item_id, []).append(k)
    ids = list(of)
    items = [Item(np.array(sorted(of[i])), weights[sorted(of[i])]) for i in ids]

    path = scratch(spark, "impacts")
    found = vectors(docs, vocabulary, n_docs, n_words)
    # copies have one length: the id spreads them
    found.repartitionByRange(F.desc("length"), F.xxhash64("doc_id")).sortWithinPartitions(F.desc("length")).write.parquet(path)
    laid_out = spark.read.parquet(path)
    cut = laid_out.approxQuantile("length", [1 - FIRST], 0.01)
    if not cut:
        discard(spark, path)
        return None
    begun = durable(_searched(laid_out.where(F.col("length") >= cut[0]), items, np.ones(len(items), np.int64), len(used), top))
    reached = begun.select("item", "score", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))).alias("k")).where(F.col("k") == top)
    least = np.ones(len(items), np.int64)
    for r in reached.collect():  # a row an item of the block
        least[r.item] = r.score
    shortest = float((least / np.array([i.length for i in items])).min()) * (1 - SLACK)
    others = _searched(laid_out.where((F.col("length") < cut[0]) & (F.col("length") >= shortest)), items, least, len(used), top)
    names = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "item int, item_id long")
    held = durable(begun.unionByName(others).join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))  # a row an item of the block
    discard(spark, path)
    return held


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank int, doc_id, score long: of every item the `top` documents of highest score, equal ones by ascending doc_id."""
    spark = docs.sparkSession

    def distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0), b.column(1), strict=True):
                terms = [t.decode() for t in set(terms_of(text.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(terms), pa.int64()), pa.array(terms, pa.string())], names=["item_id", "term"])

    pairs = durable(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(distinct_terms, "item_id long, term string").distinct())
    blocks = -(-pairs.count() // block_pairs)
    found = None
    for k in range(blocks):
        part = _of_block(docs, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect(), top)
        found = part if found is None else found if part is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")

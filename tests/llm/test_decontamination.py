"""The whole index, blocks by windows, spans, and what one block takes in memory."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crestline.llm import decontamination as D
from test_queries import brute_windows


def docs_and_items(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.choice([3, 9, 10, 11, 25]))) for i in range(60)] + [(7, "w1 w2"), (None, ""), (8, None), (61, "W1, W2!")]
    docs = [(i, prose(rng.randint(0, 80)) + " " + rng.choice(items[:60])[1] + " " + prose(5)) for i in range(200)] + [(None, items[3][1]), (5, None), (5, items[4][1])]
    return docs, items, spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, at int, segment string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_hits_equal_brute_force_in_any_number_of_blocks(spark, monkeypatch):
    rows, pairs, docs, items = docs_and_items(spark)
    want = Counter(brute_windows(rows, pairs))
    for windows, segment in ((200_000, 400_000), (40, 100)):
        monkeypatch.setattr(D, "BLOCK_WINDOWS", windows)
        monkeypatch.setattr(D, "SEGMENT_WORDS", segment)
        assert Counter(tuple(r) for r in D.report(D.matches(docs, items)).collect()) == want


def test_the_index_holds_every_posting(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT_WORDS", 300)
    rows, _, docs, _ = docs_and_items(spark)
    index = D.build_index(docs)
    assert index.count() > 10
    got, want = Counter(), Counter()
    for row in index.collect():
        seg = D.Postings(row.asDict())
        first = seg.starts(D.WINDOW).tolist()
        for t in seg.range:
            for p in seg.of(t).tolist():
                d = max(i for i, f in enumerate(first) if f <= p)
                got[seg.docs[d], t, p - first[d]] += 1
    for i, text in rows:
        for k, w in enumerate(D.words_of(text)):
            want[i, w, k] += 1
    assert got == want


def test_windows_are_distinct_and_name_their_items(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, "A, b. C"), (3, " ".join(f"x{i}" for i in range(12))), (None, "a b c"), (4, None), (5, "!")], "item_id long, text string")
    got = {tuple(r.words): sorted(r["items"]) for r in D.windows(rows).collect()}
    assert got == {("a", "b", "c"): ["", "1", "2"], **{tuple(f"x{i}" for i in range(k, k + 10)): ["3"] for k in range(3)}}


def test_a_block_is_compact():
    """200,000 windows of ten words take some tens of MB: a matrix of numbers and one list of terms."""
    rng = random.Random(3)
    words = [[f"term{rng.randrange(40_000)}" for _ in range(10)] for _ in range(20_000)]
    block = D._Block(pa.table({"words": pa.array(words), "items": pa.array([[str(i), "x"] for i in range(20_000)])}), 10)
    assert block.phrases.nbytes + block.ids.nbytes + block.first.nbytes < 1_500_000 and len(block.terms) <= 40_000
    assert [block.terms[i] for i in block.phrases[77]] == words[77] and block.items_of(77) == ["77", "x"]


def test_an_empty_benchmark_and_hot_words(spark):
    docs = spark.createDataFrame([(i, "same " * 500 + str(i)) for i in range(50)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(docs, none).agg(F.sum("n_hit"), F.count("*")).first() == (0, 50)
    hot = spark.createDataFrame([(1, "same " * 30)], "item_id long, text string")
    assert D.matches(docs, hot).agg(F.sum("n_hit"), F.min("item_ids"), F.max("n_words")).first() == (25_000, ["1"], 501)


def segment_of(words):
    """An opened segment of one document."""
    held = D._Segment(None, D.WINDOW)
    held.add(1, " ".join(words))
    number = D.TaskContext
    D.TaskContext = type("Here", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)}))})
    try:
        return D.Postings(next(D._rows(held.row(0))))
    finally:
        D.TaskContext = number


def test_many_phrases_at_once_equal_one_after_another():
    rng = random.Random(12)
    words = [f"t{rng.randrange(12)}" for _ in range(3000)]
    seg = segment_of(words)
    phrases = [words[i : i + n] if rng.random() < 0.7 else [f"t{rng.randrange(12)}" for _ in range(n)] for i, n in ((rng.randrange(2900), rng.choice([1, 2, 3, 5, 10])) for _ in range(400))]
    lengths = np.array([len(p) for p in phrases])
    terms = np.zeros((len(phrases), 10), np.int64)
    for k, p in enumerate(phrases):
        terms[k, : len(p)] = [seg.range[t] for t in p]
    want = sorted((k, i) for k, p in enumerate(phrases) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p)
    for most in (2_000_000, 50):
        keep, D.CANDIDATES = D.CANDIDATES, most
        which, at = seg.phrases(terms, lengths)
        D.CANDIDATES = keep
        assert sorted(zip(which.tolist(), at.tolist(), strict=True)) == want
    one = [(k, i) for k, p in enumerate(phrases) for i in seg.phrase([(o, seg.range[t]) for o, t in sorted(enumerate(p), key=lambda x: seg.size[seg.range[x[1]]])]).tolist()]
    assert sorted(one) == want


def test_a_block_of_common_words_takes_little_time():
    """200,000 windows of words that a segment of 1.7 MB is full of: no loop over windows."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in np.minimum(rng.zipf(1.3, 400_000), 20_000).tolist()]
    seg = segment_of(words)
    number = np.array([seg.range[w] for w in words])
    common = number[np.argsort(-seg.size[number], kind="stable")[:380_000]]
    terms = rng.choice(common, (200_000, 10))
    terms[::100] = [number[i : i + 10] for i in range(0, 200_000, 100)]
    seg.term_at  # noqa: B018
    began = time.process_time()
    which, at = seg.phrases(terms, np.full(len(terms), 10))
    took = time.process_time() - began
    print("seconds", took, "candidates", int(seg.size[terms].min(axis=1).sum()), len(at))
    assert {k for k in range(0, 200_000, 100)} <= set(which.tolist()) and took < 10

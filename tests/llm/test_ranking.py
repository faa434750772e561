"""Ranked search against plain scoring of every document, and what is pruned."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from crestline.llm import queries, ranking

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    found = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    found = [x for x in found if x[2]]
    n_docs, n_words = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    terms = defaultdict(set)
    for i, t in items:
        terms[i].update(words(t))
    out = []
    for item, own in terms.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own}
        scores = [(sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // n_words))) for t in own if t in c), i) for i, c, n in found]
        best = sorted(((-s, i is None, i or 0) for s, i in scores if s > 0))[:top]
        out += [(item, k, None if null else i, -s) for k, (s, null, i) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs(nasty):
    return [(r.doc_id, r.text) for r in nasty.collect()]


def as_rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_op12_against_plain_scores(spark, written, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{written['nasty']}/benchmark.parquet").collect()]
    got = as_rows(queries.op12_ranked_search(spark, written["nasty"]))
    assert got == plain(docs, items) and len(got) > 10


def test_blocks_of_items_and_small_buckets_change_nothing(spark, nasty, docs, monkeypatch):
    items = [(i, docs[3 * i][1]) for i in range(12)] + [(1, "more terms"), (50, "zzzz unseen"), (51, None)]
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(ranking, "BUCKET", 5)
    assert as_rows(ranking.rank(nasty, table, block_pairs=150)) == plain(docs, items)
    assert as_rows(ranking.rank(nasty, table, top=3)) == plain(docs, items, top=3)


def test_no_documents_no_items_no_matches(spark, nasty, nothing):
    items = spark.createDataFrame([(1, "qqqqq zzzzz"), (2, "")], "item_id long, text string")
    assert ranking.rank(nasty, items).count() == ranking.rank(nothing, items).count() == ranking.rank(nasty, items.limit(0)).count() == 0


def _bucket(vectors, n_terms):
    sizes = np.array([len(v) for v in vectors])
    flat = [x for v in vectors for x in sorted(v.items())]
    return ranking.Bucket(np.arange(len(vectors)), np.ones(len(vectors), bool), sizes, np.array([t for t, _ in flat]), np.array([x for _, x in flat]), n_terms)


def test_bounds_lose_nothing_and_prune():
    """Random vectors by falling length: the running search gives the best by exact sums, ties at the end included."""
    rng = np.random.default_rng(5)
    n_terms, vectors = 60, []
    for k in range(3000):
        terms = rng.choice(n_terms, rng.integers(1, 12), replace=False)
        vectors.append({int(t): int(x) for t, x in zip(terms, rng.integers(1, 900_000 // (1 + k % 7 * 20), len(terms)), strict=True)})
    vectors += vectors[:40]
    order = sorted(range(len(vectors)), key=lambda i: -sum(x * x for x in vectors[i].values()))
    items = []
    for _ in range(20):
        terms = np.sort(rng.choice(n_terms, 6, replace=False))
        items.append(ranking.Item(terms, rng.integers(1, 9000, 6)))
    search = ranking.Search(items, np.ones(20, np.int64), n_terms, 10)
    for at in range(0, len(order), 64):
        rows = order[at : at + 64]
        bucket = _bucket([vectors[i] for i in rows], n_terms)
        bucket.docs = np.array(rows)
        search.add(bucket)
    for k, item in enumerate(items):
        w = dict(zip(item.terms.tolist(), item.weights.tolist(), strict=True))
        true = sorted((-sum(w.get(t, 0) * x for t, x in v.items()), i) for i, v in enumerate(vectors))[:10]
        assert list(zip((-search.best[k][0]).tolist(), search.best[k][2].tolist(), strict=True)) == true
    assert search.pruned > 0.5 * search.looked

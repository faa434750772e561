"""Null and repeated ids, hot nodes with a pivot, recall measured against brute force."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import brute_components

from crestline.llm import near_dedup as N


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def near_copies(rng, many, words=60):
    base = prose(rng, words)
    out = []
    for k in range(many):
        w = list(base)
        w[rng.randrange(words)] = f"new{k}"
        out.append(" ".join(w))
    return out


def plain(df, percent=85):
    return Counter(tuple(r) for r in N.near_duplicates(df, percent).collect())


def test_null_and_repeated_ids_cost_one_pass(spark, monkeypatch):
    """4,000 rows without an id and 4,000 with one id: whole sets are made once for each distinct text, and few of them."""
    rng = random.Random(1)
    texts = [t for _ in range(100) for t in near_copies(rng, 20)] + [" ".join(prose(rng, 40)) for _ in range(6000)]
    rng.shuffle(texts)
    rows = [(None if i % 2 else 7, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = []
    plain_sets = N.full_sets
    monkeypatch.setattr(N, "full_sets", lambda d, w: made.append((w.count(), (out := plain_sets(d, w)).count())) or out)
    got = N.near_duplicates(docs, 85).collect()
    assert len(got) == len(rows)
    assert made[0][0] == made[0][1] <= 2100  # a set for each wanted representative, no more
    plan = plain_sets(docs, spark.createDataFrame([(1, 7, 1, 1)], "row long, doc_id long, s1 long, s2 long"))._jdf.queryExecution().executedPlan().toString()
    assert "s1" in plan and "text" not in [x for line in plan.splitlines() if "Exchange" in line for x in line.replace(",", " ").split()]
    small = spark.createDataFrame(rows[:300], "doc_id long, text string")
    assert plain(small) == Counter(brute_components(rows[:300]))


def test_ids_beyond_the_bitmap_are_still_found(spark, monkeypatch):
    """A bitmap that is full of other ids only makes more sets."""
    monkeypatch.setattr(N, "MOST_BITS", 32_768)
    monkeypatch.setattr(N, "ID_BITS", 1)
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(t for _ in range(40) for t in near_copies(rng, 5))]
    assert plain(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == Counter(brute_components(rows))


@pytest.mark.parametrize("part", [10, 40])
def test_a_hot_node_is_linked_to_its_pivot_first(spark, monkeypatch, part):
    monkeypatch.setattr(N, "LEAF", 30)
    monkeypatch.setattr(N, "PART", part)
    rng = random.Random(3)
    hot = near_copies(rng, 150, 120)
    half = hot[0].split()
    cousins = [" ".join(half[:80] + prose(rng, 40)) for _ in range(20)]  # they share much, and are no links
    bridge = half[:60] + [f"b{k}" for k in range(12)] + half[72:]
    rows = [(i, t) for i, t in enumerate([*hot, *cousins, " ".join(bridge), *(" ".join(prose(rng, 30)) for _ in range(50))])]
    seen = []
    links = N._node_links
    monkeypatch.setattr(N, "_node_links", lambda *a: seen.append(1) or links(*a))
    assert plain(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == Counter(brute_components(rows))
    assert seen


def test_inverted_lists_equal_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sets = [np.unique(rng.integers(0, 60, rng.integers(5, 50)).astype(np.uint64)) for _ in range(20)]
        rows = rng.permutation(1000)[:20].tolist()
        link = {(i, j) for i in range(20) for j in range(20) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
        root = {r: r for r in rows}

        def find(r, root=root):
            while root[r] != r:
                r = root[r]
            return r

        for i, j in sorted(link):
            a, b = find(rows[i]), find(rows[j])
            root[max(a, b)] = min(a, b)
        got = N._roots(rows, sets, 60)
        assert dict(zip(*(x.tolist() for x in got), strict=True)) == {r: find(r) for r in rows}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the given tables are not here")
@pytest.mark.parametrize("percent", [85, 80])
def test_recall_of_links_in_the_given_documents(spark, percent):
    """Every link that all pairs give (by inverted lists of whole sets) lies within one group, and groups hold no others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    group = {r.doc_id: r.group for r in N.near_groups(docs, percent).collect()}
    sets = {r.doc_id: set(N.shingles(r.text).tolist()) for r in docs.collect()}
    lists, links = defaultdict(list), set()
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    common = Counter((a, b) for ids in lists.values() for k, a in enumerate(ids) for b in ids[:k])
    links = {(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)}
    found = sum(group[a] == group[b] for a, b in links)
    assert len(links) > 50 and found == len(links), (found, len(links))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    classes = defaultdict(set)
    for i in sets:
        if sets[i]:
            classes[group[i]].add(find(i))
    assert all(len(c) == 1 for c in classes.values())

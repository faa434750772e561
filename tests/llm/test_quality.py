"""The field over lines against sums over all labellings; quality of given and planted documents."""

import itertools
import math
import os
import random

import numpy as np
import pytest

from crestline.llm import quality, queries

DATA = "/root/testdata/sf0.01"


def brute(own, pair):
    """Each line's probability of being good by summing over all labellings."""
    total, good = 0.0, np.zeros(len(own))
    for labels in itertools.product((0, 1), repeat=len(own)):
        p = math.exp(sum(u * y for u, y in zip(own, labels, strict=True)) + sum(pair[a, b] for a, b in itertools.pairwise(labels)))
        total += p
        good += p * np.array(labels)
    return good / total


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 1, 7, 2, 7, 0])
    own, pair = rng.normal(0, 2, sizes.sum()), rng.normal(0, 1, (2, 2))
    up, down = quality.Chains(sizes).messages(own, pair)
    want = [brute(own[e - n : e], pair) for n, e in zip(sizes, np.cumsum(sizes), strict=True) if n]
    assert np.allclose(1 / (1 + np.exp(-(up + down))), np.concatenate(want))


def test_neighbouring_lines_count():
    model = quality.plain_model()
    model.near[0][quality.NAMES.index("odd")] = -20.0
    clean, junk = "A plain line of words that stand here.", "w### o$$$ r%%% d&&& s*** x###"
    after_junk, after_clean = (model.good(quality.line_features([x, clean]), np.array([2]))[1] for x in (junk, clean))
    assert after_junk < after_clean - 0.05


def test_quality_is_weighted_by_length():
    model = quality.plain_model()
    clean, junk = "A plain line of words that stand here and go on for long.", "#$ %& #$"
    few, many = model.qualities([f"{clean}\n{junk}", "\n".join([junk] * 9 + [clean[:12]])])
    assert few > 0.7 > 0.3 > many


def test_odd_texts_have_a_score(spark, nasty, written):
    got = queries.op11_quality(spark, written["nasty"]).collect()
    assert len(got) == nasty.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    empty = {r.score for r in got if r.doc_id in (300, 301, 302, 303)}
    assert len(empty) == 1


def test_one_class_of_labels_gives_the_fixed_weights(spark, nasty):
    one = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    model = quality.learn(nasty, one)
    assert (model.near == quality.plain_model().near).all()


def test_equal_texts_and_long_texts():
    model, line = quality.plain_model(), "some words in a line here."
    a, b, long = model.scores([line, line, "\n".join(f"{line} {i}" for i in range(50_000))])
    assert a == b and 0 <= long <= 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
def test_held_out_labels_and_planted_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in queries.op11_quality(spark, DATA).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 50 and sum(r.predicted == y for r, y in held) >= 0.97 * len(held)
    model = quality.learn(docs, labels)
    assert (model.pair[0, 0] + model.pair[1, 1] > model.pair[0, 1] + model.pair[1, 0]).all()  # neighbours agree
    rng = random.Random(2)
    clean = [r.text for r in docs.join(labels.where("quality = 1"), "doc_id").orderBy("doc_id").limit(40).collect()]
    spoiled = ["\n".join(" ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in line.split()) for line in t.split("\n")) for t in clean]
    assert np.mean(model.scores(clean) >= 0.3) >= 0.95 and np.mean(model.scores(spoiled) < 0.3) >= 0.95

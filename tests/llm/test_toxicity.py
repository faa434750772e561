"""The grammar: its composed table against the machines read apart, what the machines decide, learning by class, given labels."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.llm import toxicity as T

ORDER = (T.BARE, T.TARGETED, T.NEGATED, T.REPORTED, T.THREATENED, T.AFTER)


def apart(classes):
    """Kinds of match by the five machines, each read on its own over a clause."""
    machines = [T.insults(), T.threats(), T.targets(), T.negations(), T.reports()]
    states = [m.start for m in machines]
    for c in classes:
        marks = set()
        for i, m in enumerate(machines):
            states[i], mark = m.step(states[i], c)
            marks.add(mark)
        covered = T.REPORTED if "reported" in marks else T.NEGATED if "negated" in marks else None
        if "insult" in marks:
            yield covered if covered is not None else T.TARGETED if "aimed" in marks else T.BARE
        elif "threat!" in marks or {"threat", "aimed"} <= marks:
            yield covered if covered is not None else T.THREATENED
        else:
            yield T.AFTER if {"target", "near"} <= marks else -1


def test_the_composed_table_equals_the_machines_read_apart():
    rng = random.Random(2)
    nexts, outs = T.compose(T.insults(), T.threats(), T.targets(), T.negations(), T.reports())
    seen = set()
    for _ in range(3000):
        classes = [rng.randrange(T.END) for _ in range(rng.randint(1, 14))]
        state, got = 0, []
        for c in classes:
            got.append(outs[state][c])
            state = nexts[state][c]
        assert got == list(apart(classes))
        seen |= set(got)
    assert seen == {-1, *ORDER}


def test_matches_equal_a_plain_reading():
    rng = random.Random(3)
    words = "idiot vequabc you will kill not said plain words here . ! \" and".split()
    g = T.Grammar({"idiot": 1.0, "vequ*": 0.5}, {"mort*": 0.8})
    words += ["mortalia"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        want, clause = np.zeros(T.MATCHES + 1), []
        found = g.classes(text)
        want[T.MATCHES] = len(found)
        for c, w in [*found, (T.END, 0.0)]:
            if c != T.END:
                clause.append((c, w))
                continue
            for o, (_, weight) in zip(apart([k for k, _ in clause]), clause, strict=True):
                if o >= 0 and any(k in (T.INSULT, T.THREAT) for k, _ in found):
                    want[o] += weight or 1.0
            clause = []
        assert np.allclose(g.matches(text), want)


CLAUSES = {  # the same insults in clauses of other kinds
    "targeted": "you are an idiot . you are a moron",
    "bare": "here are an idiot . there are a moron",
    "negated": "not here an idiot . never there a moron",
    "reported": "said here an idiot . said there a moron",
}


@pytest.mark.parametrize("model", [T.Model({"idiot": 1.0, "moron": 1.0}, {}, T.ARCS, T.PLAIN)])
def test_the_machines_decide(model):
    score = dict(zip(CLAUSES, model.scores(list(CLAUSES.values())), strict=True))
    assert score["targeted"] > score["bare"] > 0.3 > score["negated"] and score["reported"] < 0.3
    # without the machines all four would be alike: they hold the same insults and as many words
    assert len({model.grammar().matches(t)[: T.MATCHES].sum() for t in CLAUSES.values()}) == 1
    assert model.scores(["i will kill you . we will hurt them"])[0] > 0.3 > model.scores(["rain and wind kill time . we will see them"])[0]
    assert model.scores(["", "idiot"])[0] == model.scores(["plain words"])[0] < 0.3 and model.scores(["an idiot"])[0] < 0.3


def test_what_is_fitted_keeps_the_grammars_order():
    rng = np.random.default_rng(5)
    sums = np.zeros((400, T.MATCHES + 1))
    sums[:, T.MATCHES] = 50
    y = (np.arange(400) % 4 == 0).astype(float)
    sums[y == 1, T.NEGATED] = rng.integers(1, 6, 100)  # labels that call negated insults toxic
    sums[200:, T.BARE] = y[200:] * 3
    arcs, weights = T.fit(sums, y, np.ones(400))
    assert all(low <= a <= high for a, (low, high) in zip(arcs, T.BOUNDS, strict=True)) and arcs[T.NEGATED] == 0.5 * arcs[T.BARE] and (weights[1:] >= 0).all()


@pytest.fixture(scope="module")
def threatening(spark):
    """Documents in which made-up words stand after words of intent, and others anywhere."""
    rng = random.Random(12)
    words = ["".join(rng.choice("bcdfgmnp") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        t = [rng.choice(words) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for k in rng.sample(range(2, 58), 3):
                t[k] = "zorq" + rng.choice(words)
                t[k - 2] = "will"
            for k in rng.sample([j for j in range(60) if not t[j].startswith(("zorq", "will"))], 3):
                t[k] = "wexk" + rng.choice(words)
        docs.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_stems_are_learned_by_class(threatening):
    model = T.learn(*threatening)
    assert any(k.startswith("zorq") for k in model.threats) and not any(k.startswith("wexk") for k in model.threats)
    assert any(k.startswith("wexk") for k in model.lexicon) and not any(k.startswith("zorq") for k in model.lexicon)


def test_repeated_ids_in_documents_and_labels(spark, threatening):
    """Each labelled doc_id counts once, however often it stands in either table; a label of 1 wins."""
    docs, labels = threatening
    many = docs.unionByName(docs.where("doc_id < 3").select("doc_id", F.lit("other text").alias("text")).crossJoin(spark.range(500)).drop("id"))
    twice = labels.unionByName(labels.where("doc_id < 50")).unionByName(spark.createDataFrame([(1, 1), (None, 1), (7, None), (8, 5)], "doc_id long, toxic int"))
    rows, counts = T.training_rows(many, twice)
    got = {r.doc_id: r.y for r in rows.collect()}
    assert rows.count() == len(got) == sum(counts.values())
    assert got[1] == 1 and all(got[i] == int(i % 5 == 0) for i in got if i != 1)


def test_columns_stay_and_empty_texts_score_alike(spark):
    model = T.Model({"idiot": 1.0}, {}, T.ARCS, T.PLAIN)
    df = spark.createDataFrame([(1, None, 3.0), (1, "", 4.0), (None, "plain", 5.0), (2, "idiot " * 100_000, 6.0)], "doc_id long, text string, x double")
    got = T.score(df, model).orderBy("x").collect()
    assert [r.x for r in got] == [3.0, 4.0, 5.0, 6.0] and got[0].score == got[1].score == got[2].score < 0.3 < got[3].score <= 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the given tables are not here")
def test_held_out_labels_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = T.learn(docs, labels)
    got = T.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(T.held_out(F.col("doc_id")))
    found = {(r.toxic, r.p): r.n for r in got.groupBy("toxic", (F.col("score") >= 0.3).alias("p")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = found[1, True] + found.get((1, False), 0), found[0, False] + found.get((0, True), 0)
    print(found, model.arcs, model.weights)
    assert toxic > 100 and found[1, True] >= 0.88 * toxic and found.get((0, True), 0) <= 0.005 * clean


def test_clause_scores_against_a_plain_reading():
    """Each clause's strength by arcs that match in the machines read apart; noisy-or and highest score of the document."""
    rng = random.Random(8)
    words = "idiot moron you will kill not said plain words here . ! \" and".split()
    model = T.Model({"idiot": 1.0, "moron": 0.5}, {}, T.ARCS, T.PLAIN)
    g = model.grammar()
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 50)))
        want, clause = [], []
        for c, w in [*g.classes(text), (T.END, 0.0)]:
            if c != T.END:
                clause.append((c, w))
                continue
            strength = sum(T.ARCS[o] * (weight or 1.0) for o, (_, weight) in zip(apart([k for k, _ in clause]), clause, strict=True) if o >= 0)
            if strength and any(k in (T.INSULT, T.THREAT) for k, _ in g.classes(text)):
                want.append(1 - np.exp(-T.RATE * strength**T.POWER))
            clause = []
        got = T.clause_scores(np.array(g.clauses(text)[0]).reshape(-1, T.MATCHES), T.ARCS)
        assert np.allclose(got, want)
        worth = -np.log(1 - (1 - np.prod(1 - np.array(want)))) / T.RATE
        x = np.array([1.0, np.log1p(worth), max(want, default=0.0), np.clip(worth - 1, 0, 1)])
        assert np.isclose(model.scores([text])[0], 1 / (1 + np.exp(-x @ T.PLAIN)))


def test_words_of_one_clause_count_more_than_apart():
    model = T.Model({"idiot": 1.0, "moron": 1.0}, {}, T.ARCS, T.PLAIN)
    together, spread = model.scores(["an idiot and a moron here . plain words there .", "an idiot here . plain words and a moron there ."])
    assert together > spread


def test_like_clauses_are_counted_once_in_the_fit():
    rng = np.random.default_rng(6)
    clauses, of = rng.random((60, T.MATCHES)), rng.integers(0, 20, 60)
    twice = T.features(T.clause_scores(np.repeat(clauses, 3, axis=0), T.ARCS), np.repeat(of, 3), 20)
    assert np.allclose(twice, T.features(T.clause_scores(clauses, T.ARCS), of, 20, np.full(60, 3)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the given tables are not here")
def test_planted_documents_with_the_same_words_in_other_clauses(spark, tmp_path):
    """Through the query itself, learned from given labels: who is insulted, and whether it is denied or reported, decides."""
    from crestline.llm import queries

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    planted = {10**9 + i: (k, f"{plain} {text} . {plain}") for i, (k, text, plain) in enumerate((k, t, p) for p in ("the words of a day", "some more of them here and there") for k, t in CLAUSES.items())}
    rows = spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, (_, t) in planted.items()], docs.schema)
    docs.unionByName(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, str(tmp_path)).where(F.col("doc_id") >= 10**9).collect()}
    for i in (0, 4):
        score = {planted[10**9 + i + k][0]: got[10**9 + i + k] for k in range(4)}
        assert score["targeted"].score > score["bare"].score > max(score["negated"].score, score["reported"].score)
        assert score["targeted"].predicted == 1 and score["negated"].predicted == score["reported"].predicted == 0

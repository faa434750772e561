"""Integer clustering against plain loops, with every odd vector."""

import hashlib
import math

import numpy as np
import pytest

from crestline.llm import centroids, queries


def plain(rows, count, rounds, width=64):
    """id, cluster, distance of each kept vector, the final centroids, by the definition."""
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest())[:count]
    held = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(held))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for k in range(len(held)):
            if own := [v for (_, v), c in zip(kept, of, strict=True) if c == k]:
                held[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, *near(v)[::-1]) for i, v in kept], held


@pytest.fixture(scope="module")
def vectors(spark, written):
    return spark.read.parquet(f"{written['nasty']}/embeddings.parquet")


def key(rows):
    return sorted(rows, key=str)


def check(got, rows, count, rounds):
    want, held = plain(rows, count, rounds)
    assert key((r.vec_id, r.cluster, r.distance) for r in got) == key(want)
    total = {c: sum(d for _, k, d in want if k == c) for c in range(count)}
    assert all(r.cluster_inertia == total[r.cluster] and r.inertia == sum(total.values()) for r in got)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, held[r.cluster])).encode()).hexdigest() for r in got)


def test_op13_against_plain_loops(spark, written, vectors):
    check(queries.op13_centroids(spark, written["nasty"]).collect(), [(r.vec_id, r.embedding) for r in vectors.collect()], 40, 5)


@pytest.mark.parametrize("most", [0, 100, 65_536])
def test_without_the_shared_dictionary_the_result_is_the_same(vectors, most):
    check(centroids.cluster(vectors, count=6, rounds=3, most=most).collect(), [(r.vec_id, r.embedding) for r in vectors.collect()], 6, 3)


def test_repeated_vectors_leave_later_centroids_empty(spark):
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(50)], "vec_id long, embedding array<double>")
    got = centroids.cluster(same).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 50


def test_tables_give_exact_distances_and_the_first_of_equal_centroids():
    rng = np.random.default_rng(3)
    for reach in (20, 1 << 15, 1 << 27):
        v, c = rng.integers(-reach, reach, (200, 5)), rng.integers(-reach, reach, (7, 5))
        c[4] = c[1]
        tables = centroids.Tables([np.unique(x) for x in v.T], c)
        cluster, distance = tables.nearest(v)
        true = ((v[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
        assert (cluster == true.astype(float).argmin(axis=1)).all() if reach < 1 << 20 else True
        assert [int(d) for d in distance] == [min(r) for r in true.tolist()] and 4 not in cluster


def test_rounds_shuffle_sums_and_not_vectors(spark, vectors):
    plan = centroids.quantised(vectors, "vec_id", "embedding")._jdf.queryExecution().toString()
    assert "Exchange" not in plan

"""mode_size collects distinct sizes only, and gives the groups of the plain rule."""

import random

from crestline.operators import clustering


def brute(sizes):
    groups = []
    for s in sizes:
        for g in groups:
            if s is not None and g[0] is not None and abs(g[0] - s) <= 5:
                g[1] += 1
                break
        else:
            groups.append([s, 1])
    return len(sizes), len(groups), next(g for g, n in groups if n == max(n for _, n in groups))


def test_mode_size_of_distinct_sizes(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, *range(60)]) if k else 7 + i % 3) for k in range(8) for i in range(20_000 if k == 0 else 5 * k)]
    rows += [(9, 0, None), (9, 1, 4), (9, 2, None)]
    df = spark.createDataFrame(rows, "g long, i long, s int").repartition(3)
    got = clustering.mode_size(df, "g", ["i"], "s")
    assert {r.g: tuple(r)[1:] for r in got.collect()} == {k: brute([s for g, _, s in rows if g == k]) for k in {r[0] for r in rows}}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2, plan

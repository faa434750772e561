"""Table functions in SQL text: their rows on odd input, and what they refuse."""

import pytest

from crestline.functions import tables
from crestline.operators import clustering


@pytest.fixture(scope="module")
def sql(spark):
    tables.register(spark)
    return spark


def test_shots_of_each_video(sql):
    rows = sql.createDataFrame([("a", 2, 9.0), ("a", 0, 1.0), ("a", 1, 1.5), ("a", 3, None), ("a", 4, 1.0), ("b", 0, 5.0), ("b", 1, 50.0)], "clip string, no int, v double")
    got = sql.sql("SELECT clip, no, shot_id FROM crestline_shots(TABLE(SELECT * FROM {t}) PARTITION BY clip ORDER BY (no), 'v', 2.0D)", t=rows)
    assert got.columns == ["clip", "no", "shot_id"]
    assert sorted(map(tuple, got.collect())) == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 1), ("b", 0, 0), ("b", 1, 1)]
    assert sql.sql("SELECT * FROM crestline_shots(TABLE(SELECT * FROM {t}) PARTITION BY clip ORDER BY (no), 'v', 2.0D)", t=rows.limit(0)).count() == 0


def test_size_groups_equal_the_operator(sql):
    rows = sql.createDataFrame([(k, i, s) for k, sizes in ((1, [7, 12, 13, 18, 7, 30]), (2, [10, 14, 19, 24]), (3, [5, None, 5, None])) for i, s in enumerate(sizes)], "k int, i int, s int")
    got = sql.sql("SELECT k, ord, g, n FROM crestline_size_groups(TABLE(SELECT * FROM {t}) PARTITION BY k ORDER BY (i), 'k', 's', 5)", t=rows).collect()
    assert sorted((r.k, r.ord, r.n) for r in got) == [(1, 0, 3), (1, 1, 2), (1, 2, 1), (2, 0, 2), (2, 1, 2), (3, 0, 2), (3, 1, 1), (3, 2, 1)]
    same = {r.k: (r.n_sizes, r.n_groups) for r in clustering.mode_size(rows, "k", ["i"], "s").collect()}
    assert same == {k: (sum(r.n for r in got if r.k == k), sum(r.k == k for r in got)) for k in (1, 2, 3)}


def test_segments_with_a_gap(sql):
    rows = sql.createDataFrame([("a", float(i), i, 0) for i in (*range(10), 30, 31, *range(50, 80))], "image string, along double, x int, y int")
    got = sql.sql("SELECT segment, x1, x2, n FROM crestline_segments(TABLE(SELECT * FROM {t}) PARTITION BY image ORDER BY (along, x, y), 'image', 'along', 5.0D, 6.0D)", t=rows).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 9, 10), (2, 50, 79, 30)]


@pytest.mark.parametrize("call, message", [
    ("crestline_shots(TABLE(SELECT 1 AS a) PARTITION BY (a), 'v', 2.0D)", "no column v"), ("crestline_shots(5, 'v', 2.0D)", "must be a table"),
    ("crestline_size_groups(TABLE(SELECT 1 AS a) PARTITION BY (a), 'b', 'a', 5)", "no column b"), ("crestline_shots(TABLE(SELECT 1 AS v) PARTITION BY (v), 'v', NULL)", "threshold must be a constant"),
])
def test_wrong_calls_say_what_is_wrong(sql, call, message):
    with pytest.raises(Exception, match=message):
        sql.sql(f"SELECT * FROM {call}").collect()

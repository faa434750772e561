"""What the findings of round 3 named, on small inputs that failed before."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument

from crestline import catalog
from crestline.functions import tables
from crestline.operators import denoise, features, frames

DATA = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@given
@pytest.mark.parametrize("name", ["endpoint_hits", "pixel_areas", "points_in_ellipse", "points_in_ellipse_grid", "feature_density"])
def test_points_pass_hashed_ellipses_and_are_not_broadcast(spark, name):
    text = plan(catalog.queries()[name](spark, DATA))
    assert re.search(r"ShuffledHashJoin.*Inner, BuildLeft", text) and not re.search(r"BroadcastHashJoin.*Inner", text)


def test_a_stated_longest_side_leaves_the_same_hits(spark):
    e = spark.createDataFrame([("i", k, 10.0 * k, 20.0, 5.0 + 20 * k, 30.0, 30.0 * k) for k in range(8)], "image_id string, ord int, cx double, cy double, w double, h double, angle double")
    p = spark.createDataFrame([("i", k, float(k % 60 - 2), float(k % 43)) for k in range(900)], "image_id string, k int, x double, y double")
    hits = lambda **more: {(r.ord, r.k) for r in features.hits(p, e, F.lit(51), F.lit(40), 8.0, **more).collect()}
    assert hits(largest=51) == hits(largest=8) == hits() and hits()


def test_numbers_are_rounded_by_their_binary_value(spark):
    rng = random.Random(6)
    numbers = [0.52245, 0.62915, 0.57365, 0.03125, 0.09375, 0.00005, 0.00015, -0.00001, -2.00005, 0.99995, 0.0, 7.0, 123456789.12345, 3e10, *[round(rng.random(), 6) for _ in range(2000)], *[k / 20000 for k in range(1, 4000, 2)], *[k / 32 for k in range(99)]]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", frames.fixed(F.col("x")).alias("text")).collect()
    assert all(r.text == f"{r.x:.4f}" for r in got), [(r.x, r.text) for r in got if r.text != f"{r.x:.4f}"][:5]
    assert [r[0] for r in spark.sql("SELECT explode(array(CAST(NULL AS DOUBLE), double('nan'))) AS x").select(frames.fixed(F.col("x"))).collect()] == ["null", "NaN"]


def same_as_sql(spark, name):
    sql = duckdb.connect()
    for t in ("part", "lineitem", "events", "embeddings"):
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM '{LARGER}/{t}.parquet'")
    want = sql.sql(catalog.ORACLES[name]).df()
    got = catalog.queries()[name](spark, LARGER).toPandas()[list(want.columns)]
    rows = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
    assert rows(got) == rows(want) and len(got)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["selected_outputs", "committed_files"])
def test_sidecars_equal_sql_on_more_frames(spark, name):
    same_as_sql(spark, name)


@given
@pytest.mark.parametrize("name", ["denoised_frames", "prepared_frames"])
def test_shifts_of_frames_are_not_shuffled(spark, name):
    df = catalog.queries()[name](spark, DATA)
    assert not re.search(r"hashpartitioning\([^\n]*\b(dx|dy|sx|sy)#", plan(df))


def test_tiles_leave_no_seams(spark, monkeypatch):
    rng = random.Random(7)
    pixels = spark.createDataFrame([(k, x, y, rng.randrange(256)) for k in range(2) for x in range(13) for y in range(11)], "k int, x int, y int, v int")
    done = lambda: sorted(map(tuple, denoise.denoised(pixels, "k", 13, 11, 60.0, 3, 5).collect()))
    whole = done()
    for tile in (1, 4, 11):
        monkeypatch.setattr(denoise, "TILE", tile)
        assert done() == whole and len(whole) == 286


def test_size_groups_take_key_and_size_to_python(spark):
    table = AnalyzeArgument(StructType.fromDDL("k int, at string, size double"), None, True, False)
    constant = lambda value: AnalyzeArgument(None, value, False, True)
    found = tables.SizeGroups.analyze(table, constant("k"), constant("size"), constant(5))
    assert [c.name for c in found.select] == ["`k`", "`size`"]
    tables.register(spark)
    rows = spark.createDataFrame([(1, "a", 9.0), (1, "c", 16.0), (1, "b", 12.0), (1, "d", None)], "`a k` int, at string, `its ``size` double")
    got = spark.sql("SELECT * FROM crestline_size_groups(TABLE(SELECT * FROM {t}) PARTITION BY `a k` ORDER BY (at), 'a k', 'its `size', 5)", t=rows)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 9, 2), (1, 1, 16, 1), (1, 2, None, 1)]

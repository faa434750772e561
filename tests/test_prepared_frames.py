"""Prepared frames: what is shuffled for them, and their rows against SQL on more frames."""

import os
import re

import duckdb
import pytest

from crestline import catalog
from crestline.operators import equalise

DATA = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@given
def test_frames_are_dealt_out_before_they_become_pixels(spark):
    text = plan(catalog.queries()["prepared_frames"](spark, DATA))
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    # the same exchange for histograms and for pixels, the labels, and the videos' windows
    assert dealt and all(re.fullmatch(r"(vec_id|label)#\d+L?, \d+", keys) for keys in dealt)
    assert "REPARTITION_BY_NUM" in text and "Broadcast" not in text


def test_maps_of_tiles_are_not_repeated(spark):
    pixels = spark.createDataFrame([(k, x, y, (7 * x + 31 * y * k) % 256) for k in range(3) for x in range(6) for y in range(6)], "k int, x int, y int, v int")
    text = plan(equalise.equalised(pixels, "k", 6, 6, (2, 2), 40.0))
    joined = text[: text.rindex("SortMergeJoin")] if "SortMergeJoin" in text else ""
    assert joined.count("Join") == 0 and len(re.findall(r"SortMergeJoin \[k#", text)) == 1
    assert not re.search(r"hashpartitioning\([^\n]*cell_", text)


def test_maps_hold_between_values_and_where_none_are(spark):
    # one value, the least and the greatest, and a tile whose first value is late
    rows = [(0, x, y, 200) for x in range(4) for y in range(4)] + [(1, x, y, 255 * (x % 2)) for x in range(4) for y in range(4)] + [(2, x, y, 128 + 4 * x + y) for x in range(4) for y in range(4)]
    maps = {r.k: r.map for r in equalise.tile_maps(spark.createDataFrame(rows, "k int, x int, y int, v int"), "k", 4, 4, (1, 1), 0.0).collect()}
    for k, m in maps.items():
        values = [v for i, _, _, v in rows if i == k]
        assert list(m) == [round(255 * sum(v <= i for v in values) / 16) for i in range(256)]


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["equalised_frames", "prepared_frames"])
def test_rows_equal_sql_on_more_frames(spark, name):
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{LARGER}/embeddings.parquet'")
    want = sql.sql(catalog.ORACLES[name]).df()
    got = catalog.queries()[name](spark, LARGER).toPandas()[list(want.columns)]
    rows = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
    assert rows(got) == rows(want) and len(got)

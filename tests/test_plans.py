"""The plans that scale: one exchange on the video, group limits, pruned scans, no Python in the relational core."""

import os
import re

import pytest

from crestline import catalog, catalog_sql

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["representative_frames", "shot_topk", "shot_ranges", "sample_then_select"])
def test_one_exchange_on_the_video(spark, name):
    text = plan(catalog.queries()[name](spark, DATA))
    assert len(re.findall(r"\bExchange hashpartitioning", text)) <= (2 if name == "shot_ranges" else 1)
    assert "SinglePartition" not in text


def test_top_k_is_limited_before_ranking(spark):
    assert "WindowGroupLimit" in plan(catalog.queries()["representative_frames"](spark, DATA))


#: A Python data source, and functions that are called from SQL: those are Python by their nature.
CALLED = {"scanned_frames", *catalog_sql.SAME_AS}


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - CALLED))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(catalog.queries()[name](spark, DATA))
    assert not re.search(r"Python|Arrow|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_scans_read_only_what_is_used(spark):
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", plan(catalog.queries()["shot_topk"](spark, DATA)))
    assert schemas and all("props" not in s and "event_type" not in s for s in schemas)
    filters = plan(catalog.queries()["points_in_ellipse"](spark, DATA))
    assert "p_name" not in " ".join(re.findall(r"ReadSchema: (struct<[^\n]*>)", filters))

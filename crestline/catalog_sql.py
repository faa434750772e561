"""Registered queries written as SQL text over the ordered table functions; their rows are those of the DataFrame operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from crestline.catalog_pixels import _edge_pixels, line_votes
from crestline.functions import tables
from crestline.session import table

SHOTS = """SELECT user_id, shot_id, start_no, coalesce(lead(start_no) OVER (PARTITION BY user_id ORDER BY shot_id), last_no + 1) AS end_no
FROM (SELECT user_id, shot_id, min(src_frame_no) AS start_no, max(src_frame_no) AS last_no
  FROM crestline_shots(TABLE(SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1L AS src_frame_no FROM {events})
    PARTITION BY user_id ORDER BY (src_frame_no), 'value', {cut}) GROUP BY user_id, shot_id)"""
SIZES = """SELECT l_orderkey, CAST(sum(n) AS INT) AS n_sizes, CAST(count(*) AS INT) AS n_groups, max_by(g, struct(n, -ord)) AS mode_size
FROM crestline_size_groups(TABLE(SELECT * FROM {items}) PARTITION BY l_orderkey ORDER BY ({order}), 'l_orderkey', 'l_quantity', 5) GROUP BY l_orderkey"""
SEGMENTS = """SELECT image_id, segment, x1, y1, x2, y2, n
FROM crestline_segments(TABLE(SELECT image_id, theta, rho, x, y, round(y * cos(radians(theta)) - x * sin(radians(theta)), 6) AS along
  FROM {points} JOIN {lines} USING (image_id) WHERE floor(x * cos(radians(theta)) + y * sin(radians(theta)) + 0.5D + 1e-7D) = rho)
    PARTITION BY (image_id, theta, rho) ORDER BY (along, x, y), 'image_id, theta, rho', 'along', 5.0D, 6.0D)"""


def sql_shot_ranges(spark, root):
    from crestline.catalog import EVENT_CUT

    tables.register(spark)
    return spark.sql(SHOTS, events=table(spark, root, "events"), cut=float(EVENT_CUT))


def sql_mode_size(spark, root):
    from crestline.catalog import _ORDER

    tables.register(spark)
    items = table(spark, root, "lineitem").select("l_orderkey", *_ORDER, "l_quantity")
    # of rows that are equal in all columns of the order the size is equal, too
    return spark.sql(SIZES.replace("{order}", ", ".join([*_ORDER, "l_quantity"])), items=items)


def sql_line_segments(spark, root):
    tables.register(spark)
    return spark.sql(SEGMENTS, points=_edge_pixels(spark, root), lines=line_votes(spark, root).select("image_id", F.col("theta").cast("double").alias("theta"), "rho"))


def queries() -> dict:
    return {"sql_shot_ranges": sql_shot_ranges, "sql_mode_size": sql_mode_size, "sql_line_segments": sql_line_segments}


#: The SQL that each must agree with is that of the query whose rows it gives.
SAME_AS = {"sql_shot_ranges": "shot_ranges", "sql_mode_size": "mode_size", "sql_line_segments": "line_segments"}

"""Windows in blocks give what windows over whole videos give, also for null videos, gaps and ties."""

import random

from pyspark.sql import functions as F

from crestline.operators import frames


def test_blocks_equal_whole_videos(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i * rng.choice([1, 3]), i, rng.choice([None, 1.0, 5.0, 9.0])) for i in range(1500)]
    df = spark.createDataFrame(rows, "video string, at long, id long, v double").repartition(5)
    block, order = F.floor(F.col("at") / 100), ["at", "id"]
    change = lambda lag: F.abs(F.col("v") - lag("v"))

    def every(number, differences, shots):
        x = number(df, "video", order, "no")
        x = differences(x, "video", ["no"], change)
        return sorted(map(str, shots(x, "video", ["no"], F.col("diff"), 3.0).select("video", "at", "id", "no", "diff", "shot_id").collect()))

    whole = every(frames.number, frames.differences, frames.shots)
    cut = every(
        lambda d, v, o, out: frames.blocked_number(d, v, o, block, out),
        lambda d, v, o, diff: frames.blocked_differences(d, v, o, block, ["v"], diff),
        lambda d, v, o, c, t: frames.blocked_shots(d, v, o, block, c, t),
    )
    assert whole == cut and len(whole) == 1500


def test_no_window_holds_a_whole_video(spark):
    df = spark.range(1000).select(F.lit("hot").alias("video"), "id", (F.col("id") % 7).cast("double").alias("v"))
    block = F.floor(F.col("id") / 50)
    plan = frames.blocked_shots(df, "video", ["id"], block, F.col("v"), 3.0)._jdf.queryExecution().optimizedPlan().toString()
    heads = [line for line in plan.splitlines() if "Window [" in line]
    assert len(heads) == 2 and sum("__block" in line.rsplit("], [", 2)[1] for line in heads) >= 1
    assert "Aggregate" in plan  # the other window runs over a row for each block

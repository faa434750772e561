"""Live shots by event time: any split into triggers, in any order within the delay, gives what a batch gives."""

import random
from datetime import datetime, timedelta

import pytest

from crestline.streaming.shots import live_shots_by_time

START = datetime(2024, 1, 1)
SCHEMA = "clip string, no long, v double, at timestamp"


def frames():
    rng = random.Random(3)
    rows = []
    for clip, n in (("a", 40), ("b", 25), ("c", 1)):
        level = 0.0
        for i in range(n):
            level = rng.uniform(0, 100) if rng.random() < 0.2 else level + rng.uniform(-1, 1)
            rows.append((clip, i, level, START + timedelta(seconds=i)))
    return rows


def batch(rows, threshold):
    out = []
    for clip in {r[0] for r in rows}:
        shot, before = 0, None
        for _, no, v, _ in sorted((r for r in rows if r[0] == clip), key=lambda r: (r[3], r[1])):
            shot += before is not None and abs(v - before) > threshold
            before = v
            out.append((clip, no, shot))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_into_triggers_gives_the_batch_result(spark, tmp_path, seed):
    rng, rows = random.Random(seed), frames()
    want = batch(rows, 5.0)
    rows += rng.sample(rows, 5)  # some come twice
    late = sorted(rows, key=lambda r: (r[3] + timedelta(seconds=rng.uniform(0, 9)), r[0]))  # out of order, by less than the delay
    cuts = sorted(rng.sample(range(1, len(late)), 4))
    parts = [late[i:j] for i, j in zip([0, *cuts], [*cuts, len(late)], strict=True)]
    parts += [[("end", 0, 0.0, START + timedelta(hours=1)), (None, 3, 1.0, START)], [("end", 1, 0.0, START + timedelta(hours=2))]]  # the watermark moves on
    src, told = str(tmp_path / "in"), str(tmp_path / "told")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = live_shots_by_time(spark.readStream.schema(SCHEMA).parquet(src), "clip", "no", "v", "at", 5.0, "10 seconds")
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(told)
        assert q.awaitTermination(120)
    got = sorted((r.clip, r.frame_no, r.shot_id) for r in spark.read.parquet(told).collect() if r.clip != "end")
    assert got == want and len({s for c, _, s in got if c == "a"}) > 3

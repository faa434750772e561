"""Fixed capacities over many bays, and groups that are hot by their rows."""

import random

from pyspark.sql import functions as F

from crestline.llm import sharding


def test_capacity_over_many_bays(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BAY_GROUPS", 40)
    rng = random.Random(1)
    rows = [(g, rng.randint(1, 50)) for g in range(1000)] + [(2000, 500), (2001, 260)]
    got = sharding.shard_groups(spark.createDataFrame(rows, "g long, b long"), ["g"], "b", capacity=250)
    loads = {r.shard: (r.b, r.n) for r in got.groupBy("shard").agg(F.sum("b").alias("b"), F.count("*").alias("n")).collect()}
    assert got.count() == len(rows) and sorted(loads) == list(range(len(loads)))
    assert all(b <= 250 or n == 1 for b, n in loads.values())  # a group over the capacity is alone
    total = sum(b for _, b in rows) - 760
    assert len(loads) - 2 <= 1.1 * -(-total // 250)
    assert sum(2 * b <= 250 for b, _ in loads.values()) <= 1  # what bays left over was put together


def test_even_shards_over_many_bays(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BAY_GROUPS", 100)
    rng = random.Random(2)
    rows = [(g, rng.randint(1, 400)) for g in range(5000)]
    got = sharding.shard_groups(spark.createDataFrame(rows, "g long, b long"), ["g"], "b", shards=16)
    loads = [r.b for r in got.groupBy("shard").agg(F.sum("b").alias("b")).collect()]
    assert len(loads) == 16 and max(loads) - min(loads) <= 0.01 * max(loads)


def test_a_group_hot_by_rows_is_not_shuffled(spark):
    """A third of all rows has no text: they are one group of few bytes and many rows."""
    texts = [None] * 3000 + [f"text {i} " * 20 for i in range(6000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen = []
    plain = sharding.F.broadcast
    sharding.F.broadcast, got = (lambda df: seen.append(df.columns and df.count()) or plain(df)), None
    try:
        got = sharding.shard_texts(docs, 16)
        assert got.count() == 9000
    finally:
        sharding.F.broadcast = plain
    assert max(seen) < 2 * sharding.HOT
    empty = got.where("size = 1")
    assert empty.count() == 3000 and empty.select("shard").distinct().count() == 1
    for r in got.groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("n"), F.count("*").alias("m")).collect():
        assert r.a == 0 and r.b == r.m - 1 and r.n == r.m

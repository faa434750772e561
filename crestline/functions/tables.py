"""Ordered table functions for SQL text: register(spark), then SELECT * FROM crestline_shots(TABLE(t) PARTITION BY video ORDER BY (no), 'value', 0.3).

Each takes a table that is partitioned and ordered in the call, reads a partition's rows one after another and keeps
a few numbers of it (of size groups: the groups); the DataFrame operators of the same names give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SelectedColumn


def _table(rows: AnalyzeArgument, *columns: str) -> StructType:
    if not rows.isTable:
        raise ValueError("the first argument must be a table: TABLE(...) PARTITION BY ... ORDER BY ...")
    missing = [c for c in columns if c not in rows.dataType.fieldNames()]
    if missing:
        raise ValueError(f"the table has no column {missing[0]}; it has {', '.join(rows.dataType.fieldNames())}")
    return rows.dataType


def _constant(argument: AnalyzeArgument, name: str):
    if not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} must be a constant")
    return argument.value


def _only(*columns: str) -> list[SelectedColumn]:
    """Of the table's rows these columns alone go to Python; it stays ordered by any."""
    return [SelectedColumn("`" + c.replace("`", "``") + "`") for c in dict.fromkeys(columns)]


def _names(argument: AnalyzeArgument, name: str) -> list[str]:
    return [c.strip() for c in str(_constant(argument, name)).split(",")]


class Shots:
    """crestline_shots(TABLE(frames) PARTITION BY video ORDER BY (no), value column, threshold): the frames with shot_id."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, value: AnalyzeArgument, threshold: AnalyzeArgument) -> AnalyzeResult:
        _constant(threshold, "the threshold")
        kept = _table(rows, _constant(value, "the value column"))
        return AnalyzeResult(StructType([*kept.fields, StructField("shot_id", LongType())]))

    def __init__(self):
        self.before, self.shot = None, 0

    def eval(self, rows: Row, value: str, threshold: float) -> Iterator[tuple]:
        now = rows[value]
        if now is not None and self.before is not None and abs(now - self.before) > threshold:
            self.shot += 1
        self.before = now
        yield (*rows, self.shot)


class SizeGroups:
    """crestline_size_groups(TABLE(sizes) PARTITION BY (keys) ORDER BY (...), 'keys', size column, tolerance): keys, ord, g (first size), n (count)."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, keys: AnalyzeArgument, size: AnalyzeArgument, tolerance: AnalyzeArgument) -> AnalyzeResult:
        _constant(tolerance, "the tolerance")
        named = _names(keys, "the keys")
        kept = _table(rows, *named, _constant(size, "the size column"))
        own = [StructField("ord", IntegerType()), StructField("g", IntegerType()), StructField("n", LongType())]
        return AnalyzeResult(StructType([*[kept[k] for k in named], *own]), select=_only(*named, size.value))

    def __init__(self):
        self.key, self.groups = None, []

    def eval(self, rows: Row, keys: str, size: str, tolerance: int) -> None:
        if self.key is None:
            self.key = tuple(rows[k.strip()] for k in keys.split(","))
            self.at = rows.__fields__.index(size)
        now = rows[self.at]
        if now is not None:
            now = int(now)
            for g in self.groups:
                if g[0] is not None and -tolerance <= g[0] - now <= tolerance:
                    g[1] += 1
                    return
        self.groups.append([now, 1])

    def terminate(self) -> Iterator[tuple]:
        for i, (g, n) in enumerate(self.groups):
            yield (*self.key, i, g, n)


class Segments:
    """crestline_segments(TABLE(points) PARTITION BY (keys) ORDER BY (along, x, y), 'keys', along column, least length, gap): keys, segment, x1, y1, x2, y2, n."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, keys: AnalyzeArgument, along: AnalyzeArgument, least: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        _constant(least, "the least length")
        _constant(gap, "the gap")
        named = _names(keys, "the keys")
        kept = _table(rows, *named, _constant(along, "the along column"), "x", "y")
        ends = [StructField(f"{c}{k}", kept[c].dataType) for k in (1, 2) for c in "xy"]
        return AnalyzeResult(StructType([*[kept[k] for k in named], StructField("segment", IntegerType()), *ends, StructField("n", LongType())]))

    def __init__(self):
        self.key, self.segment, self.least = None, 0, math.inf
        self.first = self.last = None
        self.n = 0

    def _told(self) -> Iterator[tuple]:
        if self.first is not None and self.last[0] - self.first[0] >= self.least:
            yield (*self.key, self.segment, *self.first[1:], *self.last[1:], self.n)

    def eval(self, rows: Row, keys: str, along: str, least: float, gap: float) -> Iterator[tuple]:
        if self.key is None:
            self.key, self.least = tuple(rows[k.strip()] for k in keys.split(",")), least
        now = (rows[along], rows["x"], rows["y"])
        if self.last is not None and now[0] - self.last[0] > gap:
            yield from self._told()
            self.segment, self.first, self.n = self.segment + 1, None, 0
        self.first, self.last, self.n = self.first or now, now, self.n + 1

    def terminate(self) -> Iterator[tuple]:
        yield from self._told()


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    from pyspark.sql.functions import udtf

    for name, kind in (("crestline_shots", Shots), ("crestline_size_groups", SizeGroups), ("crestline_segments", Segments)):
        spark.udtf.register(name, udtf(kind))

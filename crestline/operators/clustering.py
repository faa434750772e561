"""First-fit grouping of sizes within a tolerance, its mode, and the filter by it.

The grouping depends on the order of its input, so it folds over an ordered array: one row per
group (an image's keypoints), never over a whole table. It depends only on the distinct sizes in
the order of their first occurrence, as equal sizes all join one group; so those are what is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GROUPS = "array<struct<g:int,n:bigint>>"


def size_groups(sizes: Column, tolerance: int = 5) -> Column:
    """Ordered groups (g: first size, n: count): a size joins the first group within the tolerance, or founds one."""
    return _counted_groups(F.transform(sizes, lambda x: F.struct(x.alias("s"), F.lit(1).cast("long").alias("n"))), tolerance)


def _counted_groups(sizes: Column, tolerance: int) -> Column:
    """The same of distinct sizes (s, n: how often)."""

    def fold(groups: Column, s: Column) -> Column:
        near = F.transform(groups, lambda x: F.abs(x["g"] - s["s"]) <= tolerance)
        at = F.array_position(near, True).cast("int")
        grown = F.transform(groups, lambda x, i: F.struct(x["g"].alias("g"), (x["n"] + F.when(i == at - 1, s["n"]).otherwise(0)).alias("n")))
        new = F.concat(groups, F.array(F.struct(s["s"].alias("g"), s["n"].alias("n"))))
        return F.when(at > 0, grown).otherwise(new).cast(_GROUPS)

    return F.aggregate(sizes, F.array().cast(_GROUPS), fold)


def mode(groups: Column) -> Column:
    """The size of the largest group, the first of equals; null if there is none."""
    top = F.array_max(F.transform(groups, lambda x: x["n"]))
    return F.when(F.size(groups) > 0, F.element_at(F.filter(groups, lambda x: x["n"] == top), 1)["g"])


def mode_size(sizes: DataFrame, group: str, order: list[str], size: str, tolerance: int = 5) -> DataFrame:
    """group, n_sizes, n_groups, mode_size."""
    found = sizes.select(group, F.struct(*order).alias("__at"), F.col(size).cast("int").alias("__s"))
    found = found.groupBy(group, "__s").agg(F.min("__at").alias("__at"), F.count("*").alias("__n"))
    # every null size founds a group of its own: one is listed, the others are counted
    own = F.when(F.col("__s").isNull(), 1).otherwise(F.col("__n")).cast("long")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__s", own.alias("__m")))), lambda x: F.struct(x["__s"].alias("s"), x["__m"].alias("n")))
    folded = found.groupBy(group).agg(listed.alias("__sizes"), F.sum("__n").cast("int").alias("n_sizes"), F.sum(F.col("__n") - own).cast("int").alias("__more"))
    folded = folded.withColumn("__groups", _counted_groups(F.col("__sizes"), tolerance))
    return folded.select(group, "n_sizes", (F.size("__groups") + F.col("__more")).cast("int").alias("n_groups"), mode(F.col("__groups")).alias("mode_size"))


def near_target(rows: DataFrame, size: Column, target: Column, tolerance: int = 5) -> DataFrame:
    """Rows whose size is within the tolerance of the target; all where there is none."""
    return rows.where(target.isNull() | (F.abs(size - target) <= tolerance))

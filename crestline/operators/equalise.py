"""Local histogram equalisation of frames, as relations over pixels.

A frame is cut into tiles. Of each tile the histogram is clipped, what was clipped is dealt to all values, and
the cumulative histogram maps values to new ones; a pixel takes the maps of the four tiles around it, weighted by how
near their middles are. Pixels are only counted and then joined with their frame's maps: those are one row a frame of
256 numbers a tile, and are not repeated. All keys begin with the frame, so that pixels which lie by frame stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of a pixel.
VALUES = 256


def _padded(c: Column, size: int, whole: int) -> Column:
    """The places that a pixel's column or row has in the frame once it is mirrored up to `whole`."""
    mirrored = 2 * (size - 1) - c
    return F.array_compact(F.array(c, F.when((mirrored >= size) & (mirrored < whole), mirrored)))


def tile_maps(pixels: DataFrame, image: str, width: int, height: int, tiles: tuple[int, int], limit: float) -> DataFrame:
    """image, tx, ty, map: the 256 new values of each tile. Frames are mirrored at the right and below so that tiles are equal."""
    across, down = -(-width // tiles[0]), -(-height // tiles[1])
    area = across * down
    most = max(int(limit * area / VALUES), 1) if limit > 0 else area
    whole = pixels.select(image, "v", F.explode(_padded(F.col("x"), width, across * tiles[0])).alias("px"), "y").select(image, "v", "px", F.explode(_padded(F.col("y"), height, down * tiles[1])).alias("py"))
    counted = whole.groupBy(image, F.floor(F.col("px") / across).cast("int").alias("tx"), F.floor(F.col("py") / down).cast("int").alias("ty"), "v").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy(image, "tx", "ty").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counted.select("*", F.sum(F.least("n", F.lit(most))).over(so_far).alias("sum"))
    cut = summed.groupBy(image, "tx", "ty").agg(F.sum(F.greatest(F.col("n") - most, F.lit(0))).alias("over"), F.array_sort(F.collect_list(F.struct("v", "sum"))).alias("steps"))
    each, rest = F.floor(F.col("over") / VALUES), F.col("over") % VALUES
    step = F.greatest(F.floor(VALUES / F.greatest(rest, F.lit(1))), F.lit(1))
    # a sum holds up to the next value that occurs
    until = lambda i: F.least(F.get("steps", i + 1)["v"], F.lit(VALUES))
    runs = F.transform("steps", lambda s, i: F.array_repeat(s["sum"], until(i) - s["v"]))
    sums = F.concat(F.array_repeat(F.lit(0).cast("long"), F.least(F.get("steps", F.lit(0))["v"], F.lit(VALUES))), F.flatten(runs))
    # of the rest every step-th value gets one
    dealt = lambda i: each * (i + 1) + F.least(F.floor(i / step) + 1, rest)
    new = F.transform(sums, lambda s, i: F.least(F.rint((s + dealt(i)) * (255.0 / area)), F.lit(255.0)).cast("int"))
    return cut.select(image, "tx", "ty", new.alias("map"))


def equalised(pixels: DataFrame, image: str, width: int, height: int, tiles: tuple[int, int] = (8, 8), limit: float = 2.0) -> DataFrame:
    """pixels (image, x, y, v in 0..255) with `equalised`; frames have one size and all their pixels.

    `limit` is how many times the mean of a histogram a value may have, 0 for no limit.
    """
    across, down = -(-width // tiles[0]), -(-height // tiles[1])
    maps = tile_maps(pixels, image, width, height, tiles, limit)

    held = maps.groupBy(image).agg(F.map_from_entries(F.collect_list(F.struct((F.col("ty") * tiles[0] + F.col("tx")).alias("k"), "map"))).alias("held"))
    listed = held.select(image, F.transform(F.sequence(F.lit(0), F.lit(tiles[0] * tiles[1] - 1)), lambda k: F.try_element_at("held", k)).alias("maps"))
    fx, fy = F.col("x") / F.lit(float(across)) - 0.5, F.col("y") / F.lit(float(down)) - 0.5
    placed = pixels.select("*", F.floor(fx).cast("int").alias("tx"), F.floor(fy).cast("int").alias("ty"), (fx - F.floor(fx)).alias("ax"), (fy - F.floor(fy)).alias("ay"))
    # beyond the middles of outer tiles these stand for both
    tile = lambda t, n: F.least(F.greatest(t, F.lit(0)), F.lit(n - 1))
    m = lambda right, below: F.element_at(F.get("maps", tile(F.col("ty") + below, tiles[1]) * tiles[0] + tile(F.col("tx") + right, tiles[0])), F.col("v") + 1)
    ax, ay = F.col("ax"), F.col("ay")
    value = (m(0, 0) * (1 - ax) + m(1, 0) * ax) * (1 - ay) + (m(0, 1) * (1 - ax) + m(1, 1) * ax) * ay
    return placed.join(listed.hint("merge"), image).select(*pixels.columns, F.rint(value).cast("int").alias("equalised"))

"""Relational image operators: thresholds, corners, lines and contours from tables of pixels and points.

Each works on keys of an image, with aggregation before anything is ordered, so that an image's
pixels never meet in one task but for the windows named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.operators.components import components
from crestline.session import durable


def otsu(pixels: DataFrame, image: str, value: str) -> DataFrame:
    """image, threshold: of each image's pixels the value (0..255) that separates two classes best; those over it are the bright ones.

    Pixels are counted by value first; the window runs over at most 256 values an image. One value alone gives 0.
    """
    counts = pixels.groupBy(image, value).agg(F.count("*").alias("n"))
    so_far = Window.partitionBy(image).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(image)
    mass = F.col("n") * F.col(value)
    c = counts.select(image, value, F.sum("n").over(so_far).alias("below"), F.sum(mass).over(so_far).alias("mass"), F.sum("n").over(whole).alias("total"), F.sum(mass).over(whole).alias("all_mass"))
    apart = F.pow(F.col("all_mass").cast("double") * F.col("below") / F.col("total") - F.col("mass"), F.lit(2.0)) / (F.col("below") * (F.col("total") - F.col("below")))
    c = c.withColumn("apart", F.when(F.col("below") < F.col("total"), apart).otherwise(0.0))
    best = c.groupBy(image).agg(F.max(F.struct(F.col("apart"), (-F.col(value)).alias("v"))).alias("best"))
    return best.select(image, F.when(F.col("best.apart") > 0, -F.col("best.v")).otherwise(0).cast("int").alias("threshold"))


def local_maxima(scores: DataFrame, image: str, threshold: float) -> DataFrame:
    """Rows (image, x, y, score) whose score is over the threshold and over those of all eight neighbours: one equi-join with shifted copies."""
    high = scores.where(F.col("score") > threshold)
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    around = high.select(image, F.explode(shifts).alias("s"), "x", "y", "score").select(image, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), F.col("score").alias("near"))
    most = around.groupBy(image, "x", "y").agg(F.max("near").alias("near"))
    return high.join(most, [image, "x", "y"], "left").where(F.col("near").isNull() | (F.col("score") > F.col("near"))).drop("near")


def edges(maxima: DataFrame, image: str, low: float, high: float) -> DataFrame:
    """image, x, y of edge pixels: gradient maxima (image, x, y, size) over `high`, and those over `low` that touch an edge pixel, directly or by others.

    Pixels over `low` that touch are one component, found in rounds that grow with the logarithm of a chain; components with a strong pixel stay.
    """
    weak = durable(maxima.where(F.col("size") > low).groupBy(image, "x", "y").agg((F.max("size") > high).alias("strong")).withColumn("a", F.col("y").cast("long") * (1 << 32) + F.col("x")))
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))])
    near = weak.select(image, "a", F.explode(shifts).alias("s")).select(image, "a", (F.col("a") + F.col("s.dy").cast("long") * (1 << 32) + F.col("s.dx")).alias("b"))
    touching = near.join(weak.select(image, F.col("a").alias("b")), [image, "b"])
    roots = components(touching, image).withColumnRenamed("node", "a")
    rooted = weak.join(roots, [image, "a"], "left").withColumn("root", F.coalesce("root", "a"))
    kept = rooted.where("strong").select(image, "root").distinct()
    return rooted.join(kept, [image, "root"], "left_semi").select(image, "x", "y")


def line_votes(points: DataFrame, image: str, angles: int = 180) -> DataFrame:
    """image, theta, rho, votes: how many points (x, y) lie on each line, by whole degrees of its normal and whole pixels from the origin.

    Every point votes once for each angle; votes are added up before the shuffle, so that what moves is bounded by lines, not points.
    """
    t = F.radians(F.col("theta").cast("double"))
    voted = points.select(image, "x", "y", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("theta"))
    # halves go up, with room for the last bits of sines
    rho = F.floor(F.col("x") * F.cos(t) + F.col("y") * F.sin(t) + 0.5 + 1e-7).cast("int")
    return voted.select(image, "theta", rho.alias("rho")).groupBy(image, "theta", "rho").agg(F.count("*").alias("votes"))


def best_line(votes: DataFrame, image: str, threshold: int = 1) -> DataFrame:
    """The line of each image with most votes, of equals the one with the least angle, then the least distance."""
    order = F.struct("votes", (-F.col("theta")).alias("t"), (-F.col("rho")).alias("r"))
    top = votes.where(F.col("votes") >= threshold).groupBy(image).agg(F.max(order).alias("top"))
    return top.select(image, (-F.col("top.t")).alias("theta"), (-F.col("top.r")).alias("rho"), F.col("top.votes").alias("votes"))


def _on_line(x: Column, y: Column, theta: Column, rho: Column) -> Column:
    t = F.radians(theta.cast("double"))
    return F.floor(x * F.cos(t) + y * F.sin(t) + 0.5 + 1e-7) == rho


def many_lines(points: DataFrame, image: str, least: int, most: int, angles: int = 180) -> tuple[DataFrame, DataFrame]:
    """(image, line, theta, rho, votes) and (image, line, x, y): up to `most` lines of each image with `least` votes or more, and the points of each.

    The line with most votes takes its points away, whose votes are subtracted from those of all lines; then the next is
    the best of what is left. All images go on together: a round costs the votes of the points that were taken, and lines that
    fell below `least` are forgotten. Repeated points count once.
    """
    left = durable(points.select(image, "x", "y").distinct())
    votes = durable(line_votes(left, image, angles).where(F.col("votes") >= least))
    peaks, taken = [], []
    for n in range(most):
        peak = durable(best_line(votes, image, least).select(image, F.lit(n).alias("line"), "theta", "rho", "votes"))
        if peak.isEmpty():
            break
        on = left.join(peak, image).where(_on_line(F.col("x"), F.col("y"), F.col("theta"), F.col("rho")))
        gone = durable(on.select(image, "line", "x", "y"))
        peaks.append(peak)
        taken.append(gone)
        if n + 1 < most:
            left = durable(left.join(gone, [image, "x", "y"], "left_anti"))
            back = line_votes(gone, image, angles).withColumn("votes", -F.col("votes")).join(votes.select(image, "theta", "rho"), [image, "theta", "rho"], "left_semi")
            votes = durable(votes.unionByName(back).groupBy(image, "theta", "rho").agg(F.sum("votes").alias("votes")).where(F.col("votes") >= least))
    none = best_line(votes, image).select(image, F.lit(0).alias("line"), "theta", "rho", "votes").where("false")
    lines, owned = none, left.select(image, F.lit(0).alias("line"), "x", "y").where("false")
    for peak, gone in zip(peaks, taken, strict=True):
        lines, owned = lines.unionByName(peak), owned.unionByName(gone)
    return lines, owned


def _runs(on: DataFrame, keys: list[str], least: float, gap: float) -> DataFrame:
    """keys, segment, x1, y1, x2, y2, n: runs of the points (theta, x, y) of each line without a gap, of the least length or more."""
    t = F.radians(F.col("theta").cast("double"))
    along = F.round(F.col("y") * F.cos(t) - F.col("x") * F.sin(t), 6)
    w = Window.partitionBy(*keys).orderBy("along", "x", "y")
    cut = on.withColumn("along", along).withColumn("cut", F.coalesce((F.col("along") - F.lag("along").over(w) > gap).cast("int"), F.lit(0)))
    named = cut.withColumn("segment", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    place = F.struct("along", "x", "y")
    runs = named.groupBy(*keys, "segment").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n"))
    runs = runs.where(F.col("b.along") - F.col("a.along") >= least)
    return runs.select(*keys, "segment", *[F.col(f"{e}.{c}").alias(f"{c}{k}") for k, e in ((1, "a"), (2, "b")) for c in ("x", "y")], "n")


def line_segments(points: DataFrame, lines: DataFrame, image: str, least: float = 20.0, gap: float = 10.0) -> DataFrame:
    """image, theta, rho, segment, x1, y1, x2, y2, n: runs of points on each line without a gap, of the least length or more.

    Points of one line meet in a window, those of an image do not.
    """
    on = points.join(lines.select(image, "theta", "rho"), image).where(_on_line(F.col("x"), F.col("y"), F.col("theta"), F.col("rho")))
    return _runs(on, [image, "theta", "rho"], least, gap)


def owned_segments(owned: DataFrame, lines: DataFrame, image: str, least: float = 20.0, gap: float = 10.0) -> DataFrame:
    """The same of what many_lines() gives, each point on the line that took it: image, line, theta, rho, segment, x1, y1, x2, y2, n."""
    return _runs(owned.join(lines.select(image, "line", "theta", "rho"), [image, "line"]), [image, "line", "theta", "rho"], least, gap)


def contour_measures(points: DataFrame, image: str, contour: str, order: str) -> DataFrame:
    """image, contour, n_points, area, perimeter of closed contours, given as points (x, y) in order."""
    w = Window.partitionBy(image, contour).orderBy(order)
    first = Window.partitionBy(image, contour).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(first))
    sides = points.select(image, contour, (F.col("x") * after("y") - F.col("y") * after("x")).alias("cross"), F.hypot(after("x") - F.col("x"), after("y") - F.col("y")).alias("side"))
    return sides.groupBy(image, contour).agg(F.count("*").alias("n_points"), (F.abs(F.sum("cross")) / 2).alias("area"), F.sum("side").alias("perimeter"))


def largest_contour(measured: DataFrame, image: str, contour: str) -> DataFrame:
    """Of each image the contour with the greatest area, the first of equals."""
    w = Window.partitionBy(image).orderBy(F.desc("area"), contour)
    return measured.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")


def round_enough(circularity: Column, failed: Column, least: Column | float) -> Column:
    """Whether a keypoint stays: its roundness reaches the bound (inclusive), or failed to compute; one without area or outline goes."""
    return F.coalesce(failed, F.lit(False)) | F.coalesce(circularity >= least, F.lit(False))


def sheet_cells(steps: DataFrame, step: str, width: Column, height: Column, columns: int = 4, cell_w: int = 400, cell_h: int = 300) -> DataFrame:
    """Where each step's picture lies on the sheet: cell row and column, its corner, and its scaled size."""
    from crestline.functions.geometry import fit_scale

    scale = fit_scale(width, height, cell_w, cell_h)
    row, column = F.floor(F.col(step) / columns).cast("int"), (F.col(step) % columns).cast("int")
    return steps.select("*", row.alias("cell_row"), column.alias("cell_column"), (column * cell_w).alias("x0"), (row * cell_h).alias("y0"), F.floor(width * scale).cast("int").alias("shown_w"), F.floor(height * scale).cast("int").alias("shown_h"))

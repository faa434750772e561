"""The registered query of the whole chain on prepared frames: equalise, denoise, sharpen, measure, cut into shots, keep the best."""

from __future__ import annotations

from pyspark.sql import functions as F

from crestline.catalog_contours import LIMIT, ORACLES, STRENGTH
from crestline.catalog_pixels import _F, SIZE, _filtered, _frames
from crestline.functions import quality as Q
from crestline.functions import rasters as R
from crestline.operators import frames
from crestline.plans.preparing import prepared

#: Mean difference of prepared frames from which on a shot begins.
SHOT = 135.0


def prepared_frames(spark, root):
    raw = _frames(spark, root)
    # a merge, since the planner takes prepared frames for small and would broadcast them
    ready = prepared(raw.select("vec_id", "v"), "vec_id", SIZE, SIZE, (2, 2), LIMIT, STRENGTH, 3, 5).join(raw.select("label", "vec_id").hint("merge"), "vec_id")
    ready = ready.select("label", "vec_id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    v = F.col("v")
    parts = (Q.variance(Q.laplacian(v, SIZE, SIZE)), Q.mean(v), F.sqrt(Q.variance(v)), Q.focus(v, SIZE, SIZE))
    measured = ready.withColumn("quality", Q.score(*parts, Q.Caps()))
    changed = frames.differences(measured, "label", ["vec_id"], lambda lag: Q.mean_abs_diff(v, lag("v")))
    framed = frames.shots(changed, "label", ["vec_id"], F.col("diff"), SHOT)
    picked = frames.best(framed, "label", "shot_id", F.round("quality", 9), ["vec_id"])
    return picked.select("label", "shot_id", "rank", "vec_id", F.round("quality", 6).alias("quality"))


def _pixels_of(name: str, source: str, value: str) -> str:
    """The pixels (vec_id, i, z) of another query's SQL, of the frames in `source`."""
    body = ORACLES[name].replace(_F, f"f AS (SELECT label, vec_id, v FROM {source})")
    return body[: body.rindex("SELECT vec_id, sum(")] + value


def oracle(measures: str, shots: str, best: str) -> str:
    """`measures` (from px on), `shots` and `best` are the CTEs of plain frames."""
    listed = "SELECT label, vec_id, list(z::INT ORDER BY i) AS v FROM ({0}) p JOIN {1} USING (vec_id) GROUP BY label, vec_id"
    even = _pixels_of("equalised_frames", "a1", "SELECT vec_id, i, round_even(z, 0) AS z FROM e")
    calm = _pixels_of("denoised_frames", "a2", "SELECT vec_id, i, round_even(sum(k * other) / sum(k), 0) AS z FROM w WHERE k >= 0.001 GROUP BY 1, 2")
    caps = measures.replace("sharpness/0.5,", "sharpness/500.0,").replace("brightness/0.05,", "brightness/128.0,").replace("contrast/0.2,", "contrast/50.0,").replace("focus/0.5,", "focus/1000.0,")
    return f"""WITH {_F.replace("f AS (", "a1 AS MATERIALIZED (", 1)}, a2 AS MATERIALIZED ({listed.format(even, "a1")}), a3 AS MATERIALIZED ({listed.format(calm, "a2")}),
        a4 AS (SELECT label, vec_id, {_filtered(R.SHARPEN_FRAME)} AS v FROM a3), e AS (SELECT label, vec_id, [x::DOUBLE for x in v] AS v FROM a4),
        {caps}, {shots.replace("diff > 0.155", f"diff > {SHOT}")}, {best} SELECT label, shot_id, rank, vec_id, quality FROM rep"""


def queries() -> dict:
    return {"prepared_frames": prepared_frames}

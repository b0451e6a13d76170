"""Colour detection on pixel tables: calibration of a video's first frames, masks, closing, regions, candidates.

Pixels have ``video_id``, ``frame_id``, ``y``, ``x`` and ``h``, ``s``, ``v``. Everything per pixel is an expression or a window over
one row or column; from regions on there is a row per box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.operators import candidates, frames, pixels

KEYS = ["video_id", "frame_id"]
#: Fixed limits of hue, saturation and value: a colour's ranges, both ends included.
DEFAULT = {
    "white": (((0, 0, 180), (180, 30, 255)),),
    "red": (((0, 80, 80), (8, 255, 255)), ((172, 80, 80), (180, 255, 255))),
    "yellow": (((22, 100, 200), (34, 255, 255)),),
}
#: The bit of each colour in a pixel's mask.
COLORS = {color: 1 << k for k, color in enumerate(DEFAULT)}


def ranked_frames(px: DataFrame) -> DataFrame:
    """Frames of each video with their place, from 1."""
    place = F.row_number().over(W.partitionBy("video_id").orderBy("frame_id"))
    return px.select(*KEYS).distinct().withColumn("frame_rank", place)


def _since(px: DataFrame, first: int) -> DataFrame:
    """The ``first``-th frame of every video that has so many: one row a video, so pixels need no join by frame."""
    return ranked_frames(px).where(F.col("frame_rank") == first).select("video_id", F.col("frame_id").alias("_since"))


def calibrated(px: DataFrame, first: int = 5) -> DataFrame:
    """Colour limits of every video that has ``first`` frames, from the mean of these."""
    ranked = px.join(F.broadcast(_since(px, first)), "video_id").where(F.col("frame_id") <= F.col("_since"))
    return frames.hsv_limits(frames.mean_pixels(ranked), ["video_id"])


def _within(ranges: tuple) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | frames.in_range(F.col("h"), F.col("s"), F.col("v"), low, high)
    return out


def masks(px: DataFrame, limits: DataFrame | None = None, first: int = 5) -> DataFrame:
    """Pixels with a ``mask`` that has one bit for each of ``COLORS``. ``limits``, a row of a few numbers a video, hold from a video's
    ``first``-th frame on; before that, and without limits, the fixed ones do."""
    tests = {color: _within(ranges) for color, ranges in DEFAULT.items()}
    if limits is not None:
        own_from = limits.join(_since(px, first), "video_id")
        px = px.where(F.col("frame_id").isNotNull() & F.col("video_id").isNotNull()).join(F.broadcast(own_from), "video_id", "left")
        h, s, v, c = F.col("h"), F.col("s"), F.col("v"), F.col
        own = {
            "white": s.between(c("white_s_low"), c("white_s_high")) & v.between(c("white_v_low"), c("white_v_high")),
            "red": (h.between(0, 10) | h.between(170, 180)) & (s >= c("red_s_low")) & (v >= 50),
            "yellow": h.between(20, 35) & (s >= c("yellow_s_low")) & (v >= c("yellow_v_low")),
        }
        use = (c("frame_id") >= c("_since")) & c("white_v_low").isNotNull()
        tests = {color: F.when(use, own[color]).otherwise(test) for color, test in tests.items()}
    bits = (F.when(tests[color], bit).otherwise(0) for color, bit in COLORS.items())
    return px.select(*KEYS, "y", "x", sum(bits, F.lit(0)).alias("mask"))


def boxes(colored: DataFrame, size: int = 7, **limits: float) -> DataFrame:
    """Boxes of the masks' regions, closed by a square of ``size``, of a plausible size and shape; in page order."""
    keys = (*KEYS, "color")
    whole = pixels.closed(colored, "mask", size, tuple(KEYS), (F.bit_or, F.bit_and)).where("mask > 0")
    each = F.explode(F.array_compact(F.array(*(F.when(F.col("mask").bitwiseAND(bit) > 0, color) for color, bit in COLORS.items()))))
    found = pixels.regions(whole.select(*KEYS, "y", "x", each.alias("color"), "mask"), "mask", keys)
    found = candidates.sized(found.select(*keys, *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))), **limits)
    order = F.row_number().over(W.partitionBy(*KEYS).orderBy("color", "y1", "x1", "y2", "x2")) - 1
    return found.withColumn("det_ord", order)


def detect(px: DataFrame, calibrate: bool = True, first: int = 5, size: int = 7, radius: float = 150, threshold: float = 0.2, **limits: float) -> DataFrame:
    """Candidates of every frame, from its pixels, after suppression."""
    colored = masks(px, calibrated(px, first) if calibrate else None, first)
    return candidates.detect(boxes(colored, size, **limits), KEYS, radius, threshold)

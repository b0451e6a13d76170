"""Frame-level operators: sampling, limits, colour calibration and density of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def sampled(frames: DataFrame, skip: int = 3) -> DataFrame:
    """Every ``skip``-th frame; frames count from 1."""
    return frames.where(F.col("frame_id") % skip == 0)


def limited(frames: DataFrame, seconds: float, fps: float) -> DataFrame:
    """Frames of the first ``seconds``; all when the rate is unknown."""
    return frames.where(F.col("frame_id") <= int(seconds * fps)) if fps else frames


def reliable_lines(lines: DataFrame, least: float = 0.5) -> DataFrame:
    return lines.where(F.col("conf") >= least)


def first_variant(lines: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Of each crop the reliable lines of its first image variant that has any."""
    good = reliable_lines(lines, least)
    return good.join(good.groupBy(*keys).agg(F.min("variant").alias("variant")), [*keys, "variant"], "left_semi")


def reference_pixels(pixels: DataFrame, frames: int = 5) -> DataFrame:
    """Mean of each pixel's s and v over a video's first frames, cut to whole numbers."""
    return mean_pixels(pixels.where(F.col("frame_rank") <= frames))


def mean_pixels(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("video_id", "x", "y").agg(*(F.avg(c).cast("int").alias(c) for c in ("s", "v")))


def mean_color(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean b, g and r of each crop's pixels."""
    return pixels.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in ("b", "g", "r")))


def hsv_limits(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Colour limits from exact percentiles of saturation and value."""
    p = lambda c, q: F.percentile(c, F.lit(q))
    whole = lambda c: c.cast("int")
    v_high = F.least(F.col("v95"), F.lit(255.0))
    q = pixels.groupBy(*keys).agg(p("v", 0.05).alias("v05"), p("v", 0.95).alias("v95"), *(p("s", x / 100).alias(f"s{x}") for x in (10, 20, 30, 90)))
    return q.select(
        *keys, whole(F.col("s10")).alias("white_s_low"), whole(F.greatest(F.col("v05"), F.lit(30.0))).alias("white_v_low"),
        whole(F.least(F.col("s90"), F.lit(60.0))).alias("white_s_high"), whole(v_high).alias("white_v_high"),
        F.greatest(F.lit(30), whole(F.col("s20"))).alias("red_s_low"), F.greatest(F.lit(40), whole(F.col("s30"))).alias("yellow_s_low"),
        F.greatest(F.lit(120), whole(v_high * 0.6)).alias("yellow_v_low"),
    )


def in_range(h: Column, s: Column, v: Column, lower: tuple[int, int, int], upper: tuple[int, int, int]) -> Column:
    """Whether a pixel is within inclusive limits."""
    return h.between(lower[0], upper[0]) & s.between(lower[1], upper[1]) & v.between(lower[2], upper[2])


def target_confidence(counts: DataFrame, base: float = 0.5, low_limit: float = 0.25, high_limit: float = 0.7, window: int = 30, density_low: float = 3, density_high: float = 12) -> DataFrame:
    """Per frame the median of the last ``window`` counts and the confidence aimed at (null for the first four frames)."""
    by = W.partitionBy("video_id").orderBy("frame_id")
    last = by.rowsBetween(-(window - 1), 0)
    out = counts.withColumn("median", F.percentile("n", F.lit(0.5)).over(last)).withColumn("_k", F.row_number().over(by))
    aim = F.when(F.col("median") < density_low, max(low_limit, base - 0.15)).when(F.col("median") > density_high, min(high_limit, base + 0.15)).otherwise(base)
    return out.withColumn("target", F.when(F.col("_k") >= 5, aim)).drop("_k")


def smoothed(targets: DataFrame, base: float = 0.5, keep: float = 0.7) -> DataFrame:
    """Final confidence of each video: targets in frame order, each moving it by ``1 - keep``.

    The fold is linear, so it is a sum of targets with weights that fall with the frames after them.
    """
    after = F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("frame_id"))) - 1
    weighted = targets.where("target is not null").withColumn("_w", F.pow(F.lit(keep), after))
    last = F.lit(base) * F.pow(F.lit(keep), F.count("*")) + F.sum(F.col("target") * (1 - keep) * F.col("_w"))
    return weighted.groupBy("video_id").agg(F.count("*").cast("int").alias("steps"), last.alias("confidence"))


def frame_rate(df: DataFrame, video: str, frame: str, at: str, every: int = 10) -> DataFrame:
    """Every ``every``-th processed frame of a video, with the number of ``frames`` so far, the seconds ``elapsed`` since
    its first one was done (``at``), and frames ``per_second``, 0 while no time has passed."""
    so_far = W.partitionBy(video).orderBy(frame).rowsBetween(W.unboundedPreceding, 0)
    counted = df.select(video, frame, F.count("*").over(so_far).alias("frames"), (F.col(at) - F.min(at).over(so_far)).cast("double").alias("elapsed"))
    rate = F.when(F.col("elapsed") > 0, F.col("frames") / F.col("elapsed")).otherwise(F.lit(0.0))
    return counted.where(F.col("frames") % every == 0).withColumn("per_second", rate)

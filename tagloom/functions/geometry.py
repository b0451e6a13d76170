"""Box geometry as column expressions. A box is anything with fields x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def box(prefix: str = "") -> Column:
    """The columns x1, y1, x2, y2 (with a prefix) as one struct."""
    return F.struct(*(F.col(f"{prefix}{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(zero, w) * F.greatest(zero, h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 for boxes that only touch."""
    common = intersection(a, b)
    return common / (area(a) + area(b) - common + EPS)


def center_distance(a: Column, b: Column) -> Column:
    """Distance of the centres, in units of the mean of both widths and heights."""
    dx = (a["x1"] + a["x2"]) / 2 - (b["x1"] + b["x2"]) / 2
    dy = (a["y1"] + a["y2"]) / 2 - (b["y1"] + b["y2"]) / 2
    size = (a["x2"] - a["x1"] + a["y2"] - a["y1"] + b["x2"] - b["x1"] + b["y2"] - b["y1"]) / 4
    return F.sqrt(dx * dx + dy * dy) / (size + EPS)


def area_ratio(a: Column, b: Column) -> Column:
    """The smaller area over the larger."""
    return F.least(area(a), area(b)) / (F.greatest(area(a), area(b)) + EPS)


def match_score(a: Column, b: Column, distance: float, ratio: float) -> Column:
    """How well two boxes match, -1 when too far apart or too different in size."""
    d, r = center_distance(a, b), area_ratio(a, b)
    return F.when((d > distance) | (r < ratio), F.lit(-1.0)).otherwise(r * (1 - d / distance))


def expand_crop(b: Column, frame_w: Column, frame_h: Column, factor: int | None = None) -> Column:
    """``b`` padded by at least 64 pixels a side, kept within the frame, as whole numbers."""
    factor = factor or 2
    side = F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"])
    pad = F.greatest(F.lit(64), (side * (factor - 1) / 2).cast("int"))
    whole = lambda c, name: c.cast("int").alias(name)
    return F.struct(
        whole(F.greatest(F.lit(0.0), b["x1"] - pad), "x1"), whole(F.greatest(F.lit(0.0), b["y1"] - pad), "y1"),
        whole(F.least(frame_w.cast("double"), b["x2"] + pad), "x2"), whole(F.least(frame_h.cast("double"), b["y2"] + pad), "y2"),
    )


def from_center(cx: Column, cy: Column, w: Column, h: Column, scale_x: Column, scale_y: Column, frame_w: Column, frame_h: Column) -> Column:
    """Corners of a centre box, rescaled, truncated and clipped to the frame."""
    clip = lambda v, top, name: F.least(F.greatest(v.cast("int"), F.lit(0)), top.cast("int")).alias(name)
    return F.struct(
        clip((cx - w / 2) * scale_x, frame_w, "x1"), clip((cy - h / 2) * scale_y, frame_h, "y1"),
        clip((cx + w / 2) * scale_x, frame_w, "x2"), clip((cy + h / 2) * scale_y, frame_h, "y2"),
    )


def untile(b: Column, tile_x: Column, tile_y: Column, scale: Column) -> Column:
    """A box of a tile in the coordinates of the unscaled frame."""
    back = lambda v, at, name: ((v + at) / scale).alias(name)
    return F.struct(back(b["x1"], tile_x, "x1"), back(b["y1"], tile_y, "y1"), back(b["x2"], tile_x, "x2"), back(b["y2"], tile_y, "y2"))


def color_class(b: Column, g: Column, r: Column) -> Column:
    """Name of a mean colour; the first rule that holds decides."""
    return (
        F.when((r > 150) & (g < 100) & (b < 100), "red")
        .when((r > 200) & (g > 150) & (b < 80), "yellow")
        .when((r > 150) & (g > 100) & (b < 50), "orange")
        .otherwise("white")
    )


def boosted(conf: Column, age: Column, per_frame: float = 0.03, max_boost: float = 1.3, enabled: bool = True) -> Column:
    """Confidence raised with a track's age, at most to 1."""
    if not enabled:
        return conf
    return F.least(conf * (1 + F.least(age * per_frame, F.lit(max_boost - 1.0))), F.lit(1.0))

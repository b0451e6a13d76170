"""Tag candidates from coloured boxes: size filters, joining red and white, and what each colour gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.nms import BOX, suppress


def sized(df: DataFrame, min_w: float = 40, min_h: float = 20, max_area: float = 60_000, ar_min: float = 0.4, ar_max: float = 6.0) -> DataFrame:
    """Boxes of a plausible size and shape."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    shape = F.coalesce(F.try_divide(w, h), F.lit(0.0))
    return df.where((w >= min_w) & (h >= min_h) & (w * h <= max_area) & (shape > ar_min) & (shape < ar_max))


def _named(prefix: str, df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{prefix}_{c}") for c in (*BOX, "det_ord")))


def _area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def nearest_white(boxes: DataFrame, keys: list[str], radius: float = 150) -> DataFrame:
    """Each red box with the white box of its frame whose centre is nearest and nearer than ``radius``
    (the first on ties); the white columns are null where there is none."""
    red = _named("r", boxes.where("color = 'red'"), keys)
    white = _named("w", boxes.where("color = 'white'"), keys)
    dx = (F.col("r_x1") + F.col("r_x2")) / 2 - (F.col("w_x1") + F.col("w_x2")) / 2
    dy = (F.col("r_y1") + F.col("r_y2")) / 2 - (F.col("w_y1") + F.col("w_y2")) / 2
    near = red.join(white, keys, "left").withColumn("_d", F.sqrt(dx * dx + dy * dy))
    w_cols = [f"w_{c}" for c in (*BOX, "det_ord")]
    best = F.min_by(F.when(F.col("_d") < radius, F.struct(*w_cols)), F.when(F.col("_d") < radius, F.struct("_d", "w_det_ord")))
    r_cols = [f"r_{c}" for c in (*BOX, "det_ord")]
    out = near.groupBy(*keys, *r_cols).agg(best.alias("_w"))
    return out.select(*keys, *r_cols, *(F.col("_w")[c].alias(c) for c in w_cols))


def candidates(boxes: DataFrame, keys: list[str], radius: float = 150, ar_min: float = 0.4, ar_max: float = 6.0) -> DataFrame:
    """Candidates of each frame before suppression, in the order of their making (``det_ord``):
    red joined with its nearest white, red alone, white that none has taken, yellow. A frame's boxes
    are one row, so ``boxes``, which may be long in the making, are made once."""
    item = F.struct(F.col("det_ord").alias("_o"), *BOX)
    of = lambda color: F.collect_list(F.when(F.col("color") == color, item))
    listed = boxes.groupBy(*keys).agg(F.array_distinct(of("red")).alias("_red"), of("white").alias("_white"), of("yellow").alias("_yellow"))
    dx = lambda a, b: (a["x1"] + a["x2"]) / 2 - (b["x1"] + b["x2"]) / 2
    dy = lambda a, b: (a["y1"] + a["y2"]) / 2 - (b["y1"] + b["y2"]) / 2
    far = lambda r, w: F.struct(F.sqrt(dx(r, w) * dx(r, w) + dy(r, w) * dy(r, w)).alias("_d"), *(w[c].alias(c) for c in ("_o", *BOX)))
    known = F.lit(True)
    for k in keys:  # boxes of no frame have no neighbours
        known = known & F.col(k).isNotNull()
    near = lambda r: F.when(known, F.array_min(F.filter(F.transform("_white", lambda w: far(r, w)), lambda q: q["_d"] < radius)))
    reds = listed.withColumn("_red", F.transform("_red", lambda r: F.struct(r.alias("r"), near(r).alias("w"))))
    reds = reds.withColumn("_joined", F.filter("_red", lambda p: p["w"].isNotNull()))
    one = lambda v: F.least(v, F.lit(1.0))
    corners = lambda b: tuple(b[c] for c in BOX)

    def made(box: tuple, conf: Column, tag: str, group: int, order: Column) -> Column:
        return F.struct(F.lit(group).alias("_g"), order.alias("_o"), *(c.alias(n) for c, n in zip(box, BOX)), conf.cast("double").alias("conf"), F.lit(tag).alias("tag_type"))

    def pair(p: Column) -> Column:
        r, w = p["r"], p["w"]
        x1, x2 = F.least(r["x1"], w["x1"]), F.greatest(r["x2"], w["x2"])
        box = (x1, F.least(r["y1"], w["y1"]), x2, F.greatest(r["y2"], w["y2"]))
        return made(box, F.least(0.6 + 0.3 * one((x2 - x1) / 300), F.lit(0.95)), "promo", 0, r["_o"])

    shape = lambda b: F.coalesce(F.try_divide(b["x2"] - b["x1"], b["y2"] - b["y1"]), F.lit(0.0))
    same = lambda a, b: (a["x1"] == b["x1"]) & (a["y1"] == b["y1"]) & (a["x2"] == b["x2"]) & (a["y2"] == b["y2"])
    pairs = F.filter(F.transform("_joined", pair), lambda m: _area(*corners(m)) < 80_000)
    alone = F.filter("_red", lambda p: p["w"].isNull() & (p["r"]["y2"] - p["r"]["y1"] > 30) & (_area(*corners(p["r"])) < 30_000))
    alone = F.transform(alone, lambda p: made(corners(p["r"]), F.lit(0.5), "promo", 1, p["r"]["_o"]))
    free = F.filter("_white", lambda b: (shape(b) > ar_min) & (shape(b) < ar_max) & ~F.coalesce(F.exists("_joined", lambda p: same(p["w"], b)), F.lit(False)))
    white = F.transform(free, lambda b: made(corners(b), F.least(0.5 + 0.3 * one((b["x2"] - b["x1"]) / 250), F.lit(0.85)), "pricetag", 2, b["_o"]))
    yellow = F.transform("_yellow", lambda b: made(corners(b), F.lit(0.55), "promo", 3, b["_o"]))
    rows = reds.select(*keys, F.posexplode(F.array_sort(F.concat(pairs, alone, white, yellow))).alias("det_ord", "_m"))
    return rows.select(*keys, *(F.col("_m")[c].alias(c) for c in (*BOX, "conf", "tag_type")), "det_ord")


def detect(boxes: DataFrame, keys: list[str], radius: float = 150, threshold: float = 0.2) -> DataFrame:
    """Candidates after suppression."""
    return suppress(candidates(boxes, keys, radius), keys, threshold)

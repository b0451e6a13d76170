"""Tile grids over frames, as table functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _starts(size: Column, tile: int, stride: int) -> Column:
    """0, stride, ... while a whole tile fits; none for a frame smaller than a tile."""
    return F.when(size >= tile, F.sequence(F.lit(0), size - tile, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def tile_grid(frames: DataFrame, keys: list[str], tile: int = 640, stride: int = 320, scales: tuple[float, ...] = (0.75, 1.0, 1.25)) -> DataFrame:
    """Tiles of each frame at each scale: whole tiles by stride, then a right column and a bottom row
    where the size is no multiple of the tile, and a corner where both are not. Tiles can repeat."""
    out = frames.select(*keys, F.explode(F.array(*map(F.lit, scales))).alias("scale"), "frame_w", "frame_h")
    out = out.select(*keys, "scale", (F.col("frame_w") * F.col("scale")).cast("int").alias("w"), (F.col("frame_h") * F.col("scale")).cast("int").alias("h"))
    xs, ys = _starts(F.col("w"), tile, stride), _starts(F.col("h"), tile, stride)
    right, bottom = F.greatest(F.lit(0), F.col("w") - tile), F.greatest(F.lit(0), F.col("h") - tile)
    at = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    none = F.array().cast("array<struct<x:int,y:int>>")
    odd_w, odd_h = F.col("w") % tile != 0, F.col("h") % tile != 0
    grid = F.concat(
        F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: at(x, y)))),
        F.when(odd_w, F.transform(ys, lambda y: at(right, y))).otherwise(none),
        F.when(odd_h, F.transform(xs, lambda x: at(x, bottom))).otherwise(none),
        F.when(odd_w & odd_h, F.array(at(right, bottom))).otherwise(none),
    )
    return out.select(*keys, "scale", F.posexplode(grid).alias("tile_no", "_t")).select(*keys, "scale", "tile_no", F.col("_t.x").alias("x"), F.col("_t.y").alias("y"))


def eval_grid(frames: DataFrame, keys: list[str], tile: int = 640, stride: int = 320) -> DataFrame:
    """Tiles at every stride from 0, those at the edge cut to the frame."""
    xs, ys = (F.sequence(F.lit(0), F.col(c) - 1, F.lit(stride)) for c in ("frame_w", "frame_h"))
    out = frames.select(*keys, "frame_w", "frame_h", F.explode(ys).alias("y"), xs.alias("_x")).select(*keys, "frame_w", "frame_h", "y", F.explode("_x").alias("x"))
    return out.select(*keys, "x", "y", F.least(F.col("x") + tile, F.col("frame_w")).alias("x2"), F.least(F.col("y") + tile, F.col("frame_h")).alias("y2"))

"""Image steps over pixel tables: one row per pixel with the keys of its frame, ``y``, ``x`` and a value.

A frame is never held by a task: what looks along an axis is a window over one row or one column of pixels, so a large
frame is spread by its rows and columns; histograms and maps are aggregates and joins; regions are
labelled by stripes of rows. Where a frame's edge is met, what is there counts (``closed``), the last pixel is repeated
(``blurred``), or pixels are mirrored about it (``laplacian``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

KEYS = ("frame_id",)
LEVELS = 256
#: Rows of a stripe in which regions are labelled together.
STRIPE = 64


def _along(axis: str, keys: tuple[str, ...]) -> WindowSpec:
    """The pixels of one row (``axis`` x) or column (y), in order."""
    return W.partitionBy(*keys, "y" if axis == "x" else "x").orderBy(axis)


# ---- morphology


def closed(pixels: DataFrame, value: str, size: int = 7, keys: tuple[str, ...] = KEYS, folds: tuple[Callable, Callable] = (F.max, F.min)) -> DataFrame:
    """``pixels`` with ``value`` closed by a square: the largest about each pixel, then the smallest of these. Both
    are separable; neighbouring steps along the same axis share an exchange. With ``folds`` of bits, several masks are closed as one."""
    before, after = size // 2, size - 1 - size // 2
    grow, shrink = folds
    for axis, fold, low, high in (("x", grow, -before, after), ("y", grow, -before, after), ("y", shrink, -after, before), ("x", shrink, -after, before)):
        pixels = pixels.withColumn(value, fold(value).over(_along(axis, keys).rowsBetween(low, high)))
    return pixels


# ---- thresholds


def otsu_threshold(pixels: DataFrame, value: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per frame the level whose split into up to it and beyond has the highest variance between both, the first of equal
    ones; a frame of one level: 0. Only histograms are shuffled."""
    so_far = W.partitionBy(*keys).orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    bins = pixels.groupBy(*keys, F.col(value).cast("long").alias("level")).agg(F.count("*").alias("n"))
    weight, moment = F.sum("n").over(so_far).cast("double"), F.sum(F.col("level") * F.col("n")).over(so_far).cast("double")
    total, mean = F.sum("n").over(whole).cast("double"), F.sum(F.col("level") * F.col("n")).over(whole).cast("double")
    bins = bins.select(*keys, "level", weight.alias("w"), moment.alias("m"), total.alias("t"), mean.alias("all"))
    gap = F.col("all") * F.col("w") - F.col("m") * F.col("t")
    between = F.when(F.col("w") < F.col("t"), gap * gap / (F.col("w") * (F.col("t") - F.col("w")))).otherwise(F.lit(0.0))
    best = bins.groupBy(*keys).agg(F.max_by("level", F.struct(between, -F.col("level"))).alias("threshold"), F.max(between).alias("_b"))
    return best.select(*keys, F.when(F.col("_b") > 0, F.col("threshold")).otherwise(F.lit(0).cast("long")).alias("threshold"))


def binarized(pixels: DataFrame, value: str, limit: Column | str) -> DataFrame:
    """``pixels`` with ``value`` 255 beyond the limit, else 0."""
    limit = F.col(limit) if isinstance(limit, str) else limit
    return pixels.withColumn(value, F.when(F.col(value) > limit, 255).otherwise(0))


def otsu(pixels: DataFrame, value: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return binarized(pixels.join(otsu_threshold(pixels, value, keys), list(keys)), value, "threshold").drop("threshold")


def gaussian_weights(size: int) -> list[float]:
    """Weights of a smoothing kernel of odd ``size``, with the deviation that goes with it."""
    sigma, half = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    raw = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-half, half + 1)]
    return [w / sum(raw) for w in raw]


def blurred(pixels: DataFrame, value: str, out: str, weights: list[float], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``pixels`` with ``out``: the mean of ``value`` with separable ``weights``, the last pixel repeated beyond edges."""
    half, now = len(weights) // 2, F.col(value).cast("double")
    for axis in ("x", "y"):
        along = _along(axis, keys)
        whole = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        pixels = pixels.withColumn(out, now)
        near = lambda i: F.coalesce(F.lag(out, -i).over(along), (F.first(out) if i < 0 else F.last(out)).over(whole)) if i else F.col(out)  # noqa: B023, E731
        pixels = pixels.withColumn(out, sum((F.lit(w) * near(i) for i, w in enumerate(weights, -half)), F.lit(0.0)))
        now = F.col(out)
    return pixels


def box_mean(pixels: DataFrame, value: str, out: str, size: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``pixels`` with ``out``: the mean of ``value`` over what is there of a square about each pixel. Prefix sums over
    both axes, looked up at the corners, so a pixel costs the same whatever the size."""
    half = size // 2
    pixels = pixels.withColumn("_s", F.col(value).cast("double")).withColumn("_n", F.lit(1.0))
    for axis in ("x", "y"):
        along = _along(axis, keys)
        whole = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        for c in ("_s", "_n"):
            pixels = pixels.withColumn(c, F.sum(c).over(along.rowsBetween(W.unboundedPreceding, 0)))
            pixels = pixels.withColumn(c, F.coalesce(F.lead(c, half).over(along), F.last(c).over(whole)) - F.coalesce(F.lag(c, half + 1).over(along), F.lit(0.0)))
    return pixels.withColumn(out, F.col("_s") / F.col("_n")).drop("_s", "_n")


def adaptive_threshold(pixels: DataFrame, value: str, size: int = 11, less: float = 2, smooth: bool = True, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``pixels`` with ``value`` 255 beyond its neighbourhood's mean (smoothed, or of a square; in whole levels) less ``less``, else 0."""
    with_mean = blurred(pixels, value, "_mean", gaussian_weights(size), keys) if smooth else box_mean(pixels, value, "_mean", size, keys)
    return binarized(with_mean, value, F.floor(F.round("_mean", 6) + 0.5) - less).drop("_mean")


# ---- sharpness


def laplacian(pixels: DataFrame, value: str, out: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``pixels`` with ``out``: the four neighbours of each pixel less four times itself, mirrored about edges."""
    pixels = pixels.withColumn(out, F.lit(0.0))
    for axis in ("x", "y"):
        before, after = F.lag(value).over(_along(axis, keys)), F.lead(value).over(_along(axis, keys))
        pixels = pixels.withColumn(out, F.col(out) + F.coalesce(before, after, F.col(value)) + F.coalesce(after, before, F.col(value)) - 2 * F.col(value))
    return pixels


def sharpness(pixels: DataFrame, value: str, keys: tuple[str, ...] = ("crop_id",)) -> DataFrame:
    """Per crop its ``width``, ``height`` and ``blur``, the variance of its Laplacian. Crops are small, so pixels are
    exchanged once, by crop, and both axes are sorted in place."""
    at_home = laplacian(pixels.repartition(*keys), value, "_l", keys)
    size = lambda c: (F.max(c) - F.min(c) + 1).cast("long")
    return at_home.groupBy(*keys).agg(size("x").alias("width"), size("y").alias("height"), F.var_pop("_l").alias("blur"))


def readable(crops: DataFrame, least_width: int = 200, least_height: int | None = None, least_blur: float = 80.0) -> DataFrame:
    """``sharpness`` rows with ``readable``: whether a crop is large and sharp enough to be read."""
    tall = int(least_width * 0.5) if least_height is None else least_height
    return crops.withColumn("readable", (F.col("width") >= least_width) & (F.col("height") >= tall) & (F.col("blur") >= least_blur))


# ---- contrast


def equalized(pixels: DataFrame, value: str, clip: float = 3.0, tiles: int = 8, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``pixels`` with ``value`` equalised by tiles with limited contrast.

    A frame is cut into ``tiles`` by ``tiles`` (the last ones may be smaller). Each tile's histogram is cut at
    ``clip`` times its mean, what is cut is dealt evenly over all levels, and its running sums are a map of levels. A
    pixel's new level is blended from the maps of the four tiles about it, as far as there are such. Histograms have at most 256
    rows a tile, a map is one row of 256 bytes, and a pixel meets the maps of the cell between the tiles' middles that it lies in.
    Joins are shuffled whatever Spark estimates, which knows neither how files are compressed nor how long arrays are.
    """
    names = list(keys)
    shape = pixels.groupBy(*names).agg(*(F.ceil((F.max(c) + 1) / tiles).cast("long").alias(f"_{c}side") for c in ("x", "y")))
    placed = pixels.join(shape.hint("shuffle_hash"), names).withColumns({f"_{c}tile": F.floor(F.col(c) / F.col(f"_{c}side")) for c in ("x", "y")})
    tile = [*names, "_xtile", "_ytile"]
    whole = W.partitionBy(*tile)
    counts = placed.groupBy(*tile, F.col(value).cast("long").alias("level")).agg(F.count("*").alias("n"))
    known = F.col("level").between(0, LEVELS - 1)
    bins = counts.withColumn("area", F.sum("n").over(whole)).withColumn("n", F.when(known, F.col("n")).otherwise(0))
    limit = F.greatest(F.floor(clip * F.col("area") / LEVELS), F.lit(1))
    bins = bins.withColumn("_over", F.sum(F.greatest(F.col("n") - limit, F.lit(0))).over(whole))
    bins = bins.withColumn("_sum", F.sum(F.least(F.col("n"), limit)).over(whole.orderBy("level").rowsBetween(W.unboundedPreceding, 0)))
    bins = bins.groupBy(*tile, "area", "_over").agg(F.array_sort(F.collect_list(F.when(known, F.struct("level", "_sum")))).alias("_bins"))
    bins = bins.withColumn("_rest", F.col("_over") % LEVELS).withColumn("_step", F.greatest(F.floor(LEVELS / F.greatest("_rest", F.lit(1))), F.lit(1)))
    # every level's running sum: that of the last level before it that the tile has
    start = lambda k: F.coalesce(F.get("_bins", k)["level"], F.lit(LEVELS)).cast("int")
    sums = F.flatten(F.transform("_bins", lambda b, k: F.array_repeat(b["_sum"], start(k + 1) - start(k))))
    sums = F.concat(F.array_repeat(F.lit(0).cast("long"), start(F.lit(0))), sums)
    dealt = lambda level: F.floor(F.col("_over") / LEVELS) * (level + 1) + F.least(F.floor(level / F.col("_step")) + 1, F.col("_rest"))
    to = F.transform(sums, lambda n, level: (F.bround((n + dealt(level)) * (LEVELS - 1.0) / F.col("area")) - LEVELS // 2).cast("tinyint"))  # a byte, so less 128
    maps = bins.select(*tile, to.alias("to"))

    # a cell has up to four tiles: x and y tell the second along each axis
    near = F.array(*(F.struct((F.col("_xtile") - x).alias("_xcell"), (F.col("_ytile") - y).alias("_ycell"), F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (0, 1) for y in (0, 1)))
    cell = [*names, "_xcell", "_ycell"]
    cells = maps.select(*names, "to", F.explode(near).alias("_c")).select(*names, "_c._xcell", "_c._ycell", F.struct("_c.x", "_c.y", "to").alias("_m"))
    cells = cells.groupBy(*cell).agg(F.collect_list("_m").alias("_maps"))
    others = [c for c in pixels.columns if c not in (*names, "x", "y", value)]
    at = {c: F.col(c) / F.col(f"_{c}side") - 0.5 for c in ("x", "y")}
    inner = placed.where(F.col(value).cast("long").between(0, LEVELS - 1))
    inner = inner.select(*names, "x", "y", *others, F.col(value).cast("int").alias("_level"), *(F.floor(a).alias(f"_{c}cell") for c, a in at.items()), *((a - F.floor(a)).alias(f"_{c}w") for c, a in at.items()))
    side = lambda m, c: F.when(m[c] == 1, F.col(f"_{c}w")).otherwise(1 - F.col(f"_{c}w"))
    share = lambda m: side(m, "x") * side(m, "y")
    mixed = inner.join(cells.hint("merge"), cell).select(
        *cell, "x", "y", *others, F.aggregate("_maps", F.lit(0.0), lambda v, m: v + share(m) * (F.get(m["to"], F.col("_level")) + LEVELS // 2)).alias("_v"),
        F.aggregate("_maps", F.lit(0.0), lambda w, m: w + share(m)).alias("_w"),
    )
    mixed = mixed.groupBy(*cell, "x", "y", *others).agg((F.sum("_v") / F.sum("_w")).alias("_v"))
    return mixed.select(*names, "x", "y", *others, F.floor(F.round("_v", 6) + 0.5).cast("int").alias(value)).select(*pixels.columns)


# ---- regions


def runs(mask: DataFrame, value: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Maximal runs of set pixels in each row: ``y``, ``x1`` and ``x2``, both within."""
    along = _along("x", keys)
    set_ = mask.where((F.col(value) > 0) & F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    marked = set_.withColumn("_run", F.col("x") - F.row_number().over(along))
    return marked.groupBy(*keys, "y", "_run").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).drop("_run")


def _joined(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    """The smallest number that each of ``n`` is connected with."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _touching(rows: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int]]:
    """Numbers of runs of neighbouring rows that touch, also at corners. ``rows``: runs (x1, x2, number) of each y, in order."""
    out = []
    for y, upper in rows.items():
        lower, i, j = rows.get(y + 1, []), 0, 0
        while i < len(upper) and j < len(lower):
            if upper[i][0] <= lower[j][1] + 1 and lower[j][0] <= upper[i][1] + 1:
                out.append((upper[i][2], lower[j][2]))
            if upper[i][1] < lower[j][1]:
                i += 1
            else:
                j += 1
    return out


def _by_group(df: DataFrame, names: list[str], order: list[str], work: Callable[[Iterator[tuple]], Iterator[tuple]], types: str, out: pa.Schema) -> DataFrame:
    """``names`` with what ``work`` gives for the other columns of each of their groups, met in ``order``. A task meets its
    groups one after the other in sorted rows, since calls for each of many small groups would cost more than their work."""
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([*(first.schema.field(i) for i in range(n)), *out])
        rows = (r for b in chain([first], batches) for r in zip(*(c.to_pylist() for c in b.columns)))
        done = (key + r for key, group in groupby(rows, lambda r: r[:n]) for r in work(r[n:] for r in group))
        while some := list(islice(done, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    kept = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in names)
    rest = [c for c in df.columns if c not in names]
    return df.select(*names, *rest).repartition(*names).sortWithinPartitions(*names, *order).mapInArrow(run, f"{kept}, {types}")


def regions(mask: DataFrame, value: str, keys: tuple[str, ...] = KEYS, stripe: int = STRIPE) -> DataFrame:
    """Connected regions of set pixels (corners connect): per region of a frame its box ``x1`` to ``y2`` (ends beyond it) and ``pixels``.

    Rows are cut into runs; a stripe of rows is labelled in one task, and gives its regions' boxes and the runs of its first and last row.
    The regions of a frame that touch across stripes are joined from these runs alone.
    """
    names = list(keys)
    source = runs(mask, value, keys).withColumn("stripe", F.floor(F.col("y") / stripe))

    def united(numbers: list[int], parts: list[tuple]) -> Iterable[tuple]:
        """Parts of the same number as one: box and pixels."""
        whole: dict[int, tuple] = {}
        for k, (x1, y1, x2, y2, n) in zip(numbers, parts):
            a = whole.get(k)
            whole[k] = (x1, y1, x2, y2, n) if a is None else (min(a[0], x1), min(a[1], y1), max(a[2], x2), max(a[3], y2), a[4] + n)
        return whole.items()

    def label(found: Iterator[tuple]) -> Iterator[tuple]:
        parts, rows, ends = [], {}, {}
        for k, (y, x1, x2) in enumerate(found):
            rows.setdefault(y, []).append((x1, x2, k))
            parts.append((x1, y, x2 + 1, y + 1, x2 - x1 + 1))
        numbers = _joined(len(parts), _touching(rows))
        for k, (x1, y, x2, _, _) in zip(numbers, parts):
            if y % stripe in (0, stripe - 1):
                ends.setdefault(k, []).append({"y": y, "x1": x1, "x2": x2 - 1})
        for k, part in united(numbers, parts):
            yield *part, ends.get(k, [])

    def merge(found: Iterator[tuple]) -> Iterator[tuple]:
        parts, rows = [], {}
        for *part, ends in found:
            if not ends:
                yield tuple(part)
                continue
            for e in ends:
                rows.setdefault(e["y"], []).append((e["x1"], e["x2"], len(parts)))
            parts.append(part)
        for some in rows.values():
            some.sort()
        for _, part in united(_joined(len(parts), _touching(rows)), parts):
            yield part

    types = "x1 bigint, y1 bigint, x2 bigint, y2 bigint, pixels bigint"
    box = [(c, pa.int64()) for c in ("x1", "y1", "x2", "y2", "pixels")]
    run = pa.struct([(c, pa.int64()) for c in ("y", "x1", "x2")])
    parts = _by_group(source.select(*names, "stripe", "y", "x1", "x2"), [*names, "stripe"], ["y", "x1"], label, f"{types}, ends array<struct<y:bigint,x1:bigint,x2:bigint>>", pa.schema([*box, ("ends", pa.list_(run))]))
    return _by_group(parts.drop("stripe"), names, [], merge, types, pa.schema(box))


def principal_axis(mask: DataFrame, value: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per frame the middle of its set pixels and the ``angle``, in degrees from -90 to 90, of their longer axis, from second moments."""
    set_ = mask.where(F.col(value) > 0)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    m = set_.groupBy(*keys).agg(F.count("*").alias("pixels"), F.avg(x).alias("mid_x"), F.avg(y).alias("mid_y"), F.var_pop(x).alias("_xx"), F.var_pop(y).alias("_yy"), F.covar_pop(x, y).alias("_xy"))
    return m.select(*keys, "pixels", "mid_x", "mid_y", F.degrees(F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy")) / 2).alias("angle"))

"""Suppression, fusion and matching of boxes within a frame.

Ranks of a frame are folded with array functions: a box stays unless a box that already stays
overlaps it. That needs a frame's boxes in one row, and each only once per shuffle.
Ties of confidence go to the smaller ordinal, except in fusion, where the larger one leads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.geometry import iou

BOX = ("x1", "y1", "x2", "y2")


def _ranked(df: DataFrame, keys: list[str], conf: str, order: str, descending_order: bool = False) -> tuple[DataFrame, T.ArrayType]:
    """One row per frame with ``_boxes``: all columns but the keys, by falling confidence."""
    rest = [c for c in df.columns if c not in keys]
    tie = -F.col(order) if descending_order else F.col(order)
    item = F.struct((-F.col(conf)).alias("_rank"), tie.alias("_tie"), *rest)
    out = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_boxes"))
    return out, out.schema["_boxes"].dataType


def _greedy(boxes: Column, kind: T.ArrayType, threshold: float) -> Column:
    empty = F.array().cast(kind)
    return F.aggregate(boxes, empty, lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) >= threshold), kept).otherwise(F.concat(kept, F.array(b))))


def _unpacked(df: DataFrame, keys: list[str], column: str, names: list[str]) -> DataFrame:
    return df.select(*keys, F.explode(column).alias("_b")).select(*keys, *(F.col("_b")[c].alias(c) for c in names))


def suppress(df: DataFrame, keys: list[str], threshold: float, conf: str = "conf", order: str = "det_ord") -> DataFrame:
    """Greedy non-maximum suppression: the rows of ``df`` that stay."""
    names = [c for c in df.columns if c not in keys]
    ranked, kind = _ranked(df, keys, conf, order)
    return _unpacked(ranked.select(*keys, _greedy(F.col("_boxes"), kind, threshold).alias("_kept")), keys, "_kept", names)


def fuse(df: DataFrame, keys: list[str], threshold: float, skip: float = 0.0, conf: str = "conf", order: str = "det_ord", single_passes: bool = False, whole: bool = False) -> DataFrame:
    """Weighted box fusion: every box joins the first-ranked seed it overlaps; a cluster's corners are
    weighted by confidence and its confidence is the mean. Clusters below ``skip`` are dropped, but not
    a frame's only box when ``single_passes``; ``whole`` cuts corners to whole numbers."""
    ranked, kind = _ranked(df.select(*keys, *BOX, conf, order), keys, conf, order, True)
    seeded = ranked.select(*keys, F.size("_boxes").alias("_n"), "_boxes", _greedy(F.col("_boxes"), kind, threshold).alias("_seeds"))
    # a seed overlaps no seed before it, so the first seed that a box overlaps is itself for a seed
    first = lambda b: F.filter(F.transform("_seeds", lambda s, i: F.when(iou(s, b) >= threshold, i)), lambda i: i.isNotNull())
    at = F.transform("_boxes", lambda b: F.struct(F.coalesce(F.try_element_at(first(b), F.lit(1)), F.array_position("_seeds", b).cast("int") - 1).alias("seed"), b.alias("b")))
    rows = seeded.select(*keys, "_n", F.explode(at).alias("_x")).select(*keys, "_n", F.col("_x.seed").alias("seed"), *(F.col("_x.b")[c].alias(c) for c in (*BOX, conf)))
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col(conf)), F.sum(conf))
    out = rows.groupBy(*keys, "_n", "seed").agg(*(mean(c).alias(c) for c in BOX), F.avg(conf).alias("_mean"), F.count("*").alias("members")).where("x1 is not null")
    out = out.where((F.col("_mean") >= skip) | (F.lit(single_passes) & (F.col("_n") == 1)))
    return out.select(*keys, "seed", *(F.col(c).cast("int" if whole else "double").alias(c) for c in BOX), F.col("_mean").alias(conf), "members")


def merge_sources(df: DataFrame, keys: list[str], threshold: float = 0.45, source: str = "source", first: str = "yolo", conf: str = "conf", order: str = "det_ord") -> DataFrame:
    """All boxes of the ``first`` source, then those of others that overlap none of them, suppressed
    among themselves. ``rank`` tells the order: the first source's, then the others' by confidence."""
    names = [c for c in df.columns if c not in keys]
    item = F.struct(F.col(order).alias("_o"), *names)
    of = lambda test: F.array_sort(F.collect_list(F.when(test, item)), None)
    both = df.groupBy(*keys).agg(of(F.col(source) == first).alias("_a"), F.array_sort(F.collect_list(F.when(F.col(source) != first, F.struct((-F.col(conf)).alias("_rank"), F.col(order).alias("_tie"), *names)))).alias("_b"))
    kind = both.schema["_b"].dataType
    free = F.filter("_b", lambda b: ~F.exists("_a", lambda a: iou(a, b) >= threshold))
    plain = lambda c: F.transform(c, lambda b: F.struct(*(b[n].alias(n) for n in names)))
    both = both.select(*keys, F.concat(plain("_a"), plain(_greedy(free, kind, threshold))).alias("_m"))
    return both.select(*keys, F.posexplode("_m").alias("rank", "_x")).select(*keys, "rank", *(F.col("_x")[n].alias(n) for n in names))


def first_matches(found: DataFrame, truth: DataFrame, keys: list[str], threshold: float = 0.45, order: str = "det_ord") -> DataFrame:
    """Each found box, in order, takes the first reference of its frame that is free and overlaps it.
    One row per frame: ``tp``, ``n_found``, ``n_truth`` and ``pairs`` (ordinals)."""
    item = F.struct(order, *BOX)
    listed = lambda df, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias(name))
    none = f"array<struct<{order}:{found.schema[order].dataType.simpleString()},{','.join(f'{c}:double' for c in BOX)}>>"
    both = listed(found, "_f").join(listed(truth, "_t"), keys, "full").withColumns({c: F.coalesce(c, F.array().cast(none)) for c in ("_f", "_t")})
    pair = F.array().cast("array<struct<f:int,t:int>>")

    def step(done: Column, b: Column) -> Column:
        free = F.filter("_t", lambda t: ~F.exists(done, lambda d: d["t"] == t[order]) & (iou(b, t) >= threshold))
        return F.when(F.size(free) > 0, F.concat(done, F.array(F.struct(b[order].cast("int").alias("f"), free[0][order].cast("int").alias("t"))))).otherwise(done)

    pairs = F.aggregate("_f", pair, step)
    return both.select(*keys, F.size("_f").alias("n_found"), F.size("_t").alias("n_truth"), pairs.alias("pairs")).withColumn("tp", F.size("pairs"))


def agreement(matches: DataFrame) -> DataFrame:
    """One row: counts, precision, recall and F1 over all frames, 0 where undefined."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = matches.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "n_found", "n_truth")))
    out = total.select("tp", (F.col("n_found") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"), F.col("n_found").alias("total_detections"), F.col("n_truth").alias("total_reference"))
    out = out.withColumn("precision", zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))).withColumn("recall", zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))))
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def decode_predictions(raw: DataFrame, threshold: float, keys: list[str], order: str = "det_ord") -> DataFrame:
    """Raw rows (cx, cy, w, h, obj, scores) with the best class, those over the threshold twice: by
    objectness, then by objectness times the best class's score."""
    best = F.array_max("scores")
    out = raw.where(F.col("obj") >= threshold).withColumn("conf", F.col("obj") * best).withColumn("class_id", F.array_position("scores", best).cast("int") - 1)
    return out.where(F.col("conf") >= threshold).select(*keys, order, "cx", "cy", "w", "h", "conf", "class_id")


def top_of_class(df: DataFrame, keys: list[str], class_id: int = 0, conf: str = "conf", order: str = "det_ord") -> DataFrame:
    """The most confident box of a class in each frame, the first on ties."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(conf), -F.col(order))).alias("_b")
    return df.where(F.col("class_id") == class_id).groupBy(*keys).agg(best).select(*keys, *(F.col("_b")[c].alias(c) for c in rest))


def top_list(df: DataFrame, n: int = 10, conf: str = "conf", order: str = "det_id") -> DataFrame:
    """The ``n`` most confident rows, ties by ``order``."""
    return df.orderBy(F.desc(conf), order).limit(n)


def size_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of small, medium and large boxes, and the mean confidence."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return df.groupBy(*keys).agg(
        F.count_if(area < 10_000).alias("small"), F.count_if((area >= 10_000) & (area < 40_000)).alias("medium"),
        F.count_if(area >= 40_000).alias("large"), F.avg("conf").alias("mean_conf"),
    )

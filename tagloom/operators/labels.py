"""Curation of annotation labels: parsing, validity, duplicates, profiles, merging and image matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

COORDS = ("cx", "cy", "w", "h")
SIZE = 480.0


def parse(lines: DataFrame, text: str = "line") -> DataFrame:
    """``lines`` with ``cls`` and coordinates; all null where a line is no label (five fields, a whole class, four numbers)."""
    parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    whole = F.when(parts[0].rlike(r"^[+-]?[0-9]+$"), parts[0].try_cast("int"))
    numbers = [F.try_element_at(parts, F.lit(i)).try_cast("double") for i in range(2, 6)]
    good = (F.size(parts) == 5) & whole.isNotNull()
    for n in numbers:
        good &= n.isNotNull()
    good = F.coalesce(good, F.lit(False))
    return lines.withColumns({"cls": F.when(good, whole)} | {c: F.when(good, n) for c, n in zip(COORDS, numbers)})


def _inside() -> Column:
    cx, cy, w, h = (F.col(c) for c in COORDS)
    bounds = cx.between(0, 1) & cy.between(0, 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1)
    return bounds & (cx - w / 2 >= 0) & (cx + w / 2 <= 1) & (cy - h / 2 >= 0) & (cy + h / 2 <= 1)


def valid(min_area: float = 0.0005, min_side: float = 0.008) -> Column:
    """A box large enough and inside its image."""
    w, h = F.col("w"), F.col("h")
    return (w * h >= min_area) & (w >= min_side) & (h >= min_side) & _inside()


def valid_for_merge(min_area: float = 0.0005) -> Column:
    """As ``valid``, without a least side."""
    return _inside() & (F.col("w") * F.col("h") >= min_area)


def drop_small(labels: DataFrame, cls: int = 1, min_area: float = 0.005) -> DataFrame:
    """Labels without the small boxes of one class."""
    return labels.where(~((F.col("cls") == cls) & (F.col("w") * F.col("h") < min_area)))


def _signature(places: int = 6) -> list[Column]:
    return [F.col("cls"), *(F.round(c, places) + F.lit(0.0) for c in COORDS)]


def _signed(labels: DataFrame) -> DataFrame:
    sig = F.struct(*(c.alias(n) for c, n in zip(_signature(), ("cls", *COORDS))))
    return labels.where("cls is not null").withColumn("_sig", sig)


def duplicate_signatures(labels: DataFrame, least: int = 3) -> DataFrame:
    """Boxes that occur at least ``least`` times in a split, equal to six places."""
    out = _signed(labels).groupBy("split", "_sig").agg(F.count("*").alias("n"), F.min("file").alias("first_file"))
    return out.where(F.col("n") >= least).select("split", "_sig.*", "n", "first_file")


def deduplicated(labels: DataFrame, least: int = 3) -> DataFrame:
    """Parsed labels with ``reason``: null for those that stay, else ``invalid``, ``small`` or
    ``duplicate``. Of a repeated box only the first valid one within its first file stays."""
    signed = _signed(labels).withColumn("_valid", valid())
    # counts are aggregated before the shuffle, so a frequent box stays small; then joined back
    counts = signed.groupBy("split", "_sig").agg(F.count("*").alias("_n"), F.min("file").alias("_f0"))
    one = signed.join(counts, ["split", "_sig"])
    w = W.partitionBy("split", "_sig", "file", "_valid").orderBy("line_no")
    one = one.withColumn("_rn", F.row_number().over(w))
    stays = (F.col("_n") < least) | ((F.col("file") == F.col("_f0")) & (F.col("_rn") == 1))
    reason = F.when(~F.col("_valid"), "small").when(~stays, "duplicate")
    out = one.withColumn("reason", reason).select(*labels.columns, "reason")
    return out.unionByName(labels.where("cls is null").withColumn("reason", F.lit("invalid")))


def cleanup_counters(judged: DataFrame) -> DataFrame:
    """Per split: boxes, what went for which reason, files left empty, what stays."""
    by = lambda r: F.count_if(F.col("reason") == r)
    stays = F.col("reason").isNull()
    files = judged.groupBy("split", "file").agg(F.count("*").alias("n"), *(by(r).alias(r) for r in ("invalid", "small", "duplicate")), F.count_if(stays).alias("kept"))
    return files.groupBy("split").agg(
        F.sum(F.col("n") - F.col("invalid")).alias("total"), *(F.sum(r).alias(r) for r in ("invalid", "small", "duplicate")),
        F.count_if(F.col("kept") == 0).alias("empty_files"), F.sum("kept").alias("kept"),
    )


def class_counts(labels: DataFrame, keys: list[str]) -> DataFrame:
    return labels.where("cls is not null").groupBy(*keys, "cls").agg(F.count("*").alias("n"))


#: Stretches of the number line for each doubling of a value.
STRETCHES = 64


def index_quantiles(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Least, middle, 90 % and largest by position: the values at n // 2 and int(0.9 n) of the sorted column.

    Values are counted first, and counts summed by stretches of the number line that rise with the value. Running
    sums of the stretches, which are few, tell where each position is; only those stretches are then sorted.
    """
    counts = df.select(*keys, value.cast("double").alias("v")).where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("k"))
    counts = counts.withColumn("s", F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.signum("v") * (F.floor(F.log2(F.abs("v")) * STRETCHES) + (1 << 20))))
    of_key, rising = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0)) for _ in range(2))
    before = F.sum("k").over(rising.orderBy("s").rowsBetween(W.unboundedPreceding, 0)) - F.col("k")
    sums = counts.groupBy(*keys, "s").agg(F.sum("k").alias("k"), F.min("v").alias("low"), F.max("v").alias("high"))
    sums = sums.withColumn("before", before).withColumn("n", F.sum("k").over(of_key)).withColumn("low", F.min("low").over(of_key)).withColumn("high", F.max("high").over(of_key))
    places = F.array(*(F.struct(F.lit(c).alias("what"), F.floor(at).alias("at")) for c, at in (("median", F.col("n") / 2), ("p90", F.col("n") * F.lit(0.9)))))
    asked = sums.withColumn("place", F.explode(places)).where("place.at >= before and place.at < before + k").select(*keys, "s", "before", "n", "low", "high", "place.*")
    within = counts.join(asked, [*keys, "s"])
    upto = F.col("before") + F.sum("k").over(W.partitionBy(*keys, "s", "what").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    at = lambda what: F.min(F.when((F.col("what") == what) & (F.col("upto") > F.col("at")), F.col("v")))
    return within.withColumn("upto", upto).groupBy(*keys).agg(
        F.max("n").alias("n"), F.min("low").alias(f"min_{name}"), at("median").alias(f"median_{name}"), at("p90").alias(f"p90_{name}"), F.max("high").alias(f"max_{name}"),
    )


def _unit(c: str) -> Column:
    """A side in image units: pixel labels are divided by the image size."""
    return F.when((F.col("w") > 1) | (F.col("h") > 1), F.col(c) / SIZE).otherwise(F.col(c))


def area_profile(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Quantiles of box areas by position, and numbers by size."""
    area = F.col("w") * F.col("h")
    bins = labels.groupBy(*keys).agg(
        F.count_if(area < 0.001).alias("tiny"), F.count_if((area >= 0.001) & (area < 0.01)).alias("small"),
        F.count_if((area >= 0.01) & (area < 0.1)).alias("medium"), F.count_if(area >= 0.1).alias("large"),
    )
    return index_quantiles(labels, keys, area, "area").join(bins, keys)


def aspect_profile(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Quantiles of width over height by position."""
    return index_quantiles(labels.where(_unit("h") > 0), keys, _unit("w") / _unit("h"), "ratio")


def pixel_share(labels: DataFrame, keys: list[str], image: int = 640, least: float = 40) -> DataFrame:
    """Boxes of at least ``least`` pixels a side (of a square of equal area), and pixels of the quantiles."""
    px = F.sqrt(F.col("w") * F.col("h")) * image
    share = labels.groupBy(*keys).agg(F.count_if(px >= least).alias("above"), F.avg((px >= least).cast("double")).alias("share"))
    q = index_quantiles(labels, keys, px, "px")
    return q.select(*keys, *(F.col(c).cast("int").alias(c) for c in ("min_px", "median_px", "p90_px"))).join(share, keys)


def normalized(labels: DataFrame) -> DataFrame:
    """Labels in image units: a label with any value over 1 is divided by the image size; ``normalized`` tells."""
    big = F.greatest(*COORDS) > 1
    return labels.withColumn("normalized", big).withColumns({c: F.when(F.col("normalized"), F.col(c) / SIZE).otherwise(F.col(c)) for c in COORDS})


def label_text(cls: Column | int | None = 0) -> Column:
    """A label line with six places; ``cls`` replaces the class unless None."""
    c = F.col("cls") if cls is None else F.lit(cls) if isinstance(cls, int) else cls
    return F.format_string("%d %.6f %.6f %.6f %.6f", c, *COORDS)


def stem(file: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(file, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


#: Image extensions, the preferred first.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")


def with_images(labels: DataFrame, images: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Labels whose split has an image of the same stem, with ``image``: the one of the preferred extension."""
    suffix = F.regexp_extract("image", r"(\.[^.]*)$", 1)
    priority = F.array_position(F.array(*map(F.lit, extensions)), suffix)
    best = images.withColumn("_p", priority).where("_p > 0").groupBy("split", stem(F.col("image")).alias("_stem")).agg(F.min_by("image", "_p").alias("image"))
    return labels.withColumn("_stem", stem(F.col("file"))).join(best, ["split", "_stem"]).drop("_stem")


def orphan_images(images: DataFrame, judged: DataFrame) -> DataFrame:
    """Images of label files that are empty after cleaning: of the same stem, or else of the stem before ``.rf.``."""
    files = judged.groupBy("split", "file").agg(F.count_if(F.col("reason").isNull()).alias("kept")).where("kept = 0")
    name = stem(F.col("file"))
    asked = files.select("split", "file", F.explode(F.array_distinct(F.array(name, F.substring_index(name, ".rf.", 1)))).alias("_stem"), name.alias("_full"))
    mine = images.withColumn("_stem", stem(F.col("image"))).withColumn("_p", F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.regexp_extract("image", r"(\.[^.]*)$", 1))).where("_p > 0")
    best = asked.join(mine, ["split", "_stem"]).groupBy("split", "file").agg(F.min_by("image", F.struct("_p", (F.col("_stem") != F.col("_full")).cast("int").alias("s"))).alias("image"))
    return best.select("split", "image").distinct()


def merged_names(files: DataFrame, prefix: str = "tiled", split: bool = True) -> DataFrame:
    """Target name of each (split, file): prefix, split and stem, and a number from the second of equal names on."""
    parts = [F.lit(prefix), F.col("split"), stem(F.col("file"))] if split else [F.lit(prefix), stem(F.col("file"))]
    base = files.withColumn("_base", F.concat_ws("_", *parts))
    k = F.row_number().over(W.partitionBy("_base").orderBy("split", "file")) - 1
    return base.withColumn("_k", k).withColumn("name", F.when(F.col("_k") == 0, F.col("_base")).otherwise(F.concat_ws("_", "_base", F.col("_k").cast("string")))).drop("_base", "_k")


def merge(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Labels with an image, in image units and valid, as lines of class 0; ``normalized`` tells which were pixels."""
    out = normalized(with_images(labels.where("cls is not null"), images)).where(valid_for_merge())
    return out.select("split", "file", "line_no", "image", label_text(0).alias("line"), "normalized")


def merge_counters(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Per split: label files, those with and without image, boxes too small or outside, and pixel labels."""
    parsed = labels.where("cls is not null")
    files = labels.select("split", "file").distinct()
    have = with_images(files, images).select("split", "file").withColumn("_has", F.lit(True))
    flagged = files.join(have, ["split", "file"], "left")
    by_file = flagged.groupBy("split").agg(F.count("*").alias("files"), F.count_if("_has").alias("with_image"), F.count_if(F.col("_has").isNull()).alias("no_image"))
    boxes = normalized(parsed.join(have, ["split", "file"]))
    by_box = boxes.groupBy("split").agg(F.count_if(valid_for_merge()).alias("copied"), F.count_if(~valid_for_merge()).alias("rejected"), F.count_if("normalized").alias("normalized"))
    return by_file.join(by_box, "split", "left")

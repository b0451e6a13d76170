"""Export rows: built from boxes, texts and QR payloads, validated, and reduced to one per track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.functions import geometry, qr, text
from tagloom.functions.text import blank_to_null
from tagloom.schema import EXPORT_COLUMNS
from tagloom.sources.catalog import fill_names


def blank_rows(df: DataFrame, keys: list[str], **known: Column | str) -> DataFrame:
    """Rows with all export columns, blank but for the ``known`` ones (columns or constants)."""
    value = lambda c: known[c] if isinstance(known.get(c), Column) else F.lit(known.get(c, ""))
    return df.select(*keys, *(F.coalesce(value(c).cast("string"), F.lit("")).alias(c) for c in EXPORT_COLUMNS))


def box_fields(b: Column, filename: Column, frame: Column) -> dict[str, Column]:
    whole = lambda c: b[c].cast("int").cast("string")
    return {"filename": filename, "frame_timestamp": frame.cast("string"), "x_min": whole("x1"), "y_min": whole("y1"), "x_max": whole("x2"), "y_max": whole("y2")}


def text_fields(texts: Column, mean_color: Column | None = None, name: Column | None = None) -> dict[str, Column]:
    """Export fields of the text lines; null where nothing is to be set. ``mean_color``: struct b, g, r."""
    price = lambda c: F.format_string("%.2f", c)
    prices = text.ranked_prices(text.price_list(texts, "export"))
    color = geometry.color_class(mean_color["b"], mean_color["g"], mean_color["r"]) if mean_color is not None else F.lit("white")
    out = {k: F.when(p.isNotNull(), price(p)) for k, p in zip(("price_default", "price_card", "price_discount"), prices)}
    out |= {"discount_amount": text.discount(texts), "barcode": text.barcode(texts), "print_datetime": text.date_text(texts)}
    open_ = blank_to_null(name).isNull() if name is not None else F.lit(True)
    out |= {"product_name": F.when(open_, text.first_name(texts)), "special_symbols": text.export_symbols(texts, color)}
    if mean_color is not None:
        out["color"] = color
    some = F.coalesce(F.size(texts) > 0, F.lit(False))
    return {k: F.when(some, v) for k, v in out.items()}


def updated(rows: DataFrame, fields: dict[str, Column], only_blank: bool = False) -> DataFrame:
    """``rows`` with non-null ``fields`` put in; ``only_blank``: where the row has nothing yet."""
    def put(name: str, new: Column) -> Column:
        old, new = F.col(name), new.cast("string")
        if only_blank:
            return F.coalesce(blank_to_null(old), blank_to_null(new), F.lit(""))
        return F.coalesce(new, old, F.lit(""))

    return rows.withColumns({k: put(k, v) for k, v in fields.items() if k in rows.columns})


def with_qr(rows: DataFrame, payload: Column) -> DataFrame:
    """``rows`` with the fields of a parsed QR payload (a map)."""
    names = ("raw_qr_data", "qr_code_barcode", "price1_qr", "price2_qr", "price3_qr", "price4_qr", "id_sku")
    made = rows.withColumn("_qr", qr.to_row(payload, F.col("barcode"), F.col("id_sku")))
    made = updated(made, {k: F.col("_qr")[k] for k in names})
    return updated(made, {k: F.col("_qr")[k] for k in qr.PASSED}, only_blank=True).drop("_qr")


def validated(rows: DataFrame) -> DataFrame:
    """``rows`` with failing fields blanked: price, barcode length, and a box that is negative or turned round."""
    price = F.col("price_default").try_cast("double")
    digits = text.digits(F.col("barcode"))
    x1, y1, x2, y2 = (F.col(c).try_cast("double").try_cast("int") for c in ("x_min", "y_min", "x_max", "y_max"))
    asked = (F.col("x_min") != "") & (F.col("x_max") != "")
    good = F.coalesce((x1 >= 0) & (y1 >= 0) & (x2 > x1) & (y2 > y1), F.lit(False))
    box = lambda c: F.when(asked & ~good, "").otherwise(F.col(c))
    return rows.withColumns(
        {"price_default": F.when(F.coalesce((price > 0) & (price <= 9_999_999), F.lit(False)), F.col("price_default")).otherwise("")}
        | {"barcode": F.when(F.length(digits).between(8, 14), digits).otherwise("")}
        | {c: box(c) for c in ("x_min", "y_min", "x_max", "y_max")}
    )


def new_tag_rows(tags: DataFrame, catalog: DataFrame, engine: str = "ocr") -> DataFrame:
    """Export rows of new tags: ``tags`` has tracker_id, filename, frame_id, x1 to y2, ``texts``,
    ``mean_color`` (struct b, g, r) and ``qr`` (raw payload). Box, then texts, then what the tag parser
    adds to blank fields, then QR, then a looked-up name; failing fields are blanked."""
    keep = ["texts", "mean_color", "qr"]
    known = box_fields(geometry.box(), F.col("filename"), F.col("frame_id")) | {"tracker_id": F.col("tracker_id")}
    rows = blank_rows(tags, keep, **known)
    rows = updated(rows, text_fields(F.col("texts"), F.col("mean_color"), F.col("product_name")))
    rows = rows.withColumn("_info", text.tag_info(F.col("texts"), engine))
    fields = [f.name for f in rows.schema["_info"].dataType.fields]
    rows = updated(rows, {f: F.col("_info")[f] for f in fields}, only_blank=True)
    rows = with_qr(rows, qr.parse(F.col("qr")))
    return validated(fill_names(rows, catalog).drop("_info", *keep))


def best_rows(rows: DataFrame, order: str) -> DataFrame:
    """Of each tracker's rows the fullest, the first of equally full ones; rows without a tracker all stay.
    Output order is that of each tracker's first row, told by ``order``."""
    filled = sum((F.col(c) != "").cast("int") for c in EXPORT_COLUMNS)
    tracked = rows.where("tracker_id <> ''").withColumn("_filled", filled)
    # an aggregate, not a sort: a tracker's rows are reduced before the shuffle
    best = tracked.groupBy("tracker_id").agg(F.max_by(F.struct(*rows.columns), F.struct("_filled", -F.col(order))).alias("_r"), F.min(order).alias("_first"))
    out = best.select("_first", *(F.col("_r")[c].alias(c) for c in rows.columns))
    return out.unionByName(rows.where("tracker_id = ''").withColumn("_first", F.col(order))).withColumnRenamed("_first", "first_seen")


def merged_texts(values: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Per key the value that a track ends with (columns key, value): strictly longer ones replace, an
    empty value stays only until a longer one comes; null counts as the four letters of None."""
    text_of = F.coalesce(F.col("value").cast("string"), F.lit("None"))
    w = W.partitionBy(*keys, "key").orderBy(order)
    ranked = values.withColumn("_first", F.row_number().over(w) == 1).withColumn("_truthy", F.coalesce(F.col("value") != "", F.lit(False)))
    use = ranked.where("_first or _truthy").withColumn("_n", F.length(text_of))
    # a value replaces only if it is truthy and longer than what is there, so the first longest one stays
    return use.groupBy(*keys, "key").agg(F.max_by("value", F.struct("_n", -F.col(order))).alias("value"))


def running_confidence(df: DataFrame, keys: list[str], order: str, conf: str = "conf") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("max_conf", F.max(conf).over(w))

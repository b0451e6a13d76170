"""Input tables and the export row."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def _schema(text: str) -> T.StructType:
    """Of "name type, ..."; needs no running session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in text.split(", "))])


DETECTIONS = _schema("video_id bigint, frame_id bigint, det_ord int, x1 double, y1 double, x2 double, y2 double, conf double, source string, tag_type string")
FRAMES = _schema("video_id bigint, frame_id bigint, frame_w int, frame_h int")
OCR_LINES = _schema("video_id bigint, frame_id bigint, det_ord int, line_no int, text string, conf double")
LABELS = _schema("split string, file string, line_no int, line string")
CATALOG = _schema("row_no bigint, fullname string, code string")

#: The columns of an exported row, in their order; all are strings, blank when unknown.
EXPORT_COLUMNS = (
    "tracker_id", "filename", "product_name", "price_default", "price_card", "price_discount", "barcode", "discount_amount",
    "id_sku", "print_datetime", "code", "additional_info", "color", "special_symbols", "frame_timestamp",
    "x_min", "y_min", "x_max", "y_max", "qr_code_barcode", "price1_qr", "price2_qr", "price3_qr", "price4_qr",
    "wholesale_level_1_count", "wholesale_level_1_price", "wholesale_level_2_count", "wholesale_level_2_price",
    "action_price_qr", "action_code_qr", "raw_qr_data",
)

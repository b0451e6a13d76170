"""Product catalog: reading, and looking names up by barcode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, encoding: str = "windows-1251") -> DataFrame:
    """``row_no``, ``fullname`` and ``code`` of a ``;`` file with a header. Reading again is a reload.

    Spark's reader takes few encodings, so bytes are read as Latin-1, which keeps each as one character,
    and the upper half is then translated to the single-byte ``encoding``; bytes that it lacks become
    replacement characters. Row numbers order rows by file, part of the file, and place there.
    """
    raw = spark.read.csv(path, sep=";", encoding="ISO-8859-1", header=True, schema="fullname string, code string", enforceSchema=True)
    upper = bytes(range(128, 256))
    there, meant = upper.decode("latin-1"), "".join(bytes([b]).decode(encoding, "replace") for b in upper)
    columns = [F.translate(c, there, meant).alias(c) for c in ("fullname", "code")]
    row_no = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))
    return raw.select(row_no.alias("row_no"), *columns)


def entries(catalog: DataFrame) -> DataFrame:
    """One row per code, trimmed and non-blank; of equal codes the last row."""
    trimmed = catalog.select("row_no", F.trim("fullname").alias("fullname"), F.trim("code").alias("code"))
    return trimmed.where("code <> '' and fullname <> ''").groupBy("code").agg(F.max_by("fullname", "row_no").alias("fullname"))


def _padded(code: Column) -> Column:
    return F.when(F.length(code) >= 13, code).otherwise(F.lpad(code, 13, "0"))


def lookup(rows: DataFrame, catalog: DataFrame, code: str = "code", name: str = "fullname") -> DataFrame:
    """``rows`` with the catalog's name for a code: as it is, without leading zeros, or padded to 13.

    Only distinct codes are looked up: each asks for its three forms and takes the first that is there. The
    answers are joined back, so rows move once, or never where the answers are few enough to be sent to them.
    """
    c = F.col("_c")
    forms = F.array_distinct(F.array(c, F.regexp_replace(c, "^0+", ""), _padded(c)))
    asked = rows.select(F.col(code).alias("_c")).where("_c is not null").distinct().select("_c", F.posexplode(forms).alias("_p", "_f"))
    found = asked.join(entries(catalog).select(F.col("code").alias("_f"), F.col("fullname").alias("_n")), "_f")
    best = found.groupBy("_c").agg(F.min_by("_n", "_p").alias(name))
    return rows.withColumn("_c", F.col(code)).join(best, "_c", "left").drop("_c")


def fill_names(rows: DataFrame, catalog: DataFrame, ocr_code: str | None = None) -> DataFrame:
    """Blank product names looked up by the row's barcode, or by the OCR one where that is blank."""
    parts = [F.nullif(F.col("barcode"), F.lit("")), *([F.nullif(F.col(ocr_code), F.lit(""))] if ocr_code else [])]
    asked = rows.withColumn("_ask", F.when(F.coalesce(F.col("product_name"), F.lit("")) == "", F.coalesce(*parts)))
    found = lookup(asked, catalog, "_ask", "_name")
    return found.withColumn("product_name", F.coalesce(F.nullif(F.col("product_name"), F.lit("")), F.col("_name"), F.lit(""))).drop("_ask", "_name")

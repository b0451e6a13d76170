"""Text and CSV files: label lines in, label files, lists and export rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.schema import EXPORT_COLUMNS


def read_labels(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Lines of all label files below ``path`` with their numbers. A label file is read as a whole, since
    a line's number within it matters; these files hold one image's boxes each."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "line"))
    return lines.select(F.lit(split).alias("split"), "file", "line_no", "line")


def write_labels(labels: DataFrame, path: str, per_file: bool = False) -> None:
    """Label lines as a new data set; nothing is changed in place. Its rows have the ``file`` and its whole text as ``value``, one folder
    per split; ``per_file`` gives text files instead, in a folder for each file, for few files."""
    lines = labels.groupBy("split", "file").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))  # one image's boxes
    whole = lines.select("split", "file", F.concat_ws("\n", F.transform("l", lambda x: x["line"])).alias("value"))
    whole.write.partitionBy("split", "file").text(path) if per_file else whole.write.partitionBy("split").parquet(path)


def write_list(paths: DataFrame, target: str, n: int = 300, column: str = "path") -> None:
    """The first ``n`` paths in order, one per line."""
    paths.orderBy(column).limit(n).select(F.col(column).alias("value")).coalesce(1).write.text(target)


def write_export(rows: DataFrame, path: str, single: bool = False, bom: bool = False) -> None:
    """Export rows as CSV with a header; unknown columns are left out. ``single``: one file, for small
    results; ``bom``: a byte order mark before the first header."""
    out = rows.select(*EXPORT_COLUMNS)
    if bom:
        out = out.withColumnRenamed(EXPORT_COLUMNS[0], "\ufeff" + EXPORT_COLUMNS[0])
    (out.coalesce(1) if single else out).write.csv(path, header=True, emptyValue="", encoding="UTF-8")


def image_paths(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes of image files; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,bmp,webp}").load(path).select("path", "length")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE_ROWS = 256
#: Bytes of an Arrow batch, and of a row group of an intermediate table, which a writer holds in memory.
BATCH_BYTES, GROUP_BYTES = 4 << 20, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[list[list]]:
    """Columns of each small slice as Python lists, so that few texts are held as objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [column.to_pylist() for column in part.columns]
    released()


def released() -> None:
    """Give memory that a task no longer uses back to the system, since the worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library of Linux has it
        trim(0)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Arrow batches of at most ``BATCH_BYTES`` to Python, so that a task's
    memory in the JVM and in Python is bounded whatever the texts' length."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, None)
    if now is None or not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def numbered(df: DataFrame) -> DataFrame:
    """``bounded(df)`` with columns named by position, since names with dots cannot be sent to Python."""
    return bounded(df.toDF(*(f"_c{i}" for i in range(len(df.columns)))))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the master is local (tests) may that setting be absent: a folder of this process then serves.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"/tmp/tagloom-{os.getpid()}/shared"
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tagloom-{uuid4().hex}"


#: Paths of tables written within each ``scratch`` of a thread, the innermost last.
_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written within go when it ends, but for those taken off the list that it gives, the last written last."""
    made: list[str] = []
    token = _MADE.set((*_MADE.get(), made))
    try:
        yield made
    finally:
        _MADE.reset(token)
        for path in made:
            _drop(spark, path)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and outlives lost executors. It goes with the ``scratch``
    it is made in, or when the application ends."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    if around := _MADE.get():
        around[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``: file sizes for a scan. Used only to choose partition counts."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def prefix_sums(df: DataFrame, order: str, value: str, out: str, by: tuple[str, ...] = (), per: int = 1024) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over rows of the same ``by`` with a smaller ``order``, a whole number
    from 0 that is distinct within ``by``.

    Summed are stretches of ``per`` numbers and rows within each, so a task sorts the stretches of a key or one
    stretch, never all rows of a key. ``df`` is read twice and should be a table.
    """
    cut = df.withColumn("_stretch", F.floor(F.col(order) / per))
    earlier = lambda window: F.coalesce(F.sum(value).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = cut.groupBy(*by, "_stretch").agg(F.sum(value).alias(value))
    before = sums.select(*by, "_stretch", earlier(W.partitionBy(*by).orderBy("_stretch")).alias("_of_stretches"))
    inside = cut.withColumn("_of_rows", earlier(W.partitionBy(*by, "_stretch").orderBy(order)))
    return inside.join(before, [*by, "_stretch"]).withColumn(out, F.col("_of_stretches") + F.col("_of_rows")).drop("_of_stretches", "_of_rows", "_stretch")


def numbered_out(df: DataFrame, n: str, out: str, per: int = 1 << 14) -> DataFrame:
    """Each row of ``df`` as often as its ``n`` says, with ``out`` from 0 to n - 1, dealt to tasks in stretches of ``per``."""
    cut = df.withColumn("_stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / per))))
    low = F.col("_stretch") * per
    return cut.repartition("_stretch", *df.columns).withColumn(out, F.explode(F.sequence(low, F.least(low + per, F.col(n)) - 1))).drop("_stretch")

"""Names from a catalog that changes while a stream runs: every micro-batch uses the catalog as it is then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tagloom.sources.catalog import fill_names

#: Gives the catalog of now, as a table; it is asked once for each micro-batch.
Catalog = Callable[[], DataFrame]


def named_batches(rows: DataFrame, catalog: Catalog, write: Callable[[DataFrame, int], None], version_col: str | None = None) -> DataStreamWriter:
    """A writer of ``rows``, whose blank names are filled from the catalog of each micro-batch and given to ``write`` with its number.

    A micro-batch has one version of the catalog from its beginning to its end; a changed one is used from the next
    on. ``version_col`` adds the number of the micro-batch that a row was filled in.
    """

    def step(batch: DataFrame, number: int) -> None:
        named = fill_names(batch, catalog())
        write(named.withColumn(version_col, F.lit(number)) if version_col else named, number)

    return rows.writeStream.foreachBatch(step)

"""Counters and throughput of running queries, from metrics that Spark observes while they run."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "tagloom"


def counted(tracks: DataFrame) -> DataFrame:
    """``tracks`` (of the frame pipeline) as they are; hits of known tracks, new tracks and rows where the
    detector ran are counted as rows pass by, in batch or on a stream."""
    metrics = [F.count_if(~F.col("is_new")).alias("tracked_hits"), F.count_if("is_new").alias("new_tracks"), F.count("*").alias("rows")]
    return tracks.observe(NAME, *metrics)


class Progress(StreamingQueryListener):
    """Sums what ``counted`` observes over the micro-batches of each query, by its name, with the rows read and the seconds
    spent. Register with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, float]] = {}
        self.ended: set[str] = set()
        self._ids: dict[str, str] = {}
        self._lock = Lock()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._ids[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (p.observedMetrics or {}).get(NAME)
        with self._lock:
            total = self.totals.setdefault(p.name or str(p.id), {"tracked_hits": 0, "new_tracks": 0, "rows": 0, "input_rows": 0, "seconds": 0.0})
            for k in ("tracked_hits", "new_tracks", "rows") if row is not None else ():
                total[k] += row[k]
            total["input_rows"] += p.numInputRows
            total["seconds"] += p.batchDuration / 1000

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self.ended.add(self._ids.get(str(event.id), str(event.id)))

    def per_second(self, name: str) -> float:
        """Input rows a second of a query so far, 0 while no time was spent."""
        with self._lock:
            total = self.totals.get(name, {})
            return total["input_rows"] / total["seconds"] if total.get("seconds") else 0.0

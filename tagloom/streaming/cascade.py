"""The frame pipeline on a stream: merging, model gating and tracking with state per video, which timers end.

Each video has a value state (last frame, next track, frames since the detector ran) and a list state of its live
tracks; stale tracks leave it as in batch. A video that has been silent for ``idle`` gets its state cleared when its timer
expires, so the store holds videos that are running only; if it starts again, it starts anew.

A frame that comes after a later one of its video was seen is late and left out. What one video sends in one micro-batch is put in
frame order in a task; size micro-batches (files or offsets a trigger) for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tagloom import config
from tagloom.operators.tracking import OUT, TagTracker, Track, TrackerState, seen_frame

_INPUT = ["frame_id", "det_ord", "x1", "y1", "x2", "y2", "conf", "source"]
_OUTPUT = f"{OUT}, ran_model boolean, n_seen int"
_NAMES = [c.split()[0] for c in _OUTPUT.split(", ")]
AT = "last_frame bigint, next_id bigint, cooldown bigint"
TRACK = "track_id bigint, x1 double, y1 double, x2 double, y2 double, conf double, tag_type string, first_seen bigint, last_seen bigint, missed bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _overlap(a: tuple, b: tuple) -> float:
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h + 1e-6)


def merged_boxes(rows: list[tuple], with_model: bool, threshold: float) -> list[tuple]:
    """Boxes of one frame (order, box, conf, source) merged as in batch: the detector's first, if it ran, then colour boxes
    that overlap none of them, suppressed among themselves. Gives (rank, box, conf, type)."""
    cut = [(o, *(float(int(v)) for v in box), conf, source) for o, *box, conf, source in rows]
    out = [(*r[1:6], "yolo") for r in sorted(cut) if r[6] == "yolo"] if with_model else []
    model = len(out)
    for r in sorted((r for r in cut if r[6] != "yolo"), key=lambda r: (-r[5], r[0])):
        if all(_overlap(r[1:5], m[:4]) < threshold for m in out[:model]) and all(_overlap(r[1:5], m[:4]) < threshold for m in out[model:]):
            out.append((*r[1:6], "color"))
    return [(k, *r) for k, r in enumerate(out)]


class CascadeProcessor(StatefulProcessor):
    def __init__(self, settings: config.Settings, idle_ms: int):
        self.settings, self.idle_ms = settings, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at, self.tracks = handle.getValueState("at", AT), handle.getListState("tracks", TRACK)

    def _load(self) -> tuple[int | None, TagTracker]:
        if not self.at.exists():
            return None, TagTracker(self.settings.tracker)
        last, next_id, cooldown = self.at.get()
        tracks = [Track(i, tuple(box), conf, kind, first, seen, missed) for i, *box, conf, kind, first, seen, missed in self.tracks.get()]
        return last, TagTracker(self.settings.tracker, TrackerState(tracks, next_id, cooldown))

    def _save(self, last: int, state: TrackerState) -> None:
        self.at.update((last, state.next_id, state.cooldown))
        rows = [(t.track_id, *map(float, t.box), float(t.conf), t.tag_type, t.first_seen, t.last_seen, t.missed) for t in state.tracks]
        self.tracks.put(rows) if rows else self.tracks.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames: dict[int, list[tuple]] = {}
        for pdf in rows:
            for frame, order, *rest in pdf[_INPUT].itertuples(index=False, name=None):
                boxes = frames.setdefault(int(frame), [])
                if order is not None and not pd.isna(order):
                    boxes.append((int(order), *rest))
        last, tracker = self._load()
        out: list[tuple] = []
        for frame in sorted(frames):
            if last is not None and frame <= last:
                continue
            run = tracker.should_detect(self.settings.cascade)
            if run:
                tracker.detected()
            made, seen = seen_frame(tracker, key[0], frame, merged_boxes(frames[frame], run, self.settings.cascade.merge_iou))
            out += [(*r, run, seen) for r in made]
            last = frame
        if last is not None:
            self._save(last, tracker.state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.at.clear()
        self.tracks.clear()
        yield pd.DataFrame([], columns=_NAMES)

    def close(self) -> None:
        pass


def prepared(spark: SparkSession) -> None:
    """Keep states in RocksDB, which states of this kind need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def cascade_stream(rows: DataFrame, settings: config.Settings = config.Settings(), idle: float = 3600.0) -> DataFrame:
    """Rows of ``tracking.cascade`` for a stream. ``rows``: detections of all frames (video_id, frame_id, det_ord, x1 to y2, conf,
    source), an empty frame as one row with a null ``det_ord``. ``idle``: seconds after which a silent video's state goes.

    Timers expire in micro-batches, also in those without data. A query that ends when its input does
    (``availableNow``) has to go without the latter: set spark.sql.streaming.noDataMicroBatches.enabled to false.
    """
    prepared(rows.sparkSession)
    source = rows.select("video_id", *_INPUT)
    return source.groupBy("video_id").transformWithStateInPandas(CascadeProcessor(settings, int(idle * 1000)), _OUTPUT, "append", "processingTime")

"""Tracking on a stream: one state per video, in frame order within and across micro-batches.

A frame that comes after a later one of its video was seen is late and left out. Eviction is by missed
frames, as in batch tracking, so states stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagloom import config
from tagloom.operators.tracking import OUT, TagTracker, Track, TrackerState, _frames_of, track_frame

_NAMES = [c.split()[0] for c in OUT.split(", ")]
STATE = (
    "last_frame bigint, next_id bigint, track_id array<bigint>, box array<array<double>>, conf array<double>, tag_type array<string>, "
    "first_seen array<bigint>, last_seen array<bigint>, missed array<bigint>"
)
_COLUMNS = ["x1", "y1", "x2", "y2", "conf", "tag_type"]


def _load(state: GroupState) -> tuple[int | None, TrackerState]:
    if not state.exists:
        return None, TrackerState()
    last, next_id, *columns = state.get
    tracks = [Track(int(i), tuple(map(float, b)), float(c), k, int(f), int(s), int(m)) for i, b, c, k, f, s, m in zip(*columns)]
    return int(last), TrackerState(tracks, int(next_id))


def _save(state: GroupState, last: int, tracker: TrackerState) -> None:
    t = tracker.tracks
    state.update((last, tracker.next_id, [x.track_id for x in t], [list(x.box) for x in t], [x.conf for x in t], [x.tag_type for x in t], [x.first_seen for x in t], [x.last_seen for x in t], [x.missed for x in t]))


def track_stream(rows: DataFrame, settings: config.Tracker = config.Tracker()) -> DataFrame:
    """``rows``: detections of all frames, an empty frame as one row with a null ``det_ord``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(batches)).sort_values(["frame_id", "det_ord"], kind="stable")  # one video's part of a micro-batch
        last, held = _load(state)
        tracker, out = TagTracker(settings, held), []
        for video, frame, boxes in _frames_of(iter([whole]), _COLUMNS):
            if last is not None and frame <= last:
                continue
            out += track_frame(tracker, video, frame, boxes)
            last = frame
        if last is not None:
            _save(state, last, tracker.state)
        yield pd.DataFrame(out, columns=_NAMES)

    source = rows.select("video_id", "frame_id", "det_ord", *_COLUMNS)
    return source.groupBy("video_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

"""Tracking of tags over ordered frames.

Frames of a video depend on each other, so a video is one ordered stream within a task: rows are dealt
by video, sorted by frame, and walked with a small state, never gathered. Empty frames advance the
missed counts, so detections are joined from the frames table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom import config
from tagloom.functions.geometry import boosted, expand_crop
from tagloom.operators.assignment import best_assignment
from tagloom.operators.frames import target_confidence
from tagloom.operators.nms import merge_sources, suppress

EPS = 1e-6


@dataclass
class Track:
    track_id: int
    box: tuple[float, float, float, float]
    conf: float
    tag_type: str
    first_seen: int
    last_seen: int
    missed: int = 0

    @property
    def age(self) -> int:
        return self.last_seen - self.first_seen


@dataclass
class TrackerState:
    tracks: list[Track] = field(default_factory=list)
    next_id: int = 0
    cooldown: int = 0


def scores(a: np.ndarray, b: np.ndarray, distance: float, ratio: float) -> np.ndarray:
    """Match score of all pairs of boxes (rows x1, y1, x2, y2); -1 for incompatible ones."""
    a, b = a[:, None, :], b[None, :, :]
    wa, ha, wb, hb = a[..., 2] - a[..., 0], a[..., 3] - a[..., 1], b[..., 2] - b[..., 0], b[..., 3] - b[..., 1]
    dx, dy = ((a[..., i] + a[..., i + 2]) / 2 - (b[..., i] + b[..., i + 2]) / 2 for i in (0, 1))
    d = np.sqrt(dx**2 + dy**2) / ((wa + ha + wb + hb) / 4 + EPS)
    r = np.minimum(wa * ha, wb * hb) / (np.maximum(wa * ha, wb * hb) + EPS)
    return np.where((d > distance) | (r < ratio), -1.0, r * (1 - d / distance))


class TagTracker:
    """State of one video, moved on frame by frame."""

    def __init__(self, settings: config.Tracker = config.Tracker(), state: TrackerState | None = None):
        self.settings, self.state = settings, state or TrackerState()

    @property
    def active(self) -> list[Track]:
        return [t for t in self.state.tracks if t.missed <= self.settings.max_frames_missed]

    def reset(self) -> None:
        self.state = TrackerState()

    def _create(self, found: list[tuple], frame: int) -> list[Track]:
        made = []
        for *corners, conf, kind in found:
            made.append(Track(self.state.next_id, tuple(float(int(v)) for v in corners), conf, kind, frame, frame))
            self.state.next_id += 1
        self.state.tracks += made
        return made

    def update(self, found: list[tuple], frame: int) -> tuple[list[Track], list[Track], dict[int, int]]:
        """Boxes (x1, y1, x2, y2, conf, type) of one frame. Returns new tracks, tracks that are active
        afterwards, and the position of the box that each matched or new track has now."""
        active, place = self.active, {}
        if found and not active:
            new = self._create(found, frame)
            return new, [], {t.track_id: i for i, t in enumerate(new)}
        pairs = []
        if found:
            table = scores(np.array([t.box for t in active]), np.array([f[:4] for f in found], float), self.settings.center_dist_thresh, self.settings.size_ratio_thresh)
            pairs = [(i, j) for i, j in best_assignment(table) if table[i, j] > 0]
        for i, j in pairs:
            t, (*corners, conf, kind) = active[i], found[j]
            t.box, t.conf, t.tag_type, t.last_seen, t.missed = tuple(map(float, corners)), max(t.conf, conf), kind, frame, 0
            place[t.track_id] = j
        hit, taken = {i for i, _ in pairs}, {j for _, j in pairs}
        for i, t in enumerate(active):
            if i not in hit:
                t.missed += 1
        free = [j for j in range(len(found)) if j not in taken]
        new = self._create([found[j] for j in free], frame)
        place |= {t.track_id: j for t, j in zip(new, free)}
        self.state.tracks = self.active
        return new, self.active, place

    def should_detect(self, cascade: config.Cascade) -> bool:
        """Whether the detector is to run on the next frame: not while tracks are sure and it ran lately."""
        run = True
        if cascade.adaptive_yolo:
            if self.state.cooldown < cascade.yolo_force_interval:
                sure = any(t.age >= 3 and t.missed == 0 for t in self.active)
                run = not (sure and self.state.cooldown < cascade.yolo_skip_frames)
            self.state.cooldown += 1
        return run

    def detected(self) -> None:
        self.state.cooldown = 0


def pack_state(state: TrackerState) -> dict:
    return asdict(state)


def unpack_state(raw: dict) -> TrackerState:
    return TrackerState([Track(**(t | {"box": tuple(t["box"])})) for t in raw["tracks"]], raw["next_id"], raw["cooldown"])


OUT = (
    "video_id bigint, frame_id bigint, det_ord int, track_id bigint, is_new boolean, matched boolean, x1 double, y1 double, x2 double, y2 double, "
    "conf double, tag_type string, first_seen bigint, last_seen bigint, missed int"
)
_NAMES = [c.split()[0] for c in OUT.split(", ")]


def track_frame(tracker: TagTracker, video: int, frame: int, rows: list[tuple]) -> list[tuple]:
    """Output rows of one frame: every track that is active or new, with the box that it took (``det_ord``)."""
    return seen_frame(tracker, video, frame, rows)[0]


def seen_frame(tracker: TagTracker, video: int, frame: int, rows: list[tuple]) -> tuple[list[tuple], int]:
    """Output rows of one frame, and its boxes and active tracks counted together. New tracks are active
    ones too if others were there before."""
    new, active, place = tracker.update([r[1:] for r in rows], frame)
    fresh = {t.track_id for t in new}
    every = active + [t for t in new if t.track_id not in {a.track_id for a in active}]
    return [
        (video, frame, rows[place[t.track_id]][0] if t.track_id in place else None, t.track_id, t.track_id in fresh, t.track_id in place, *t.box, t.conf, t.tag_type, t.first_seen, t.last_seen, t.missed)
        for t in every
    ], len(rows) + len(active)


def _frames_of(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[int, int, list[tuple]]]:
    """(video, frame, rows) over sorted batches; a frame may go on in the next batch, and may be empty (null ordinal)."""
    key, rows = None, []
    for pdf in batches:
        for video, frame, order, *rest in pdf[["video_id", "frame_id", "det_ord", *columns]].itertuples(index=False, name=None):
            if (video, frame) != key:
                if key is not None:
                    yield *key, rows
                key, rows = (video, frame), []
            if order is not None and not pd.isna(order):
                rows.append((int(order), *rest))
    if key is not None:
        yield *key, rows


def _ordered(detections: DataFrame, frames: DataFrame, columns: list[str]) -> DataFrame:
    whole = frames.select("video_id", "frame_id").join(detections.select("video_id", "frame_id", "det_ord", *columns), ["video_id", "frame_id"], "left")
    return whole.repartition("video_id").sortWithinPartitions("video_id", "frame_id", "det_ord")


def track(detections: DataFrame, frames: DataFrame, settings: config.Tracker = config.Tracker()) -> DataFrame:
    """Tracks of every frame of ``frames``. Columns as in ``OUT``."""
    columns = ["x1", "y1", "x2", "y2", "conf", "tag_type"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, tracker, held = None, TagTracker(settings), []
        for v, frame, rows in _frames_of(batches, columns):
            if v != video:
                video, tracker = v, TagTracker(settings)
            held += track_frame(tracker, v, frame, rows)
            if len(held) >= 4096:
                yield pd.DataFrame(held, columns=_NAMES)
                held = []
        if held:
            yield pd.DataFrame(held, columns=_NAMES)

    return _ordered(detections, frames, columns).mapInPandas(run, OUT)


def summary(tracks: DataFrame) -> DataFrame:
    """One row per track: first and last frame seen, boxes, highest confidence."""
    return tracks.where("matched").groupBy("video_id", "track_id").agg(F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.count("*").alias("boxes"), F.max("conf").alias("max_conf"))


def emitted(tracks: DataFrame, boost: config.Boost = config.Boost(), compat: bool = False) -> DataFrame:
    """What a frame gives: known tracks with raised confidence, and new ones as they are. ``compat`` gives
    a new track also as a known one, unless no other track is there."""
    known = tracks.where("not is_new") if not compat else tracks.withColumn("_o", F.count_if(~F.col("is_new")).over(_frame())).where("not is_new or _o > 0").drop("_o")
    age = F.col("last_seen") - F.col("first_seen")
    columns = ["video_id", "frame_id", "track_id", "x1", "y1", "x2", "y2", "tag_type", "missed"]
    a = known.select(*columns, boosted(F.col("conf"), age, boost.per_frame, boost.max_boost, boost.enabled).alias("conf"), F.lit(True).alias("tracked"))
    return a.unionByName(tracks.where("is_new").select(*columns, "conf", F.lit(False).alias("tracked")))


def _frame():
    from pyspark.sql.window import Window

    return Window.partitionBy("video_id", "frame_id")


def cascade(detections: DataFrame, frames: DataFrame, settings: config.Settings = config.Settings()) -> DataFrame:
    """The frame pipeline: sources merged, the detector's boxes left out while it rests, tracked.
    Both merges of a frame (with the detector, and colour alone) are made by Spark; the state picks one.
    Columns as in ``OUT``, ``ran_model``, and ``n_seen``: the frame's boxes and active tracks."""
    keys = ["video_id", "frame_id"]
    columns = ["x1", "y1", "x2", "y2", "conf"]
    # corners are cut to whole pixels before boxes are merged
    base = detections.select(*keys, "det_ord", *(F.col(c).cast("long").cast("double").alias(c) for c in columns[:4]), "conf", "source")
    full = merge_sources(base, keys, settings.cascade.merge_iou).select(*keys, F.col("rank").alias("det_ord"), *columns, F.when(F.col("source") == "yolo", "yolo").otherwise("color").alias("tag_type"), F.lit(True).alias("full"))
    alone = suppress(base.where("source <> 'yolo'"), keys, settings.cascade.merge_iou)
    from pyspark.sql.window import Window

    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("conf"), "det_ord")) - 1
    alone = alone.withColumn("det_ord", order).select(*keys, "det_ord", *columns, F.lit("color").alias("tag_type"), F.lit(False).alias("full"))
    both = full.unionByName(alone)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, tracker, held = None, TagTracker(settings.tracker), []
        for v, frame, rows in _frames_of(batches, [*columns, "tag_type", "full"]):
            if v != video:
                video, tracker = v, TagTracker(settings.tracker)
            run_model = tracker.should_detect(settings.cascade)
            if run_model:
                tracker.detected()
            mine = [r[:-1] for r in rows if bool(r[-1]) == run_model]
            made, seen = seen_frame(tracker, v, frame, mine)
            held += [(*r, run_model, seen) for r in made]
            if len(held) >= 4096:
                yield pd.DataFrame(held, columns=[*_NAMES, "ran_model", "n_seen"])
                held = []
        if held:
            yield pd.DataFrame(held, columns=[*_NAMES, "ran_model", "n_seen"])

    return _ordered(both, frames, [*columns, "tag_type", "full"]).mapInPandas(run, f"{OUT}, ran_model boolean, n_seen int")


def results(tracks: DataFrame, lines: DataFrame, frames: DataFrame, boost: config.Boost = config.Boost(), factor: int = 5, compat: bool = False) -> DataFrame:
    """What every frame gives (``emitted``), with the ``texts`` of each tag.

    ``lines`` (video_id, frame_id, line_no, x, y, text) is what there is to read in a frame; ``frames`` has frame_w and
    frame_h. A tag is read where it was found, from the lines within its widened box, until something was
    read; that reading stays with its track.
    """
    keys = ["video_id", "frame_id"]
    found = tracks.where("matched or is_new").join(frames.select(*keys, "frame_w", "frame_h"), keys)
    crop = expand_crop(F.struct(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), F.col("frame_w"), F.col("frame_h"), factor)
    found = found.select(*keys, "track_id", crop.alias("_b"))
    near = found.join(lines.where("text <> ''"), keys).where(F.col("x").between(F.col("_b.x1"), F.col("_b.x2") - 1) & F.col("y").between(F.col("_b.y1"), F.col("_b.y2") - 1))
    item = F.struct("line_no", "text")
    read = near.groupBy(*keys, "track_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda r: r["text"]).alias("_t"))
    first = read.groupBy("video_id", "track_id").agg(F.min(F.struct("frame_id", "_t")).alias("_r"))  # a row a track: the first reading
    first = first.select("video_id", "track_id", F.col("_r.frame_id").alias("_since"), F.col("_r._t").alias("_t"))
    out = emitted(tracks, boost, compat).join(first, ["video_id", "track_id"], "left")
    texts = F.when(F.col("frame_id") >= F.col("_since"), F.col("_t")).otherwise(F.array().cast("array<string>"))
    return out.select(*keys, "track_id", "x1", "y1", "x2", "y2", "conf", "tag_type", "tracked", texts.alias("texts"))


def aimed_confidence(tracks: DataFrame, frames: DataFrame, **limits: float) -> DataFrame:
    """Per frame of the pipeline the number of boxes and active tracks (``n_seen``), its median over the last frames, and the
    confidence that the detector should aim at (``target_confidence``); ``smoothed`` folds them."""
    counts = tracks.groupBy("video_id", "frame_id").agg(F.max("n_seen").alias("n"))
    every = frames.select("video_id", "frame_id").distinct().join(counts, ["video_id", "frame_id"], "left").fillna(0, ["n"])
    return target_confidence(every, **limits)


def counters(tracks: DataFrame) -> DataFrame:
    """Per video: tracked hits, new tracks, and tracks active at the end."""
    last = tracks.groupBy("video_id").agg(F.max("frame_id").alias("_last"))
    out = tracks.join(last, "video_id")
    return out.groupBy("video_id").agg(F.count_if(~F.col("is_new")).alias("tracked_hits"), F.count_if("is_new").alias("new_tracks"), F.count_if(F.col("frame_id") == F.col("_last")).alias("active_tags"))

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom import config
from tagloom.operators import tracking
from tagloom.operators.assignment import best_assignment
from tagloom.operators.tracking import TagTracker
from tagloom.plans import fixtures as fx
from tagloom.streaming.tracking import track_stream

BOX = (0, 0, 100, 100, 0.5, "color")


def test_assignment_is_best():
    assert best_assignment(np.array([[0.9, 0.1], [0.5, -1]])) == [(0, 1), (1, 0)]
    rng = np.random.default_rng(0)
    for _ in range(200):
        r, c = map(int, rng.integers(1, 6, 2))
        s = np.round(rng.random((r, c)) * 2 - 1, 3)
        pairs = best_assignment(s)
        small, big = sorted((r, c))
        t = s if r <= c else s.T
        assert sum(s[p] for p in pairs) == pytest.approx(max(sum(t[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small)))


def test_lifecycle():
    t = TagTracker(config.Tracker(2.0, 0.25, 2))
    new, active, _ = t.update([BOX, (500, 500, 600, 600, 0.5, "color")], 1)
    assert [x.track_id for x in new] == [0, 1] and active == []
    new, active, _ = t.update([(5, 0, 105, 100, 0.9, "yolo")], 2)
    assert new == [] and active[0].conf == 0.9 and active[0].tag_type == "yolo" and active[1].missed == 1
    for f in (3, 4, 5):
        t.update([], f)
    assert t.active == []
    t = TagTracker(config.Tracker(2.0, 0.25, 1))
    t.update([BOX], 1)
    t.update([], 2)
    t.update([], 3)
    assert [x.track_id for x in t.update([BOX], 4)[0]] == [1]


def test_gating():
    t, cascade = TagTracker(config.Tracker()), config.Cascade()
    ran = []
    for frame in range(1, 16):
        ran.append(t.should_detect(cascade))
        if ran[-1]:
            t.detected()
        t.update([BOX], frame)
    assert ran[:4] == [True] * 4 and not all(ran) and max(len(list(g)) for k, g in itertools.groupby(ran) if not k) == 5


def test_pipeline_equals_simulation(spark, sf_dir):
    found = fx.view(spark, sf_dir, fx.DET).withColumn("video_id", F.lit(1)).withColumn("tag_type", F.lit(""))
    for k, c in enumerate(("x1", "y1", "x2", "y2")):  # fractional corners, which the pipeline cuts
        found = found.withColumn(c, F.col(c) + (F.col("det_ord") % 4) * 0.2 + k * 0.05)
    frames = found.select("video_id", "frame_id").distinct()
    got = {(r.frame_id, r.track_id): (r.ran_model, r.missed, round(r.conf, 6)) for r in tracking.cascade(found, frames).collect()}
    expected = {}
    for (video, frame), f in simulated(found).items():
        for x in {x[0]: x for x in f["every"]}.values():
            expected[frame, x[0]] = (f["run"], x[2], round(x[1], 6))
    assert got == expected and {v[0] for v in got.values()} == {True, False}


def simulated(found):
    """Frame by frame: what the pipeline does with its detections, in plain Python but for the assignment."""
    settings, video_now, t, out = config.Settings(), None, None, {}
    rows = sorted(map(tuple, found.select("video_id", "frame_id", "det_ord", *(F.expr(f"cast(cast({c} as long) as double)").alias(c) for c in ("x1", "y1", "x2", "y2")), "conf", "source").collect()))

    def iou(a, b):
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h + 1e-6)

    for (video, frame), group in itertools.groupby(rows, key=lambda r: r[:2]):
        if video != video_now:
            video_now, t = video, TagTracker(settings.tracker)
        group = [r[1:] for r in group]
        run = t.should_detect(settings.cascade)
        if run:
            t.detected()
        yolo = [(*r[2:7], "yolo") for r in group if r[7] == "yolo"] if run else []
        color = [r for r in sorted(group, key=lambda r: (-r[6], r[1])) if r[7] != "yolo" and all(iou(r[2:6], y[:4]) < 0.45 for y in yolo)]
        stay = []
        for r in color:
            if all(iou(r[2:6], s[:4]) < 0.45 for s in stay):
                stay.append((*r[2:7], "color"))
        new, active, _ = t.update(yolo + stay, frame)
        made = {x.track_id for x in new}
        of = lambda x: (x.track_id, x.conf, x.missed, x.box, x.age, x.tag_type)
        out[video, frame] = {"run": run, "merged": len(yolo + stay), "new": made, "seen": len(yolo + stay) + len(active), "every": [of(x) for x in active + new], "active": [of(x) for x in active]}
    return out


@pytest.mark.parametrize("compat", [False, True])
def test_results_of_frames_equal_the_simulation(spark, sf_dir, compat):
    found = fx.view(spark, sf_dir, fx.DET).withColumn("video_id", F.floor(F.col("frame_id") / 100)).withColumn("tag_type", F.lit(""))
    sizes = fx.view(spark, sf_dir, fx.FRAMES).withColumn("video_id", F.floor(F.col("frame_id") / 100))
    lines = fx.view(spark, sf_dir, fx.FRAME_LINES)
    size = {(r.video_id, r.frame_id): (r.frame_w, r.frame_h) for r in sizes.collect()}
    read = {}
    for r in sorted(lines.collect(), key=lambda r: (r.frame_id, r.line_no)):
        read.setdefault((r.video_id, r.frame_id), []).append((r.x, r.y, r.text))
    cache, expected = {}, []
    for (video, frame), f in simulated(found).items():
        w, h = size[video, frame]

        def reading(box):
            pad = max(64, int(max(box[2] - box[0], box[3] - box[1]) * 4 / 2))
            x1, y1, x2, y2 = int(max(0, box[0] - pad)), int(max(0, box[1] - pad)), int(min(w, box[2] + pad)), int(min(h, box[3] + pad))
            return [t for x, y, t in read.get((video, frame), []) if t and x1 <= x < x2 and y1 <= y < y2]  # noqa: B023

        rows = [(x, True) for x in f["active"] if compat or x[0] not in f["new"]] + [(x, False) for x in {x[0]: x for x in f["every"]}.values() if x[0] in f["new"]]
        for (track, conf, missed, box, age, kind), known in rows:
            if missed == 0 and not cache.get((video, track)):
                cache[video, track] = reading(box)
            shown = min(conf * (1 + min(age * 0.03, 1.3 - 1)), 1.0) if known else conf
            expected.append((frame, track, known, *box, round(shown, 6), kind, tuple(cache.get((video, track), ()))))
    got = [(r.frame_id, r.track_id, r.tracked, r.x1, r.y1, r.x2, r.y2, round(r.conf, 6), r.tag_type, tuple(r.texts)) for r in tracking.results(tracking.cascade(found, sizes), lines, sizes, compat=compat).collect()]
    assert sorted(got) == sorted(expected) and any(r[-1] for r in got) and any(not r[-1] for r in got)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    found = fx.view(spark, sf_dir, fx.TDET).withColumn("tag_type", F.lit("yolo"))
    frames = found.select("video_id").distinct().crossJoin(spark.range(100).select(F.col("id").alias("frame_id")))
    rows = frames.join(found, ["video_id", "frame_id"], "left").select("video_id", "frame_id", "det_ord", "x1", "y1", "x2", "y2", "conf", "tag_type")
    for part in range(4):  # files in frame order, one per micro-batch
        rows.where((F.col("frame_id") >= part * 25) & (F.col("frame_id") < (part + 1) * 25)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    settings = config.Tracker(1.0, 0.25, 15)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = track_stream(stream, settings).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    batch = tracking.track(found, frames, settings)
    columns = ["video_id", "frame_id", "track_id", "det_ord", "is_new", "missed"]
    assert sorted(spark.table("tracked").select(*columns).collect(), key=str) == sorted(batch.select(*columns).collect(), key=str)


def test_emission_twice_on_demand(spark):
    rows = [(1, 1, 0, 7, True), (1, 2, 0, 7, False), (1, 2, 1, 8, True)]
    df = spark.createDataFrame([(v, f, o, t, n, True, 0.0, 0.0, 1.0, 1.0, 0.5, "x", 1, f, 0) for v, f, o, t, n in rows], tracking.OUT)
    assert tracking.emitted(df).count() == 3
    assert tracking.emitted(df, compat=True).count() == 4


def test_confidence_that_the_pipeline_aims_at(spark, sf_dir):
    from tagloom.operators import frames as fr

    found = fx.view(spark, sf_dir, fx.DET).withColumn("video_id", F.floor(F.col("frame_id") / 100)).withColumn("tag_type", F.lit(""))
    frames = found.select("video_id", "frame_id").distinct()
    tracks = tracking.cascade(found, frames)
    counts = {}
    for (video, frame), f in simulated(found).items():
        counts[video, frame] = f["seen"]
    assert any(f["new"] and f["seen"] != f["merged"] for f in simulated(found).values())
    videos, aims = {}, {}
    for video, frame in sorted(map(tuple, frames.collect())):
        videos.setdefault(video, []).append(counts.get((video, frame), 0))
        last = sorted(videos[video][-30:])
        median = (last[(len(last) - 1) // 2] + last[len(last) // 2]) / 2
        if len(videos[video]) >= 5:
            aims.setdefault(video, []).append(0.35 if median < 3 else 0.65 if median > 12 else 0.5)
    got = {r.video_id: r for r in fr.smoothed(tracking.aimed_confidence(tracks, frames)).collect()}
    for video, targets in aims.items():
        value = 0.5
        for t in targets:
            value = value * 0.7 + t * 0.3
        assert got[video].steps == len(targets) and abs(got[video].confidence - value) < 1e-9

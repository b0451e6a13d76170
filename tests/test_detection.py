import numpy as np
import pytest

from tagloom.operators import candidates, detection
from tagloom.plans import catalog
from tagloom.plans import fixtures as fx
from tests.test_pixels import flood


def plain_masks(h, s, v, own):
    if own is None:
        white, red, yellow = (s <= 30) & (v >= 180), ((h <= 8) | (h >= 172)) & (s >= 80) & (v >= 80), (h >= 22) & (h <= 34) & (s >= 100) & (v >= 200)
    else:
        p = lambda x, q: np.percentile(x, q)
        ms, mv = own
        v_low, v_high, s_low, s_high = max(p(mv, 5), 30), min(p(mv, 95), 255), p(ms, 10), min(p(ms, 90), 60)
        white = (s >= int(s_low)) & (s <= int(s_high)) & (v >= int(v_low)) & (v <= int(v_high))
        red = ((h <= 10) | (h >= 170)) & (s >= max(30, int(p(ms, 20)))) & (v >= 50)
        yellow = (h >= 20) & (h <= 35) & (s >= max(40, int(p(ms, 30)))) & (v >= max(120, int(v_high * 0.6)))
    return {"white": white, "red": red, "yellow": yellow}


def closed(m, half):
    fold = lambda m, f: np.array([[f(m[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1]) for x in range(m.shape[1])] for y in range(m.shape[0])])
    return fold(fold(m, np.max), np.min)


@pytest.mark.parametrize("calibrate", [True, False])
def test_boxes_of_pixels(spark, calibrate):
    """Two videos of seven and two frames, from events made here."""
    events = spark.range(9 * 1024).selectExpr("id as event_id")
    events.createOrReplaceTempView("events_of_pixels")
    px = spark.sql(fx.COLOR_GRID.replace("from events", "from events_of_pixels").replace("event_id/6144", "event_id/7168"))
    images = {}
    for r in px.collect():
        images.setdefault((r.video_id, r.frame_id), np.zeros((3, 32, 32), int))[:, r.y, r.x] = r.h, r.s, r.v
    expected = set()
    for video in (0, 1):
        mine = [images[k] for k in sorted(images) if k[0] == video]
        mean = np.floor(np.mean(mine[:5], axis=0)).astype(int) if len(mine) >= 5 else None
        for rank, key in enumerate(sorted(k for k in images if k[0] == video), 1):
            own = (mean[1], mean[2]) if calibrate and mean is not None and rank >= 5 else None
            for color, m in plain_masks(*images[key], own).items():
                for x1, y1, x2, y2, _ in flood(closed(m.astype(int), 1)):
                    w, h = x2 - x1, y2 - y1
                    if w >= 3 and h >= 2 and 0.4 < w / h < 6.0:
                        expected.add((*key, color, x1, y1, x2, y2))
    limits = detection.calibrated(px) if calibrate else None
    boxes = detection.boxes(detection.masks(px, limits), 3, min_w=3, min_h=2)
    got = {(r.video_id, r.frame_id, r.color, int(r.x1), int(r.y1), int(r.x2), int(r.y2)) for r in boxes.collect()}
    assert got == expected and {c for _, _, c, *_ in got} == {"white", "red", "yellow"}
    whole = detection.detect(px, calibrate, size=3, min_w=3, min_h=2)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, candidates.detect(boxes, detection.KEYS).select(whole.columns).collect()))


def test_boxes_are_made_once(spark, sf_dir):
    """Candidates of red, white and yellow need the same boxes, and the three colours the same windows over pixels."""
    plan = catalog.queries()["pixel_candidates"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InArrow ") + plan.count("InPandas ") == 2  # stripes, then frames
    assert plan.count("bit_or(") > 0 and plan.count("FlatMapGroups") == 0

import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions import geometry as geo
from tagloom.operators import nms


def _box(*v):
    return F.struct(*(F.lit(float(x)).alias(c) for x, c in zip(v, ("x1", "y1", "x2", "y2"))))


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("b, expected", [((50, 50, 150, 150), 2500 / 17500), ((25, 25, 75, 75), 0.25), ((100, 0, 200, 100), 0.0), ((0, 0, 100, 100), 1.0)])
def test_iou(spark, b, expected):
    assert _value(spark, geo.iou(_box(0, 0, 100, 100), _box(*b))) == pytest.approx(expected, abs=1e-6)


def test_distance_and_ratio(spark):
    assert _value(spark, geo.center_distance(_box(0, 0, 10, 10), _box(0, 0, 10, 10))) == 0
    assert _value(spark, geo.center_distance(_box(0, 0, 10, 10), _box(100, 100, 110, 110))) > 10
    assert _value(spark, geo.area_ratio(_box(0, 0, 100, 100), _box(0, 0, 70, 70))) == pytest.approx(0.49, abs=1e-6)
    assert _value(spark, geo.area_ratio(_box(0, 0, 0, 0), _box(0, 0, 70, 70))) == pytest.approx(0, abs=1e-6)


def test_expand_crop(spark):
    b = _value(spark, geo.expand_crop(_box(950, 520, 970, 540), F.lit(1920), F.lit(1080), 2))
    assert (b.x1, b.y1, b.x2, b.y2) == (886, 456, 1034, 604)
    b = _value(spark, geo.expand_crop(_box(0, 0, 50, 50), F.lit(640), F.lit(480), 3))
    assert b.x1 == 0 and b.y1 == 0 and b.x2 <= 640 and b.y2 <= 480


def _iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h + 1e-6)


def test_suppression_and_fusion_of_random_boxes(spark):
    rng = random.Random(3)
    rows = [(f, i, *(p := (rng.randint(0, 60), rng.randint(0, 60))), p[0] + rng.randint(10, 60), p[1] + rng.randint(10, 60), rng.randint(1, 6) / 10) for f in range(30) for i in range(rng.randint(0, 12))]
    df = spark.createDataFrame([(f, i, *map(float, r)) for f, i, *r in rows], "frame_id int, det_ord int, x1 double, y1 double, x2 double, y2 double, conf double")
    kept, fused = [], []
    for f in range(30):
        mine = sorted((r for r in rows if r[0] == f), key=lambda r: (-r[6], r[1]))
        stay = []
        for r in mine:
            if all(_iou(r[2:6], s[2:6]) < 0.4 for s in stay):
                stay.append(r)
        kept += [(f, r[1]) for r in stay]
        left = sorted(mine, key=lambda r: (-r[6], -r[1]))
        while left:
            seed = left[0]
            group = [r for r in left if r is seed or _iou(seed[2:6], r[2:6]) >= 0.4]
            left = [r for r in left if r not in group]
            total = sum(r[6] for r in group)
            fused.append((f, len(group), round(sum(r[2] * r[6] for r in group) / total, 5), round(total / len(group), 5)))
    assert sorted((r.frame_id, r.det_ord) for r in nms.suppress(df, ["frame_id"], 0.4).collect()) == sorted(kept)
    assert sorted((r.frame_id, r.members, round(r.x1, 5), round(r.conf, 5)) for r in nms.fuse(df, ["frame_id"], 0.4).collect()) == sorted(fused)


def test_agreement_without_references(spark):
    none = spark.createDataFrame([], "frame_id int, det_ord int, x1 double, y1 double, x2 double, y2 double")
    one = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 9.0)], none.schema)
    got = nms.agreement(nms.first_matches(one, none, ["frame_id"])).first()
    assert (got.tp, got.fp, got.fn, got.precision, got.recall, got.f1) == (0, 1, 0, 0.0, 0.0, 0.0)
    assert nms.agreement(nms.first_matches(none, none, ["frame_id"])).first().total_detections == 0


def test_zero_confidence_is_dropped_in_fusion(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 9.0, 0.0)], "frame_id int, det_ord int, x1 double, y1 double, x2 double, y2 double, conf double")
    assert nms.fuse(df, ["frame_id"], 0.4).count() == 0

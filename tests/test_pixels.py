import math
import random
from collections import Counter

import numpy as np
import pytest

from tagloom.operators import pixels as px
from tagloom.plans import catalog


def frame(spark, *images, key="frame_id"):
    rows = [(k, y, x, int(v)) for k, image in enumerate(images) for y, line in enumerate(image) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, f"{key} long, y int, x int, v int").repartition(4)


def image(df, column="v", key="frame_id"):
    got = {}
    for r in df.collect():
        got.setdefault(r[key], {})[r.y, r.x] = r[column]
    return {k: np.array([[v[y, x] for x in range(max(q for _, q in v) + 1)] for y in range(max(p for p, _ in v) + 1)]) for k, v in got.items()}


def noise(seed, h, w, top=256):
    return np.random.default_rng(seed).integers(0, top, (h, w))


def test_closing_equals_the_stencil(spark):
    a, b = noise(1, 23, 17), (noise(2, 12, 30) > 200) * 255
    for size in (3, 4, 7):
        before, after = size // 2, size - 1 - size // 2

        def fold(m, f, low, high):
            return np.array([[f(m[max(0, y + low) : y + high + 1, max(0, x + low) : x + high + 1]) for x in range(m.shape[1])] for y in range(m.shape[0])])

        got = image(px.closed(frame(spark, a, b), "v", size))
        for k, m in enumerate((a, b)):
            assert (got[k] == fold(fold(m, np.max, -before, after), np.min, -after, before)).all()


def test_otsu(spark):
    images = [noise(1, 20, 20), np.where(noise(2, 20, 30) > 90, noise(3, 20, 30, 40) + 200, noise(4, 20, 30, 40)), np.full((5, 5), 7), np.array([[3, 9]])]
    got = {r.frame_id: r.threshold for r in px.otsu_threshold(frame(spark, *images), "v").collect()}
    for k, m in enumerate(images):
        flat, best = m.ravel().astype(float), (0.0, 0)
        for t in range(256):
            low, high = flat[flat <= t], flat[flat > t]
            if len(low) and len(high):
                between = len(low) * len(high) * (low.mean() - high.mean()) ** 2
                if between > best[0] * (1 + 1e-12):
                    best = between, t
        assert got[k] == best[1]
    out = image(px.otsu(frame(spark, *images), "v"))
    assert (out[1] == (images[1] > got[1]) * 255).all()


def test_adaptive_threshold(spark):
    m, size = noise(5, 19, 26), 11
    w = np.array(px.gaussian_weights(size))
    assert abs(w.sum() - 1) < 1e-12 and math.isclose(w[5] / w[4], math.exp(1 / 8))
    padded = np.pad(m, size // 2, mode="edge").astype(float)
    mean = sum(wy * wx * padded[y : y + 19, x : x + 26] for y, wy in enumerate(w) for x, wx in enumerate(w))
    got = image(px.adaptive_threshold(frame(spark, m), "v"))[0]
    assert (got == np.where(m > np.floor(mean + 0.5) - 2, 255, 0)).all()
    for side in (1, 5, 31):
        half = side // 2
        mean = np.array([[m[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1].mean() for x in range(26)] for y in range(19)])
        assert np.allclose(image(px.box_mean(frame(spark, m), "v", "mean", side), "mean")[0], mean)
    assert set(np.unique(image(px.adaptive_threshold(frame(spark, m), "v", smooth=False))[0])) == {0, 255}


def test_blur_gate(spark):
    sharp, flat, line = noise(6, 9, 14), np.full((6, 6), 80), noise(7, 1, 12)
    got = {r.crop_id: r for r in px.readable(px.sharpness(frame(spark, sharp, flat, line, key="crop_id"), "v"), 10).collect()}
    for k, m in enumerate((sharp, flat, line)):
        wide = np.pad(m, 1, mode="reflect") if min(m.shape) > 1 else np.pad(np.pad(m, ((0, 0), (1, 1)), mode="reflect"), ((1, 1), (0, 0)), mode="edge")
        lap = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * m
        assert math.isclose(got[k].blur, lap.var(), rel_tol=1e-9, abs_tol=1e-9) and (got[k].width, got[k].height) == m.shape[::-1]
    assert [got[k].readable for k in range(3)] == [True, False, False]
    plan = px.sharpness(frame(spark, sharp, key="crop_id"), "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("h, w, tiles", [(32, 32, 8), (24, 40, 4), (21, 34, 4)])
def test_equalisation_equals_a_plain_version(spark, h, w, tiles):
    m = np.where(noise(8, h, w, 100) > 30, noise(9, h, w, 60) + 50, noise(10, h, w))
    ty, tx = math.ceil(h / tiles), math.ceil(w / tiles)
    maps = {}
    for j in range(math.ceil(h / ty)):
        for i in range(math.ceil(w / tx)):
            part = m[j * ty : (j + 1) * ty, i * tx : (i + 1) * tx].ravel()
            counts, limit = Counter(part.tolist()), max(int(3.0 * len(part) / 256), 1)
            bins = [min(counts[v], limit) for v in range(256)]
            over = len(part) - sum(bins)
            bins = [b + over // 256 for b in bins]
            rest, step = over % 256, max(256 // max(over % 256, 1), 1)
            for v in range(0, 256, step):
                if rest > 0:
                    bins[v] += 1
                    rest -= 1
            total, maps[j, i] = 0, []
            for b in bins:
                total += b
                maps[j, i].append(round(total * 255.0 / len(part)))
    got = image(px.equalized(frame(spark, m), "v", 3.0, tiles))[0]
    for y in range(h):
        for x in range(w):
            fy, fx = y / ty - 0.5, x / tx - 0.5
            y0, x0 = max(math.floor(fy), 0), max(math.floor(fx), 0)
            y1, x1 = min(math.floor(fy) + 1, math.ceil(h / ty) - 1), min(math.floor(fx) + 1, math.ceil(w / tx) - 1)
            ay, ax, v = fy - math.floor(fy), fx - math.floor(fx), m[y, x]
            mixed = (maps[y0, x0][v] * (1 - ax) + maps[y0, x1][v] * ax) * (1 - ay) + (maps[y1, x0][v] * (1 - ax) + maps[y1, x1][v] * ax) * ay
            assert got[y, x] == math.floor(round(mixed, 6) + 0.5), (y, x)


def test_equalisation_of_odd_levels(spark):
    """Levels that are null or none of 256 give no pixel: a tile of such alone maps all to 0, one without pixels has no map."""
    rows = [(0, y, x, 255) for y in range(4) for x in range(4)] + [(0, 0, 4, 300), (0, 1, 4, None), (0, 2, 5, -4), (0, 7, 7, 7), (0, 7, 7, 7)]
    got = px.equalized(spark.createDataFrame(rows, "frame_id long, y int, x int, v int"), "v", 3.0, 2)
    expected = {(y, x): 191 if x == 3 else 255 for y in range(4) for x in range(4)} | {(3, 3): 196, (7, 7): 255}
    # 191: three quarters of 255; 196: 0.5625 and 0.0625, of the tile with the last pixel, over 0.8125, as the tile below has none
    assert sorted(map(tuple, got.collect())) == sorted((0, y, x, v) for (y, x), v in expected.items())


def test_equalisation_broadcasts_no_table(spark, sf_dir):
    """Estimates come from compressed files and know no explode, so maps of all tiles were sent to the driver."""
    plan = catalog.queries()["equalized_levels"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def flood(m):
    seen, out = set(), []
    for start in zip(*np.nonzero(m)):
        if start in seen:
            continue
        part, todo = {start}, [start]
        while todo:
            y, x = todo.pop()
            for q in ((y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)):
                if q not in part and 0 <= q[0] < m.shape[0] and 0 <= q[1] < m.shape[1] and m[q]:
                    part.add(q)
                    todo.append(q)
        seen |= part
        ys, xs = zip(*part)
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(part)))
    return sorted(out)


@pytest.mark.parametrize("stripe", [1, 4, 64])
def test_regions_equal_a_flood_fill(spark, stripe):
    masks = [noise(20 + k, 30, 25, 100) < share for k, share in enumerate((15, 35, 45, 60, 100))]
    spiral = np.zeros((21, 21), int)
    for r in range(0, 10, 2):
        spiral[r, r : 21 - r] = spiral[20 - r, r : 21 - r] = spiral[r : 21 - r, 20 - r] = 1
        spiral[r + 2 : 21 - r, r] = 1
    masks += [spiral, np.zeros((4, 4), int)]
    got = {}
    for r in px.regions(frame(spark, *masks), "v", stripe=stripe).collect():
        got.setdefault(r.frame_id, []).append((r.x1, r.y1, r.x2, r.y2, r.pixels))
    for k, m in enumerate(masks):
        assert sorted(got.get(k, [])) == flood(m)


def test_principal_axis(spark):
    m = np.zeros((60, 60), int)
    for t in range(-20, 21):
        for s in (-1, 0, 1):
            m[30 + round(t * math.sin(0.4) + s), 30 + round(t * math.cos(0.4))] = 1
    r = px.principal_axis(frame(spark, m), "v").first()
    ys, xs = np.nonzero(m)
    values, vectors = np.linalg.eigh(np.cov(np.array([xs, ys]), bias=True))
    angle = math.degrees(math.atan2(*vectors[::-1, 1]))
    assert abs((r.angle - angle + 90) % 180 - 90) < 1e-6 and r.pixels == m.sum() and math.isclose(r.mid_x, xs.mean())

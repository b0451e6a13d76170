import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import vector_join as m
from tests.compare import assert_same

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.98):
    good = lambda v, l: l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)  # noqa: E731, E741
    n = len(rows)
    linked = [set() for _ in rows]
    for i, (_, a, p) in enumerate(rows):
        for j, (_, b, q) in enumerate(rows):
            if i < j and p == q and good(a, p) and good(b, q) and len(a) == len(b):
                x, y = ([c / max(map(abs, v)) for c in v] for v in (a, b))
                if math.sumprod(x, y) / (math.sqrt(math.sumprod(x, x)) * math.sqrt(math.sumprod(y, y))) >= threshold:
                    linked[i].add(j)
                    linked[j].add(i)
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        part, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()] - part:
                part.add(j)
                todo.append(j)
        seen |= part
        first = min((rows[k][0] for k in part if rows[k][0] is not None), default=None)
        for k in part:
            out[k] = (rows[k][0], len(linked[k]), first, rows[k][0] == first if rows[k][0] is not None and first is not None else not linked[k] and not good(*rows[k][1:]))
    return sorted(out, key=repr)


def got(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as node", "2 as cell", "3 as raw", "4 as w").repartition(5)
    return sorted(map(tuple, m.near_vectors(df).collect()), key=repr)


def cluster(rng, middle, n, spread):
    return [(middle + rng.normal(0, spread, len(middle))).tolist() for _ in range(n)]


def made(seed=1, dim=12):
    rng = np.random.default_rng(seed)
    vectors = [v for _ in range(12) for v in cluster(rng, rng.normal(size=dim), 9, 0.12)] + rng.normal(size=(60, dim)).tolist()
    vectors += [(np.array(vectors[0]) * 2).tolist(), vectors[3], vectors[3], (np.array(vectors[5]) * 1e-200).tolist(), (np.array(vectors[5]) * 1e200).tolist()]
    base = rng.normal(size=dim)
    vectors += cluster(rng, base, 70, 0.02 * np.linalg.norm(base) / math.sqrt(dim))  # a dense group
    chain = [np.cos(k * 0.19) * np.eye(dim)[0] + np.sin(k * 0.19) * np.eye(dim)[1] for k in range(14)]  # each linked with its neighbours only
    vectors += [v.tolist() for v in chain]
    return [(3 * k + 1, v, k % 2 if k < 100 else 0) for k, v in enumerate(vectors)]


ODD = [(7, None, 0), (8, [], 0), (9, [0.0] * 12, 0), (10, [math.nan] * 12, 0), (11, [math.inf] + [1.0] * 11, 0), (12, [None] + [1.0] * 11, 0), (13, [1.0] * 12, None), (14, [1.0] * 12, None), (15, [1.0, 2.0], 0), (16, [2.0, 4.0], 0), (17, [-0.0, 1.0], 0), (18, [0.0, 1.0], 0)]


@pytest.mark.parametrize("constants", [{}, {"HOMES": 16}, {"HOMES": 8, "COLUMNS": 12, "DEALT": 20}, {"HOMES": 8, "COLUMNS": 12, "LEVELS": 1}, {"HOMES": 6, "COLUMNS": 5, "LEVELS": 0}, {"HOMES": 4, "COLUMNS": 8, "SAMPLE": 12, "PIVOTS": 3}])
def test_equals_brute_force(spark, monkeypatch, constants):
    for name, value in constants.items():
        monkeypatch.setattr(m, name, value)
    rows = made() + ODD + [(4, made()[0][1], 0), (4, [1.0, 2.0], 0), (None, [5.0, 5.0], 3), (None, made()[3][1], 1)]
    assert got(spark, rows) == brute(rows)


def test_given_vectors_equal_sql(spark, sf_dir):
    assert_same(m.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), m.ORACLE, sf_dir)


def test_the_threshold_itself_is_linked(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.98, math.sqrt(1 - 0.98**2)], 1), (3, [0.0, 50.0, 0.0], 1), (4, [math.sqrt(99), 49.0, 0.0], 1)]
    assert got(spark, rows) == brute(rows)


def test_no_pair_is_lost_at_borders():
    rng = np.random.default_rng(3)
    eps = m.reach(m.THRESHOLD)
    x = rng.normal(size=(400, 5))
    x = np.concatenate([x, x + rng.normal(0, 0.1, x.shape) * np.linalg.norm(x, axis=1, keepdims=True) / 3])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    home, cell_of = np.full(len(x), -1), [set() for _ in x]
    pivots = m.choose_pivots(x[:200], 20, eps)
    assert len(pivots) > 3
    for j, (at, is_home, zone) in enumerate(m.deal(x, np.ones(len(x), bool), pivots, eps)):
        home[at[is_home]] = j
        for k in at:
            cell_of[k].add(j)
        core, far = x[at[zone == m.CORE]], x[at[zone == m.FAR]]
        assert (core @ core.T >= m.THRESHOLD).all() and not (core @ far.T >= m.THRESHOLD).any()
    assert (home >= 0).all()
    for i, j in zip(*np.nonzero(x @ x.T >= m.THRESHOLD)):
        assert home[i] in cell_of[j]
    assert np.mean([len(c) for c in cell_of]) < len(pivots) / 2


def test_dense_group_is_not_compared(spark, monkeypatch):
    monkeypatch.setattr(m, "HOMES", 32)
    monkeypatch.setattr(m, "COLUMNS", 64)
    rng = np.random.default_rng(2)
    rows = [(k, v, 1) for k, v in enumerate(cluster(rng, np.ones(8), 500, 0.01))]
    classes = spark.createDataFrame([(1, k, 1, 8, True, m.FAR, False, bytearray(np.array(v).tobytes())) for k, v, _ in rows], m._MEMBER)
    members = m.cells(classes, m.reach(m.THRESHOLD))
    assert {r.zone for r in members.collect()} == {m.CORE}
    sized = members.withColumns({c: F.lit(0 if c[1:].isdigit() and c[1:] != "0" else 500).cast("long") for c in ("members", "h0", "m0", "h1", "m1", "h2", "m2", "lanes")})
    assert m._units(sized).count() == 0
    assert got(spark, rows) == [(k, 499, 0, k == 0) for k in sorted(range(500), key=lambda k: repr((k, 499, 0, k == 0)))]


def test_empty(spark):
    assert got(spark, []) == []

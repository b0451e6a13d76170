import math
import random

import pytest

from tagloom.llm import topk_search as t
from tests.compare import assert_same


def brute(rows, every=50, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(good):
        if q % every == 0:
            best = sorted((-sum(p * r for p, r in zip(x, y)), i) for b, (i, y) in enumerate(good) if b != a)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_whole_table_equals_sql(spark, sf_dir):
    assert_same(t.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), t.ORACLE, sf_dir)


@pytest.mark.parametrize("rows_of_block", [8192, 7])
def test_equals_brute_force(spark, monkeypatch, rows_of_block):
    monkeypatch.setattr(t, "ROWS", rows_of_block)
    rng = random.Random(2)
    rows = [(i, [float(rng.choice([0, 0, -1, 0.5, rng.random()])) for _ in range(6)]) for i in range(0, 300, 3)]
    rows += [(50, [1.0] * 6), (50, [1.0] * 6), (100, [0.0] * 6), (1, [1.0, 2.0]), (2, []), (4, None), (5, [None] * 6), (7, [math.nan] * 6), (8, [math.inf] * 6), (None, [1.0] * 6), (10, [1e5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as block", "3 as query", "4 as rank")
    assert sorted(map(tuple, t.top_k(df).collect())) == brute(rows)


def test_large_weights_stay_exact(spark):
    rows = [(0, [2.0**24, 1.0]), (1, [2.0**20, 3.0]), (2, [2.0**20, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, t.top_k(df).collect())) == brute(rows)

    huge = spark.createDataFrame([(0, [1e300]), (1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in t.top_k(huge).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (2, -(1 << 63))]


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert t.top_k(spark.createDataFrame([], schema)).collect() == []
    assert t.top_k(spark.createDataFrame([(0, [1.0])], schema)).collect() == []
    assert [tuple(r) for r in t.top_k(spark.createDataFrame([(0, [1.0]), (3, [2.0])], schema)).collect()] == [(0, 1, 3, 256 * 512)]

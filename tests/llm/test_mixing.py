import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import mixing as m
from tests.llm.helpers import ODD, docs, with_clashes, words


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """By the rule's own words: targets above the cap stop there, the excess is shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), order
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def test_targets_by_resharing(spark):
    rng = random.Random(5)
    cases = [{"b": 100, "a": 10, None: 1000, "c": 50}, {}, {"x": 0}, {"x": 0, "y": 5}, {"a": 1, "b": 1, "c": 100, "d": 1, "\U0001f600": 7, "\uffee": 3}]
    cases += [{f"k{i}": rng.choice([0, 1, 5, 50, 10_000]) for i in range(rng.randint(1, 9))} for _ in range(6)]
    for case in cases:
        rows = [("n" if s is None else f"s{s}", n) for s, n in case.items()]
        for share, cap in ((1.5, 2.0), (2.5, 2.0)):
            got = {r._s: r.target for r in m.targets(spark.createDataFrame(rows, "_s string, n long"), share=share, cap=cap).collect()}
            expected = plain_targets(case, share=share, cap=cap)
            assert got == pytest.approx({("n" if s is None else f"s{s}"): t for s, t in expected.items()})


def test_permutations(spark):
    for n in (1, 2, 3, 5, 7, 64, 1000, 4099):
        got = [r.p for r in spark.range(n).select(m.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()]
        assert sorted(got) == list(range(n)) and (n < 60 or got != sorted(got))
    two = [[r.p for r in spark.range(50).select(m.permuted(F.col("id"), F.lit(50).cast("long"), F.lit(k)).alias("p")).collect()] for k in (1, 2)]
    assert two[0] != two[1]


def test_tree_has_exact_quotas_and_the_law_of_draws(spark, monkeypatch):
    monkeypatch.setattr(m, "FAN", 3)
    counts = spark.createDataFrame([("sa", 1, 40), ("sa", 0, 7), ("sb", 0, 0), ("n", 2, 13)], "_s string, _pass int, quota long")
    rows = m.quota_tree(counts, 7, 3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, m.quota_tree(counts, 7, 3).collect()))
    by_pass, by_leaf = defaultdict(int), defaultdict(int)
    for r in rows:
        by_pass[r._s, r._pass] += r.quota
        by_leaf[r.leaf] += r.quota
    assert by_pass == {("sa", 1): 40, ("sa", 0): 7, ("n", 2): 13} and set(by_leaf) == set(range(7)) and max(by_leaf.values()) - min(by_leaf.values()) <= 2
    # left halves of 14 and 6 draws: 10 draws each time, hypergeometric by source
    slots = spark.range(3000).select(F.col("id").alias("seed"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("slot"))
    left = slots.select("seed", m.permuted(F.col("slot"), F.lit(20).cast("long"), F.col("seed")).alias("p"))
    draws = np.array([r.n for r in left.groupBy("seed").agg(F.sum((F.col("p") < 10).cast("int")).alias("n")).collect()])
    assert abs(draws.mean() - 3) < 0.07 and abs(draws.var() - 10 * 0.3 * 0.7 * 10 / 19) < 0.09


def _check(rows, texts, sources):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    total = defaultdict(int)
    for i, n in size.items():
        total[sources[i]] += n
    target, taken = plain_targets(dict(total)), defaultdict(int)
    for r in rows:
        s = sources[r.doc_id]
        assert (r.size, r.source_size, r.target) == (size[r.doc_id], total[s], pytest.approx(target[s])) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - round(target[s])) <= 1 for s in target)


def test_takes_what_it_targets(spark, sf_dir):
    table = docs(spark, [*ODD, *(words(i, 1 + i * 3) for i in range(60))], -100).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = {r.doc_id: r for r in table.collect()}
    got = m.mix(with_clashes(table)).collect()
    assert len(got) == len(rows)
    _check(got, {i: r.text for i, r in rows.items()}, {i: r.source for i, r in rows.items()})
    assert sorted(map(str, got)) == sorted(map(str, m.mix(table.repartition(3)).collect()))  # reruns agree


def test_blocks_at_the_limit(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_ROWS", 8)
    monkeypatch.setattr(m, "SHARD_WORDS", 500)
    table = docs(spark, [words(i, 5 + i % 30) for i in range(400)])
    rows = {r.doc_id: r for r in table.collect()}
    got = m.mix(table).collect()
    _check(got, {i: r.text for i, r in rows.items()}, {i: r.source for i, r in rows.items()})
    shards = {s for r in got for s in r.shards}
    assert shards == set(range(len(shards))) and len(shards) > 5


def test_null_and_repeated_ids_meet_targets(spark, monkeypatch):
    """Rows of one id are told apart, also those that are equal in all that is read."""
    monkeypatch.setattr(m, "BLOCK_ROWS", 64)
    texts = [words(i % 40, 3 + i % 7) for i in range(900)]
    for ids in ("cast(null as bigint)", "doc_id % 9"):
        table = docs(spark, texts).withColumn("doc_id", F.expr(ids)).repartition(5)
        got = m.mix(table).collect()
        assert sorted(map(str, got)) == sorted(map(str, m.mix(table.coalesce(2)).collect()))
        by_target, sizes = defaultdict(int), defaultdict(int)
        for r in got:
            assert r.taken <= 2 * r.size
            by_target[r.target, r.source_size] += r.taken
            sizes[r.source_size] += r.size
        assert len(got) == 900 and all(abs(taken - target) <= 1 for (target, _), taken in by_target.items())
        rows = m.mixed_rows(table, shard_col="shard")
        assert sum(len(r.text.split()) for r in rows.collect()) == sum(r.taken for r in got)


def test_leaves_decide_what_is_taken(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_ROWS", 8)
    monkeypatch.setattr(m, "SHARD_WORDS", 500)
    table, tree = docs(spark, [words(i, 5 + i % 30) for i in range(400)]), m.quota_tree
    taken = sum(r.taken for r in m.mix(table).collect())
    monkeypatch.setattr(m, "quota_tree", lambda *a: tree(*a).where("leaf % 2 = 0"))
    assert 0.35 * taken < sum(r.taken for r in m.mix(table).collect()) < 0.65 * taken


def test_rows_of_the_mix(spark):
    table = with_clashes(docs(spark, [*ODD, *(words(i, 20) for i in range(50))]))
    text = {r.doc_id: r.text for r in table.collect()}
    taken = {r.doc_id: r.taken for r in m.mix(table).collect()}
    rows = m.mixed_rows(table, shard_col="shard")
    assert rows.columns == [*table.columns, "shard"]
    found, many = defaultdict(int), rows.collect()
    for r in many:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        assert text[r.doc_id].startswith(r.text) and r.shard is not None
        found[r.doc_id] += len(w)
    assert dict(found) == {i: n for i, n in taken.items() if n}


def test_no_python_and_odd_tables(spark):
    plan = m.mix(docs(spark, ["a b", "c"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert m.mix(docs(spark, [])).collect() == [] and m.mixed_rows(docs(spark, [])).collect() == []
    one = docs(spark, ["a b c", None])
    got = m.mix(one.union(one)).collect()
    assert len(got) == 4 and all(r.taken <= 2 * r.size for r in got)
    assert [r.taken for r in m.mix(docs(spark, [None, ""])).collect()] == [0, 0]

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tagloom.llm import lm_scoring as s
from tests.llm.helpers import ODD, docs, with_clashes, words


def tokens(text):
    return [*("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()), b" "]


def role(i):
    return 0 if i is None else zlib.crc32(str(i).encode()) % 7


def counts(rows):
    one, two = Counter(), Counter()
    for i, t in rows:
        if role(i) != 2:
            one.update(t)
            two.update(zip([b" ", *t], t))
    return one, two


def test_counts_and_base_equal_brute_force(spark, sf_dir):
    table = docs(spark, [*ODD, "A b a", "Ä ä"], -100).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = [(r.doc_id, tokens(r.text)) for r in table.collect()]
    one, two = counts(rows)
    total, types = sum(one.values()), len(one)
    got = {r.doc_id: r for r in s.score_documents(with_clashes(table)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (role(i) == 2, len(t), sum(one[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((one[w] + 1) / (total + types + 1)) for w in t), rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    held = [r for r in got.values() if r.held_out and r.doc_id >= 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the mixture predicts unseen texts better


@pytest.mark.parametrize("section_blocks", [8, 0.5])
def test_score_equals_brute_force(spark, monkeypatch, section_blocks):
    monkeypatch.setattr(s, "BLOCK", 300)  # many blocks
    monkeypatch.setattr(s, "SECTION_BLOCKS", section_blocks)
    weights = np.tile([0.5, 0.4, 0.1], (s.LEVELS, 1))
    monkeypatch.setattr(s, "learn_weights", lambda cells, uniform: weights)
    table = docs(spark, [words(i, 40, 30) for i in range(60)]).repartition(3)
    rows = [(r.doc_id, tokens(r.text)) for r in table.collect()]
    one, two = counts(rows)
    total, types = sum(one.values()), len(one)
    written = s.written(table)
    for r in s.score_documents(written).collect():
        t = dict(rows)[r.doc_id]
        expected = sum(math.log10(0.5 * (two[h, w] / one[h] if one[h] else 0) + 0.4 * one[w] / total + 0.1 / (types + 1)) for h, w in zip([b" ", *t], t))
        assert r.score == pytest.approx(expected, rel=1e-9)


def test_weights_maximise_held_out_likelihood():
    rng = np.random.default_rng(3)
    truth = np.array([0.6, 0.3, 0.1])
    p = np.column_stack([2.0 ** -rng.integers(1, 9, 4000), 2.0 ** -rng.integers(6, 14, 4000), np.full(4000, 1e-5)])
    cells = Counter((5, int(math.log2(a) / s.STEP), int(math.log2(b) / s.STEP)) for a, b, _ in p)
    rows = [(*k, n) for k, n in cells.items()]
    w = s.learn_weights(rows, 1e-5)
    assert w.shape == (s.LEVELS, 3) and np.allclose(w.sum(1), 1) and (w[6] == w[5]).all() and (w > 0).all()
    x, n = np.array([[2 ** (k[1] * s.STEP), 2 ** (k[2] * s.STEP), 1e-5] for k in cells]), np.array(list(cells.values()))
    best = (n * np.log(x @ w[5])).sum()
    for other in (truth, [0.2, 0.7, 0.1], [0.9, 0.05, 0.05]):
        assert best >= (n * np.log(x @ np.array(other))).sum() - 1e-6


def test_packed_arrays():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    assert (s._keys(s._planes(keys, 8), 8) == keys).all()
    short = keys & ~np.uint64((1 << 16) - 1)
    assert (s._keys(s._planes(short, 6), 6) == short).all()
    for values in ([], [0, 5, 1 << 31], [1, 1 << 40]):
        assert s._numbers(s._counts(np.array(values, np.int64))).tolist() == values


def test_odd_tables(spark):
    assert s.score_documents(s.written(docs(spark, []))).collect() == []
    held = next(i for i in range(100) if role(i) == 2)
    r = s.score_documents(s.written(docs(spark, ["only this"], held))).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)
    twice = docs(spark, ["a b", None])
    got = s.score_documents(s.written(twice.union(twice))).collect()
    assert len(got) == 4 and all(r.train_tokens == sum(counts([(0, tokens("a b")), (1, tokens(None))] * 2)[0].values()) for r in got)


def test_a_token_in_every_block_makes_bounded_groups(spark, monkeypatch):
    """Groups of both levels are told apart by what they hold: a section's blocks at most, or an entry a section."""
    monkeypatch.setattr(s, "BLOCK", 50)
    texts = [f"the {words(i, 45, 10**6)} the" for i in range(400)]
    source = s.written(docs(spark, texts).select(s.F.col("doc_id").alias("id"), "text", s.role_of(s.F.col("doc_id")).alias("role")))
    requests = s.written(s._requests(source, 8, 8))
    blocks, sections = requests.select("block").distinct().count(), 16
    of = requests.withColumn("section", s.F.pmod(s.F.xxhash64("block"), s.F.lit(sections)))
    most = of.groupBy("kind", "bucket", "section").count().agg(s.F.max("count")).first()[0]
    assert blocks > 150 and most < 3 * blocks / sections
    order = ["block", "kind", "bucket"]
    one, two = s._answers(requests, 8), s._answers_by_section(requests, 8, 8, sections)
    plain = lambda df: sorted((*(r[c] for c in order), bytes(r.counts)) for r in df.where("block >= 0").collect())
    assert plain(one) == plain(two)
    whole = lambda df: tuple(df.where("block = -1").agg(s.F.sum("types"), s.F.sum("total")).first())
    assert whole(one) == whole(two)

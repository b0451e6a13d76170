import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tagloom.llm import importance as m
from tests.compare import assert_same
from tests.llm.helpers import ODD, docs, with_clashes, words


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows, target, longest=1):
    grams = lambda text: [" ".join(w[i : i + n]) for w in [words_of(text)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for texts, counts in (([x for _, x in rows], s), (target, t)):
        for text in texts:
            for g in grams(text):
                counts[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for id_, text in rows:
        h = int(hashlib.sha256(f"2024:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in grams(text))
        out.append([id_, len(grams(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((-r[3], r[0] is None, r[0] or 0, k) for k, (r, (_, text)) in enumerate(zip(out, rows)) if len(words_of(text)) >= 20)
    drawn = {k: n + 1 for n, (*_, k) in enumerate(order[: len(order) * 10 // 100])}
    return [tuple([*r, drawn.get(k)]) for k, r in enumerate(out)]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_whole_table_equals_sql(spark, sf_dir):
    got = m.resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert_same(got, m.ORACLE, sf_dir)


@pytest.mark.parametrize("longest", [1, 3])
def test_equals_brute_force(spark, monkeypatch, longest):
    texts = [words(i, 5 + i % 60) for i in range(300)] + ODD + [words(3, 40)] * 50  # equal texts with other ids
    df = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 97 != 5, F.col("doc_id") % 290)).repartition(7)  # null and repeated ids
    target = [words(1000 + i, 30, 40) for i in range(20)] + [None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = m.resample(with_clashes(df), goal, longest=longest)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute([(r.doc_id, r.text) for r in df.collect()], target, longest), key=key)


def test_pieces_of_a_long_text_equal_the_whole(monkeypatch):
    text = (words(7, 500) + "; Ünï-ſtart  ").encode() * 3
    whole = list(m.features(text, 3))
    monkeypatch.setattr(m, "PIECE", 50)
    for n in (1, 2, 3):
        assert [g for k, some in m.features(text, 3) if k == n for g in some] == [g for k, some in whole if k == n for g in some]
    assert [w.decode() for _, some in m.features(text) for w in some] == words_of(text.decode())


@pytest.mark.parametrize("ties", [False, True])
def test_ranges_are_even_and_ranks_exact(spark, ties):
    rng = random.Random(5)
    rows = [(rng.randrange(10**6) if not ties else 7, 5 if ties else rng.randrange(10**9), 1) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, score long, n long").repartition(9)
    runs = m._runs(df.withColumn("chosen", F.lit(1).cast("long")))
    sample = m._sample(runs.cache(), len(rows), 16)
    assert sample.num_rows <= 2 * 16 * 16
    order = m.np.lexsort(m._keys(sample))
    cuts = order[m.np.arange(1, 16) * len(order) // 16]
    sizes = [r["count"] for r in m._ranges(runs, sample.take(m.pa.array(cuts))).groupBy("range").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * len(rows) / 16
    got = m.draw_ranked(df, F.lit(True), 100).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(rows) + 1))
    assert [(r.score, r.doc_id) for r in got] == sorted(((s, i) for i, s, _ in rows), key=lambda x: (-x[0], x[1]))


def test_empty(spark):
    none = docs(spark, [])
    assert m.resample(none, none).collect() == []
    alone = m.resample(docs(spark, [words(1, 30)] * 10), none).collect()
    assert [r["rank"] for r in alone].count(None) == 9

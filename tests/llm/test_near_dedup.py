import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import near_dedup as n
from tests.compare import assert_same
from tests.llm.helpers import ODD, docs, with_clashes, words


def shingle_set(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = text.encode().split()
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Component of each (id, text) by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            parent[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        out[d] = min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))
    return out


def family(seed, size, edits, length=120):
    """Variants of a text, each with some words replaced: a spread of similarities around the threshold."""
    rng, base, out = random.Random(seed), words(seed, length).split(), []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"e{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


TEXTS = [*ODD, *family(1, 60, 6), *family(2, 25, 3), *family(3, 5, 1), *["Same words here again and again now"] * 7, "same WORDS here again and\nagain  now", "a b c", "A b c", "a b d", *(words(i, 90) for i in range(100, 130))]


@pytest.mark.parametrize("members", [384, 8])
def test_components_equal_all_pairs(spark, monkeypatch, members):
    monkeypatch.setattr(n, "BLOCK_MEMBERS", members)  # 8: clusters of many blocks
    monkeypatch.setattr(n, "PIVOTS", 3)
    order = list(range(len(TEXTS)))
    random.Random(4).shuffle(order)
    table = docs(spark, [TEXTS[i] for i in order])
    expected = brute([(r.doc_id, r.text) for r in table.collect()])
    got = n.near_duplicates(with_clashes(table)).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    for r in got:
        assert r.n_shingles == len(shingle_set(TEXTS[order[r.doc_id]])) and r.kept == (r.doc_id == r.component_id)


def test_texts_of_one_template_propose_few_pairs(spark):
    rng, template, size = random.Random(6), words(50, 120).split(), 400
    texts = []
    for i in range(size):  # two thirds are the template's; every tenth is a near copy of the one before
        own = words(1000 + i, 60).split()
        texts.append([*template, *own] if i % 10 else [*texts[-1][:-1], f"e{rng.randrange(9999)}"] if i else [*template, *own])
    sets = [n.shingles(" ".join(t)) for t in texts]
    rows = [(1, i, i, True, bytearray(s.tobytes())) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "root long, node long, label long, outer boolean, data binary")
    got = {(r.x, r.y) for r in n.candidates(table).collect()}
    sizes = np.array([len(s) for s in sets])
    links = {(int(i), int(j)) for i, j in zip(*np.nonzero(n.linked(n.intersections(sets), sizes, sizes))) if i < j}
    assert len(links) == size // 10 - 1 and links <= got and len(got) < size
    main = table.withColumn("outer", table.node >= 390).withColumn("label", F.when(table.node >= 390, table.node).otherwise(0))
    assert {(r.x, r.y) for r in n.candidates(main).collect()} == {(390, 389)}  # a pair of two in the main component is not proposed


@pytest.mark.parametrize("pairs_a_shingle", [2, 0, 10**9])
def test_texts_put_together_from_the_same_parts_propose_few_pairs(spark, monkeypatch, pairs_a_shingle):
    monkeypatch.setattr(n, "BAND_PAIRS", pairs_a_shingle)
    parts, rng, size = [words(100 + k, 60) for k in range(12)], random.Random(4), 600
    texts = [" ".join(parts[k] for k in rng.sample(range(12), 6)) for _ in range(size)]
    texts += [" ".join([*t.split()[:-3], f"e{k}", "f", "g"]) for k, t in enumerate(texts[:40])]  # near copies
    sets = [n.shingles(t) for t in texts]
    table = spark.createDataFrame([(1, i, i, True, bytearray(x.tobytes())) for i, x in enumerate(sets)], "root long, node long, label long, outer boolean, data binary")
    got = {(r.y, r.x) for r in n.candidates(table).collect()}
    sizes = np.array([len(x) for x in sets])
    links = {(int(i), int(j)) for i, j in zip(*np.nonzero(n.linked(n.intersections(sets), sizes, sizes))) if i < j}
    assert len(links) >= 40 and links <= {(min(p), max(p)) for p in got} and len(got) < 0.05 * size * size / 2


def shuffled(spark, run):
    """Rows and bytes that stages of ``run`` wrote to shuffles, and its result."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {s.stageId(): s for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    new = [s for k, s in stages().items() if k not in before]
    return sum(s.shuffleWriteRecords() for s in new), sum(s.shuffleWriteBytes() for s in new), out


@pytest.fixture
def joins_shuffle(spark):
    """As on large tables: no join is a broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_bands_are_shuffled_once(spark, joins_shuffle, batch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch))  # 7: clusters of many batches
    try:
        texts = [*family(1, 60, 6), *family(2, 25, 3), *(words(i, 60) for i in range(1000, 1400))]
        random.Random(4).shuffle(texts)
        rows, _, got = shuffled(spark, lambda: n.near_duplicates(docs(spark, texts).repartition(3)).collect())
    finally:
        spark.conf.set(name, before)
    assert {r.doc_id: r.component_id for r in got} == brute(list(enumerate(texts)))
    assert rows < 1.5 * n.BANDS * len(texts)


def test_sets_are_shuffled_twice(spark, joins_shuffle, monkeypatch):
    monkeypatch.setattr(n, "BLOCK_MEMBERS", 8)
    texts = [*family(1, 30, 6), *(f"{words(i, 2000)}{end}" for i in range(2000, 2060) for end in ("", " e"))]  # a cluster of many blocks, and pairs
    size = sum(8 * len(n.shingles(t)) for t in texts)
    _, sent, got = shuffled(spark, lambda: n.near_duplicates(docs(spark, texts)).collect())
    assert {r.doc_id: r.component_id for r in got} == brute(list(enumerate(texts)))
    assert sent < 2.7 * size


def test_whole_table_equals_sql(spark, sf_dir):
    assert_same(n.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")), n.ORACLE, sf_dir)


def test_deduplicated_keeps_one_of_each(spark):
    table = with_clashes(docs(spark, TEXTS))
    expected = brute([(r.doc_id, r.text) for r in table.collect()])
    kept = n.deduplicated(table.union(table))  # repeated rows go too, except rows without words
    assert kept.columns == table.columns
    ids = sorted(r.doc_id for r in kept.collect())
    empty = {1, 0, 2}
    assert [i for i in ids if i not in empty] == sorted(set(expected.values()) - empty) and set(ids) >= empty


def test_odd_tables(spark):
    assert n.near_duplicates(docs(spark, [])).collect() == [] and n.deduplicated(docs(spark, [])).collect() == []
    one = docs(spark, ["a b c d e f", "x y", None])
    got = n.near_duplicates(one.union(one).union(one.selectExpr("cast(null as long)", "text", "lang", "source", "n_chars"))).collect()
    assert len(got) == 9 and {(r.doc_id, r.component_id) for r in got} == {(0, 0), (1, 1), (2, 2), (None, 0), (None, 1), (None, None)}


def test_null_ids_are_linked_as_others(spark):
    def edited(seed, *places):
        w = words(seed, 120).split()
        return " ".join(f"e{i}" if i in places else x for i, x in enumerate(w))

    # 5 and 9 are linked by a text without id only; the last two have no id at all
    rows = [(5, edited(40, 30)), (None, edited(40)), (9, edited(40, 80)), (None, edited(40)), (None, edited(41)), (None, edited(41, 60)), (7, words(42, 120))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id) for r in n.near_duplicates(table).collect()}
    assert got == {(5, 5), (None, 5), (9, 5), (None, None), (7, 7)}
    assert sorted((r.doc_id for r in n.deduplicated(table).collect()), key=str) == [5, 7, None]


def test_sketches_fill_and_agree_as_sets_do():
    rng = np.random.default_rng(0)
    for size in (1, 2, 7, 100, 3000):
        items = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        assert (n.sketch(items) != 0).all() and (n.sketch(items) == n.sketch(items[::-1])).all()
    errors = []
    for common in (0.3, 0.6, 0.85, 0.95):
        for _ in range(30):
            size = int(rng.integers(50, 600))
            union = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            k = int(common * size)
            a, b = np.concatenate([union[:k], union[k : k + (size - k) // 2]]), np.concatenate([union[:k], union[k + (size - k) // 2 :]])
            errors.append((n.sketch(a) == n.sketch(b)).mean() - k / size)
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.12


def test_intersections_in_blocks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120), dtype=np.uint64)) for _ in range(40)]
    exact = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (n.intersections(sets) == exact).all() and (n.intersections(sets[:9], sets[9:]) == exact[:9, 9:]).all()


def test_components_of_paths_and_stars(spark):
    from tagloom.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 160)}) == 1 and got[200] == got[300] and len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []

import re
from collections import Counter

import numpy as np

from tagloom.llm import boosting
from tagloom.llm import quality_rules as q
from tests.llm.helpers import ODD, docs, with_clashes, words

TEXTS = [*ODD, words(1, 80), (words(2, 10) + "\n") * 9, "a b c " * 30, "l1\nl1\n\n\nl2\nl1\n" + words(3, 60), words(4, 49), words(5, 50)]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if n[x] > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_statistics_equal_brute_force(spark, sf_dir):
    table = docs(spark, TEXTS, -100).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    texts = {r.doc_id: r.text for r in table.collect()}
    model = q.train(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for r in q.judge(with_clashes(table), model).collect():
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = q.train(table, labels.where("doc_id % 2 = 0"))
    truth = labels.where("doc_id % 2 = 1").selectExpr("doc_id", "quality = 1 as good")
    got = q.judge(table, model).join(truth, "doc_id").where("not base_failed").collect()
    assert len(got) > 100 and np.mean([r.kept == r.good for r in got]) > 0.97


def test_keep_good_is_judge(spark, sf_dir):
    table = with_clashes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = q.train(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = q.keep_good(table, model)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in q.judge(table, model).where("kept").collect())


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    table = docs(spark, TEXTS)
    assert all(r.kept != r.base_failed for r in q.judge(table, q.train(table, none)).collect())
    odd = spark.createDataFrame([(None, 1), (1, None), (10, 1), (10, 0), (10, 1)], none.schema)
    assert q.train(table, odd).forest is None
    assert q.judge(docs(spark, []), q.train(docs(spark, []), none)).collect() == []


def test_trees_are_monotonic_and_flat():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.2 * x[:, 1]) > 0.6).astype(float)
    forest = boosting.fit(x, y, (1, 0, -1))
    base = rng.random((50, 3))
    for f, sign in ((0, 1), (2, -1)):
        steps = np.repeat(base[:, None, :], 40, 1)
        steps[:, :, f] = np.linspace(0, 1, 40)
        odds = forest.score(steps.reshape(-1, 3)).reshape(50, 40)
        assert (np.diff(odds, axis=1) * sign >= -1e-9).all()
    assert ((forest.score(x) > 0) == y).mean() > 0.93

    def walk(i, row):
        return forest.value[i] if forest.left[i] == i else walk(forest.left[i] if row[forest.feature[i]] <= forest.threshold[i] else forest.right[i], row)

    assert np.allclose(forest.score(base), [forest.bias + sum(walk(r, row) for r in forest.roots) for row in base])

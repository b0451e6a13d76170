import importlib
import os
import re
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from tagloom.llm import quality_rules, secret_scan
from tagloom.llm.common import scratch, written
from tests.llm.helpers import ODD, docs, with_clashes, words
from tests.llm.test_mixing import plain_targets
from tests.llm.test_near_dedup import shingle_set
from tests.llm.test_packing import ids_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf_dir):
    first = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "near_dedup", "secret_scan", "mixing", "packing"]

    good = written(stage["quality_rules"](spark, docs, sf_dir))
    model = quality_rules.train(first, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert good.columns == COLUMNS
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality_rules.judge(first, model).where("kept").collect()}
    labelled = first.join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"), "doc_id")
    lost = {r.doc_id for r in labelled.collect() if len(r.text.split()) >= 50} - {r.doc_id for r in good.collect()}
    assert len(lost) <= 1  # clean documents stay

    unique = written(stage["near_dedup"](spark, good, sf_dir))
    rows = {r.doc_id: r for r in good.collect()}
    sets = {i: shingle_set(r.text) for i, r in rows.items()}
    stay = {r.doc_id for r in unique.collect()}
    assert unique.columns == COLUMNS and stay <= rows.keys()
    for i in rows:
        like = {j for j in rows if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
        assert (min(like) == i or i not in stay) and (like == {i}) <= (i in stay)

    clean = written(stage["secret_scan"](spark, unique, sf_dir))
    for r in clean.collect():
        old = rows[r.doc_id].text
        assert r.text == secret_scan.masked(old, secret_scan.scan_texts([old])[0], "[SECRET]") and r.n_chars == len(r.text)

    mixed = written(stage["mixing"](spark, clean, sf_dir))
    texts = {r.doc_id: r for r in clean.collect()}
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in texts.values():
        sizes[r.source] += count(r.text)
    for r in mixed.collect():
        taken[r.source] += count(r.text)
        assert texts[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text)
    target = plain_targets(dict(sizes))
    assert all(abs(taken[s] - round(target[s])) <= 1 for s in target)

    packed = stage["packing"](spark, mixed, sf_dir).collect()
    assert sum(r.length for r in packed) == sum(map(len, ids_of([r.text for r in mixed.collect()])))
    assert max(r.offset + r.length for r in packed) <= 4096


def test_run_equals_the_query(spark, sf_dir):
    entry = importlib.import_module("__spark_entry__")
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(entry.queries()["pipeline"](spark, sf_dir))


def test_odd_tables(spark, sf_dir, tmp_path):
    """Null ids, texts and sources, repeated rows, clashing names; and no rows."""
    odd = with_clashes(docs(spark, [*ODD, *(words(i % 6, 90) for i in range(12))]).withColumn("doc_id", F.expr("if(doc_id % 5 = 0, null, doc_id)")))
    for k, table in enumerate((odd.union(odd), odd.limit(0))):
        where = f"{tmp_path}/{k}"
        table.write.parquet(f"{where}/documents.parquet")
        spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{where}/labels.parquet")
        rows = corpus_pipeline.run(spark, where).collect()
        assert bool(rows) == (k == 0) and all(r.length > 0 for r in rows)


def test_tables_of_a_scratch_go(spark, tmp_path):
    with scratch(spark) as made:
        kept, gone = written(spark.range(3)), written(spark.range(4))
        first, second = (p.removeprefix("file:") for p in made)
        assert kept.count() == 3 and gone.count() == 4
        made.remove(made[0])
    assert kept.count() == 3 and os.path.exists(first) and not os.path.exists(second)


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    assert {int(q[2:].split("_")[0]) for q in entry.queries() if re.match(r"op\d+_", q)} == set(range(1, 14))


def test_scratch_of_each_thread(spark):
    """What one thread writes within its scratch stays out of another's."""
    import threading

    from tagloom.llm.common import scratch, written

    made, ready, done = {}, threading.Barrier(2), threading.Barrier(2)

    def work(name):
        with scratch(spark) as mine:
            ready.wait(30)
            kept = written(spark.range(3))
            made[name] = list(mine)
            done.wait(60)
            assert kept.count() == 3

    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(90)
    assert len(made) == 2 and all(len(x) == 1 for x in made.values()) and made[0] != made[1]

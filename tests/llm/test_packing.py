import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm import encoding
from tagloom.llm import packing as p
from tagloom.llm.encoding import Encoder
from tests.llm.helpers import ODD, docs, with_clashes, words

TRICKY = ["it's don't I'LL we've", "á b ́c", "x<|endoftext|>y <|endoftext|>", "12.5% naïve—ok", "ÀÉ, ß! Straße", "日本 語", "'s 't s' ,'s a'", "Ünï***, a|b|", "a×b ÷ É'S 12'34 '1 --'s x<|ENDOFTEXT|>"]


def ids_of(texts):
    t = Tokenizer.from_file(p.default_tokenizer())
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_tokenizer(spark, sf_dir):
    texts = [*ODD[:-2], *TRICKY, *(r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())]
    got = Encoder(p.default_tokenizer()).encode([t or "" for t in texts])
    assert [g.tolist() for g in got] == [i[:-1] for i in ids_of(texts)]


def test_encoder_when_its_table_is_full():
    texts = [words(i, 60) + f" {i}é Ж{i} it's" for i in range(10)] * 2
    for bits in (4, 7, 21):
        e = Encoder(p.default_tokenizer(), bits)
        for some in (texts, texts[5:], texts[:3]):
            assert [g.tolist() for g in e.encode(some)] == [i[:-1] for i in ids_of(some)]


def test_encoder_cuts_chunks_between_words(monkeypatch):
    monkeypatch.setattr(encoding, "CHUNK", 64)
    texts = [words(1, 200), "", "x" * 500, None, "a b", "long " + "y" * 300 + " end", words(2, 3)] * 3
    ids, at = Encoder(p.default_tokenizer()).flat(*encoding.arrow_bytes(pa.array(["skipped", *texts])[1:]))
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [i[:-1] for i in ids_of(texts)]


def _check(rows, expected):
    """Pieces rebuild every row's ids, and sequences are gapless and full or of a power of two."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == expected.keys()
    for i, parts in pieces.items():
        parts.sort()
        assert [x for _, ids, _ in parts for x in ids] == expected[i] and all(n == len(expected[i]) for *_, n in parts)
    for s in sequences.values():
        s.sort()
        end = 0
        for offset, n in s:
            assert offset == end
            end += n
        assert end == 4096 or end & (end - 1) == 0 and end < 4096


def test_whole_table(spark, sf_dir):
    table = docs(spark, [*ODD[:-2], *TRICKY], -100).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet")).repartition(3)
    rows = sorted((r.doc_id, r.text) for r in table.select("doc_id", "text").collect())
    expected = dict(zip([i for i, _ in rows], ids_of([t for _, t in rows])))
    packed = p.pack(with_clashes(table)).collect()
    _check(packed, expected)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in p.digest(p.pack(table)).collect()}
    assert all(crc[r.doc_id, r.start] == zlib.crc32(bytes(r.ids)) for r in packed if (r.doc_id, r.start) in crc)


def test_windows_keep_proportions():
    packer = p.Packer(4096, [0.5, 0.3, 0.2], [0.0] * 3)
    for i in range(300):
        packer.add(i % 3, i, np.zeros(1000, "<u2"))
    for _ in range(20):
        window = packer.window(4096)
        got = [sum(x[2] for x in window if x[0] % 3 == q) for q in range(3)]
        assert sum(got) == 4096 and abs(got[0] - 2048) <= 2 and abs(got[1] - 1229) <= 2
    owed = p.Packer(4096, [0.5, 0.5], [1000.0, -1000.0])
    for q in range(2):
        owed.add(q, q, np.zeros(9000, "<u2"))
    assert sum(x[2] for x in owed.window(4096) if x[0] == 0) == 3048
    short = p.Packer(64, [0.5, 0.5], [0.0, 0.0])
    short.add(0, 1, np.zeros(100, "<u2"))
    assert [sum(x[2] for x in w) for w in short.rest()] == [64, 32, 4] and short.deficits[1] > 0


def test_tables_laid_out_by_source_are_mixed(spark, monkeypatch):
    """Every window meets the targets until a queue runs dry: here at the end of each part."""
    monkeypatch.setattr(p, "PART_TOKENS", (1 << 17, 1 << 27))
    monkeypatch.setattr(p, "CARD", 256)
    sources = ("a",) * 5 + ("b",) * 3 + (None, "c")
    table = docs(spark, [words(i, 30 + i * 37 % 700) for i in range(1500)], sources=sources)
    for laid_out in (table.coalesce(1).sort("source"), table.repartitionByRange(7, "source")):
        rows = p.pack(laid_out, length=1024).join(table.select("doc_id", "source"), "doc_id").collect()
        windows, total, parts = defaultdict(lambda: defaultdict(int)), defaultdict(int), set()
        for r in rows:
            windows[r.sequence_id][r.source] += r.length
            total[r.source] += r.length
            parts.add(r.sequence_id >> 33)
        whole = sum(total.values())
        full = {k: w for k, w in windows.items() if sum(w.values()) == 1024}
        good = [all(abs(w[s] / 1024 - total[s] / whole) < 0.02 for s in total) for w in full.values()]
        assert len(parts) > 1 and len(full) > 400 and sum(good) >= 0.93 * len(full)


def test_deficits_go_on_across_parts(spark, monkeypatch):
    tokens = spark.createDataFrame([(0, "a", 90), (0, None, 10), (1, "a", 40), (1, None, 60), (5, "a", 50), (5, "b", 50)], "part int, source string, n long")
    got = {(r.part, r.source): (r.share, r.deficit) for r in p.starts(tokens, 300, None).collect()}
    assert got[0, "a"] == (0.6, 0.0) and got[0, None][1] == 0 and abs(got[1, "a"][1] + 30) < 1e-9
    assert abs(got[5, "a"][1] - (120 - 130)) < 1e-9 and abs(got[5, "b"][1] - 50 / 300 * 200) < 1e-9 and abs(got[1, None][1] - (70 / 300 * 100 - 10)) < 1e-9
    weighted = {(r.part, r.source): r.share for r in p.starts(tokens, 300, {"a": 3, None: 1}).collect()}
    assert weighted[0, "a"] == 0.75 and weighted[1, None] == 0.25 and weighted[5, "b"] == 0


def test_small_buffer_and_many_sources(spark, monkeypatch):
    table = docs(spark, [words(i, 200) for i in range(120)], sources=tuple(f"s{i}" for i in range(40)))
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    expected = dict(zip([i for i, _ in rows], ids_of([t for _, t in rows])))
    monkeypatch.setattr(p, "CARD", 100)
    monkeypatch.setattr(p, "PART_TOKENS", (1 << 12, 1 << 27))
    _check(p.pack(table, buffer=20_000).collect(), expected)
    _check(p.pack(table, weights={"s1": 3, "s2": 1}).collect(), expected)
    _check(p.pack(table.withColumn("source", F.col("doc_id").cast("string"))).collect(), expected)


def test_odd_tables(spark):
    assert p.pack(docs(spark, [])).collect() == []
    one = docs(spark, [None, "a"])
    got = p.pack(one.union(one)).collect()
    assert len({(r.doc_id, r.sequence_id, r.offset) for r in got}) == len(got) and sum(r.length for r in got) == 2 * (1 + 2)

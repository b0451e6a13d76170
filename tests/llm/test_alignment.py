import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tagloom.llm import alignment as m
from tests.llm.helpers import ODD, docs, with_clashes, words

TEXTS = [
    "a  b", " a", "  a b ", "a\n b\n\nc", "don't 's it'll  we 've", "tab\tand\r\nline   x", "<|endoftext|> <s></s> <unk> <0x41>", "naïve Ünïcode ßtraße 東京タワー 🙂👍🏽", "x▁y", "▁", "a\xa0b \x1c c",
    "ﬁ Ａ é é", "12345 3.14 -1,000.5", "trailing   ", "word " * 30 + " end", "a" * 3000, "ab " * 2000, "\x00 \x01", "{\"k\": [1, 2]}\n    indented\n\tcode()",
]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path(m.A_FILE))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path(m.B_FILE))


def tokens(both, text):
    """Ids and (first, last) bytes of the tokens of the whole text in both; nothing where bytes differ."""
    a, b = both
    if not text:
        return [], [], [], []
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 400))
    table = {chr(x if x in printable else next(other)): x for x in range(256)}
    got = a.encode(f" {text}", add_special_tokens=False)
    bytes_a = [bytes(table[c] for c in t) for t in got.tokens]
    ids_b = b.encode(text)
    bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    raw = f" {text}".encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return [], [], [], []
    spans = lambda parts: [(e - len(p), e) for p, e in zip(parts, accumulate(map(len, parts)))]
    return got.ids, ids_b, spans(bytes_a), spans(bytes_b)


def brute(both, texts):
    every, held = [], Counter()
    for text in texts:
        a, b, at_a, at_b = tokens(both, text)
        common = sorted({e for _, e in at_a} & {e for _, e in at_b})
        of = {end: n for n, end in enumerate(common)}
        sides = [[[] for _ in common] for _ in range(2)]
        for into, ids, at in zip(sides, (a, b), (at_a, at_b)):
            n = 0
            for k, (_, e) in zip(ids, at):
                into[n].append(str(k))
                n = of[e] + 1 if e in of else n
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides)]
        links, j = [], 0
        for k, (s, e) in zip(a, at_a):
            while at_b[j][1] <= s:
                j += 1
            i = j
            while i < len(b) and at_b[i][0] < e:
                links.append((k, b[i]))
                i += 1
        held.update(set(links))
        every.append((a, b, groups, links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [(len(a), len(b), len(g), len(x), sum(held[p] == best[p[0]] for p in x), sum(held[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, x in every]


def result(df):
    return [tuple(r) for r in df.orderBy("doc_id").select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


def test_odd_texts_equal_brute_force(spark, both):
    texts = TEXTS + ODD + [words(k, 50, 60) for k in range(40)] + [words(1, 50, 60)] * 20
    got = m.align_documents(with_clashes(docs(spark, texts)))
    assert result(got) == brute(both, texts)


@pytest.mark.parametrize("constants", [{"SLICE_PAIRS": 150}, {"COUNTED": 64, "CHUNK_PAIRS": 7, "REMEMBERED": 5, "PIECE": 20}])
def test_slices_and_bounds_change_nothing(spark, both, monkeypatch, constants):
    texts = TEXTS[:17] + [words(k, 80, 900) for k in range(30)] + [None, ""]
    for name, value in constants.items():
        monkeypatch.setattr(m, name, value)
    known = m.Aligner(public_tokenizers.path(m.A_FILE), public_tokenizers.path(m.B_FILE))
    expected = brute(both, texts)
    for (*sizes, _, _, digest), e in zip(known.texts(texts), expected, strict=True):
        assert (*sizes, digest) == (*e[:4], e[6])
    assert result(m.align_documents(docs(spark, texts))) == expected


def test_given_documents_equal_brute_force(spark, sf_dir, both):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    assert result(m.align_documents(rows)) == brute(both, [r.text for r in rows.collect()])


def test_groups_as_rows(spark, both):
    texts = TEXTS[:8]
    got = m.groups(docs(spark, texts)).orderBy("doc_id", "group").collect()
    for k, text in enumerate(texts):
        mine = [r for r in got if r.doc_id == k]
        assert [r.group for r in mine] == list(range(len(mine)))
        joined = ";".join(f"{','.join(map(str, r.a_ids))}|{','.join(map(str, r.b_ids))}" for r in mine)
        assert hashlib.sha256(joined.encode()).hexdigest() == brute(both, [text])[0][6]


def test_repeated_and_null_ids_and_empty(spark, both):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in m.align_documents(df).collect())
    assert [x[:2] for x in got] == [(0, 0), (0, 1), (1, 2), (1, 2)] and [x[2] for x in got] == [0, 3, 5, 5]
    assert m.align_documents(docs(spark, [])).collect() == []

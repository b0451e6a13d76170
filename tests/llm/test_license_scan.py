import random
import re
import textwrap
from collections import Counter

from tagloom.llm import license_scan as s
from tagloom.llm.license_texts import COMPLETE
from tests.llm.helpers import ODD, docs, with_clashes, words

TEXTS = [*ODD, "x\nLicensed under the Apache License, Version 2.0.\ny", "released UNDER the mit-license", words(1, 30) + "\nLicensed under CC BY-NC 4.0.", s.TEMPLATES[4][1], s.TEMPLATES[4][1].replace("copy, modify", "copy,\nmodify"), "License", "Licensed under the"]


def plain(text):
    w = [x for x in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()]
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter((x,) for x in w)


_MARKS = "noncommercial noderivatives noderivs sharealike nc nd sa lesser affero".split()
_LEADS = "|".join([*_MARKS, *"version v attribution by license gpl lgpl agpl mpl epl".split()])


def family(text):
    """Marks and versions of a passage, from its words in one line."""
    line = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())
    versions = re.findall(rf"(?<![a-z0-9])(?:(?:{_LEADS}) (?=[0-9])|v(?=[0-9]))([0-9]+(?![a-z0-9])(?: [0-9]+(?![a-z0-9])){{0,2}})", line)
    return {w for w in line.split() if w in _MARKS}, {re.sub(r"(?: 0)+$", "", v) for v in versions}


KNOWN = [(name, plain(t), family(t) if len(s.words_of(t)) <= 80 else None) for name, t in s.ALL_TEMPLATES]


def brute(text, threshold=s.THRESHOLD):
    def best(passage):
        a, own, top = plain(passage), family(passage), (0.0, None)
        for name, b, tells in KNOWN:
            if tells is not None and tells != own or not a & b:
                continue
            d = 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
            if d > top[0]:
                top = (d, name)
        return top if top[0] >= threshold else None

    out, at = [], 0
    for line in text.split("\n"):
        if got := best(line):
            out.append((got[1], got[0], at, at + len(line)))
        at += len(line) + 1
    if "\n" in text and (got := best(text)) and (not out or got[0] >= max(o[1] for o in out)):
        out = [(got[1], got[0], 0, len(text))]
    return out


def test_equals_brute_force(spark, sf_dir):
    table = docs(spark, TEXTS, -100).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    texts = {r.doc_id: r.text for r in table.collect()}
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in s.scan_licenses(with_clashes(table)).collect()}
    assert got == {i: brute(t or "") for i, t in texts.items()}
    assert sum(map(bool, got.values())) >= 5


def test_size_bounds_are_necessary_conditions():
    m = s.Matcher(s.TEMPLATES, 0.8)
    for n in range(1, 200):
        for i, size in enumerate(m.sizes):
            if 2 * min(n, size) / (n + size) >= 0.8:
                assert i in m.bounded(n) and m.low <= n <= m.high


def test_summary(spark):
    rows = {r.doc_id: r for r in s.summary(s.scan_licenses(docs(spark, ["Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", None, "x"]))).collect()}
    assert (rows[0].n_matches, rows[0].license, rows[0].dice) == (2, "cc-by-nc-4.0", 1.0)
    assert (rows[1].n_matches, rows[1].license, rows[1].dice, rows[1].matches) == (0, None, 0.0, "")
    assert s.summary(s.scan_licenses(docs(spark, []))).collect() == []


def whole_text(name):
    return next(text for n, text in COMPLETE if n == name)


def test_licences_over_lines_and_within_paragraphs():
    for name, template in s.TEMPLATES[4:13]:
        wrapped = textwrap.fill(template, 40)
        for text in (f"{words(1, 300)}\n{wrapped}\n{words(2, 300)}", f"{words(1, 60)} {template} {words(2, 60)}"):
            assert [(m[0], m[1]) for m in s.scan_text(text)] == [(name, 1.0)]
            (_, _, start, end), = s.scan_text(text)
            assert s.words_of(text[start:end]) == s.words_of(template)
    apache = textwrap.fill(s.TEMPLATES[1][1], 50)
    text = f"İ {words(3, 200)}\n{apache}\n{words(4, 200)}. Also released under the MIT license, {words(5, 30)}"
    assert [(m[0], m[1], text[m[2] : m[2] + 8].lower()) for m in s.scan_text(text)] == [("apache-2.0", 1.0, "licensed"), ("mit", 1.0, "released")]


def test_complete_licence_texts():
    for name, text in COMPLETE:
        got = s.scan_text(f"Copyright (c) 2020 Someone\n\n{text}")
        assert [m[0] for m in got] == [name] and got[0][1] > 0.95
    mit, bsd = whole_text("mit"), whole_text("bsd-2-clause")
    text = f"{words(1, 400)}\n{mit}\n{words(2, 100)}\n{bsd}\n{mit}\n{words(3, 100)}"
    got = s.scan_text(text)
    assert [(m[0], m[1]) for m in got] == [("mit", 1.0), ("bsd-2-clause", 1.0), ("mit", 1.0)]


def test_windows_equal_all_windows():
    """The best window of each begin equals brute force over all windows."""
    rng = random.Random(5)
    for name, template in (s.TEMPLATES[6], s.TEMPLATES[7], ("x", "a b a b c a b")):
        m, w = s.Matcher(((name, template),), 0.8), s.words_of(template)
        m.telling = [None]  # as for complete texts
        text = [x for _ in range(3) for x in [*(rng.choice(["the", "a", "b", "public"]) for _ in range(12)), *(x for x in w if rng.random() > 0.06)]]
        grams, found = plain(template), {}
        for i in range(len(text)):
            for j in range(i + 2, len(text) + 1):
                g = Counter(zip(text[i : j - 1], text[i + 1 : j]))
                d = 2 * (g & grams).total() / (g.total() + grams.total())
                if d >= 0.8 and (text[i], text[i + 1]) in grams and d > found.get(i, (0,))[0]:
                    found[i] = (d, (g & grams).total(), i, j)
        assert sorted(found.values(), key=lambda f: f[2]) == m.windows(text, 0, len(text), 0)
        assert found


def test_relatives_give_their_own_name_or_none():
    names = {"": "by", "-ShareAlike": "by-sa", "-NonCommercial": "by-nc", "-NoDerivatives": "by-nd", "-NonCommercial-ShareAlike": "by-nc-sa", "-NonCommercial-NoDerivatives": "by-nc-nd"}
    for kind, name in names.items():
        assert [m[:2] for m in s.scan_text(f"{words(1, 40)} This work is licensed under a Creative Commons Attribution{kind} 4.0 International License. {words(2, 40)}")] == [(f"cc-{name}-4.0", 1.0)]
        assert [m[0] for m in s.scan_text(f"x\nLicensed under CC {name.upper()} 4.0.")] == [f"cc-{name}-4.0"]
    for text in ("This work is licensed under the GNU General Public License, version 1.", "This work is licensed under a Creative Commons Attribution 2.5 International License.", "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-NC-SA 2.0.", "Licensed under the Eclipse Public License, Version 3.0."):
        assert s.scan_text(text) == [], text
    assert [m[0] for m in s.scan_text("Licensed under the Apache License, Version 2")] == ["apache-2.0"] and [m[0] for m in s.scan_text("This work is licensed under the GNU Lesser General Public License, version 2.1.")] == ["lgpl-2.1"]
    for name, template in s.ALL_TEMPLATES:
        assert s.scan_text(template)[0][0] == name, template[:60]

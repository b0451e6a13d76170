"""Personal data: candidate gradient boosting with built-in SQL functions only.

Base patterns give exact spans. High-recall generators, two for each kind, propose further spans in the
text that the base spans leave; proposals of a kind or of several may overlap. Boosted trees over format
and context features score each proposal, and a threshold by kind selects. Of selected spans that overlap, the one
furthest above its threshold stays (the first of equal ones), what overlaps it goes, then the next of what is left. No
format test stands before the trees.

Bounds of the generators: a local part is proposed up to 64 characters and a label up to 63 (limits of addresses and
names), numbers of at most six groups. Base patterns have no such bounds.

Trees are trained on the driver, on examples made from templates and on proposals in a sample of the
documents themselves, of ``SAMPLE`` ids: what is proposed there and is of no full format counts as a hard
negative. Thresholds are calibrated on templates of another family and on proposals of other documents
of the sample. Trees are then nested CASE expressions, so that every document is scored in the JVM where it is
read, without a shuffle.

Positions come from marking matches with a character that no pattern can match, splitting there and
summing lengths in blocks of pieces, so the work follows the length of the text.

Defined results: a null or empty text has no spans; null ids stay as they are; repeated rows are
scanned each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.llm import boosting

#: Noncharacters: begin and end of a match, and filler. In a text they become spaces that no pattern matches.
_OPEN, _CLOSE, _FILL = "\ufdd0", "\ufdd1", "\ufdd2"
_BLANK = "\u00a0"
_BLOCK = 256

KINDS = ("email", "ip", "card", "phone")
_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?"
#: The base patterns, written so that each text is scanned once: a run is entered at its start or at
#: the end of the match before, repetition is possessive, and bounds that only drop matches are inside.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
}
#: High-recall generators by kind.
GENERATORS = {
    "email": (
        r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\}|@)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]{2,63}+)++",
        r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20at\x20[A-Za-z0-9-]{1,63}+(?:(?:\x20dot\x20|\.\x20?)[A-Za-z0-9-]{2,63}+)++",
    ),
    "ip": (
        r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
        r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,6}+(?::[0-9A-Fa-f]{1,4}){1,6}+(?![0-9A-Za-z:])",
    ),
    "card": (
        r"(?<![0-9A-Za-z])[0-9]{3,6}(?:[\x20./-][0-9]{2,7}){1,5}+(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z])[0-9]{12,19}+(?![0-9A-Za-z])",
    ),
    "phone": (
        r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,5}+\)?(?:[\x20./-]{1,2}[0-9]{2,5}+){1,4}+(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z.+-])[0-9]{7,12}+(?![0-9A-Za-z])",
    ),
}
#: Cheap tests: only such texts can hold a proposal of the generator.
_HAS = {
    "email": (r"(?:\([aA][tT]\)|\[[aA][tT]\]|\{[aA][tT]\}|@)", r"[\x20][aA][tT]\x20[A-Za-z0-9-]+(?:\x20[dD][oO][tT]\x20|\.\x20?)[A-Za-z0-9]"),
    "ip": (r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", r"[0-9A-Fa-f]::[0-9A-Fa-f]"),
    "card": (r"[0-9]{3}[\x20./-][0-9]{2}", r"[0-9]{12}"),
    "phone": (r"[0-9]{2}\)?[\x20./-]{1,2}[0-9]{2}", r"[0-9]{7}"),
}
CONTEXT = 24
FEATURES = (
    "n_digits", "n_chars", "n_separators", "n_groups", "longest", "shortest", "luhn", "first_two", "bracket", "word_phone", "word_card", "word_mail", "word_net",
    "word_other", "before_symbol", "after_symbol", "dotted", "year_like", "at_word", "dot_word", "sentence", "tld", "double_colon", "hex_letters",
)
#: Most documents of the sample; most proposals of a kind from it; made examples of a kind.
SAMPLE, MOST, MADE = 800, 400, 600
MIN_PRECISION = 0.98


def luhn(match: Column) -> Column:
    """Whether the digits of ``match`` pass the check, from the right, every second one doubled."""
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    values = F.transform(F.split(digits, ""), lambda d, i: F.try_add(d.try_cast("int"), F.when(i % 2 == 1, F.when(d.try_cast("int") > 4, d.try_cast("int") - 9).otherwise(d.try_cast("int"))).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:(?<=[0-9])\.{_BYTE}){{3}}(?<=[0-9])$")
    if kind == "card":
        return luhn(match)
    if kind == "phone":
        return _digits(match).between(8, 15)
    return F.lit(True)


_PIECE = "array<struct<start:bigint,end:bigint,m:string,before:string,after:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches of ``pattern`` with positions and their surroundings. ``text`` has no marks."""
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}")), F.lit(_OPEN))
    return _positions(pieces)


def _positions(pieces: Column) -> Column:
    # one-element transform: names the array, so that it is made once
    def whole(p: Column) -> Column:
        count = F.size(p)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / _BLOCK).cast("int")), lambda k: F.slice(p, k * _BLOCK + 1, _BLOCK))
        size = lambda x: (F.length(x) - F.instr(x, _CLOSE).cast("boolean").cast("int")).cast("long")
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + size(x)))
        starts = F.aggregate(totals, F.array(F.lit(0).cast("long")), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t)))
        empty = F.array().cast("array<struct<start:bigint,piece:string>>")

        def inside(b: Column, at: Column) -> Column:
            zero = F.struct(at.alias("pos"), empty.alias("out"))
            step = lambda a, x: F.struct((a["pos"] + size(x)).alias("pos"), F.concat(a["out"], F.array(F.struct(a["pos"].alias("start"), x.alias("piece")))).alias("out"))
            return F.aggregate(b, zero, step, lambda a: a["out"])

        placed = F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), F.slice(starts, 1, F.size(blocks)).alias("s")), lambda z: inside(z["b"], z["s"])))
        previous = F.concat(F.array(F.lit("")), F.slice(p, 1, count - 1))
        both = F.slice(F.arrays_zip(placed.alias("here"), previous.alias("prev")), 2, F.greatest(F.lit(0), count - 1))

        def span(z: Column) -> Column:
            piece, start = z["here"]["piece"], z["here"]["start"]
            cut = F.instr(piece, _CLOSE)
            return F.struct(
                start.alias("start"), (start + cut - 1).alias("end"), F.substring(piece, F.lit(1), cut - 1).alias("m"),
                F.right(F.substring_index(z["prev"], _CLOSE, -1), F.lit(CONTEXT)).alias("before"), F.substring(piece, cut + 1, F.lit(CONTEXT)).alias("after"),
            )

        return F.transform(both, span)

    return F.flatten(F.transform(F.array(pieces), whole))


def features(c: Column) -> Column:
    """The features of a proposal (m, before, after) as a struct of doubles."""
    m, before = c["m"], F.lower(c["before"])
    groups = F.split(m, "[^0-9A-Za-z]+")
    lengths = F.transform(groups, lambda g: F.length(g))
    word = lambda pattern: before.rlike(pattern).cast("double")
    values = {
        "n_digits": _digits(m), "n_chars": F.length(m), "n_separators": F.length(F.regexp_replace(m, r"[0-9A-Za-z]", "")), "n_groups": F.size(groups),
        "longest": F.array_max(lengths), "shortest": F.array_min(lengths), "luhn": luhn(m),
        "first_two": F.substring(F.regexp_replace(m, "[^0-9]", ""), 1, 2).try_cast("int"),
        "bracket": m.rlike(r"^\([0-9]{2,5}\)"), "word_phone": word(r"(?:\b(?:tel|phone|fon|telefon|tél|téléphone|teléfono|mobile?|cell|call|fax|whatsapp|contact|dial|text|ring)\b)"),
        "word_card": word(r"\b(?:card|karte|kreditkarte|carte|tarjeta|visa|mastercard|amex|credit|debit|pan|diners|charge[ds]?|pay|paid)\b"),
        "word_mail": word(r"\b(?:e-?mail|mail|contact|write|adresse|address|reach|send)\b"),
        "word_net": word(r"\b(?:ip|ipv6|host|server|address|inet6|ping|route|gateway|dns|from)\b"),
        "word_other": word(r"(?:\b(?:isbn|issn|order|invoice|version|ver|no|nr|id|page|pp|vol|date|dated|price|total|sku|mac|time|section|at|ref|tracking|serial|build|account)\b|[#€$£]\s*$)"),
        "before_symbol": c["before"].rlike(r"[^\s(:,;]$"), "after_symbol": c["after"].rlike(r"^[^\s),;.]"), "dotted": m.rlike(r"[0-9]\.[0-9]"), "year_like": m.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)"),
        "at_word": m.rlike(r"(?i)[(\[{]at[)\]}]"), "dot_word": m.rlike(r"(?i)(?:[(\[{]dot[)\]}]|\x20dot\x20)"), "sentence": m.rlike(r"\.\x20"),
        "tld": m.rlike(r"(?:^|[^a-z])(?:com|org|net|edu|gov|info|io|co|de|fr|es|it|nl|uk|us|eu|ch|at|example)$"),
        "double_colon": m.contains("::"), "hex_letters": F.length(F.regexp_replace(m, "[^A-Fa-f]", "")),
    }
    return F.struct(*(F.coalesce(values[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES))


#: What stands before personal data and before other things, by family: 0 to train, 1 to calibrate.
_WORDS = {
    "phone": (["tel ", "phone: ", "call ", "Telefon: ", "mobile "], ["fax ", "contact: ", "dial ", "whatsapp "]),
    "card": (["card ", "visa: ", "credit card no ", "paid with "], ["amex ", "tarjeta: ", "debit card "]),
    "email": (["mail ", "email: ", "write to "], ["contact ", "reach me: ", "send to "]),
    "ip": (["host ", "ipv6 ", "server ", "ping "], ["address: ", "gateway ", "from "]),
}
_OTHER_WORDS = (["isbn ", "order ", "invoice ", "version ", "no ", "page ", "price ", "#", "sku "], ["id ", "date ", "total ", "$", "ref ", "tracking ", "serial "])


def _made(seed: int, count: int, family: int = 0) -> list[tuple[str, str, str, str, int]]:
    """Examples (kind, match, before, after, label) from the templates of a family, ``count`` of each kind."""
    rng = random.Random(seed * 2 + family)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice(("aeiourstnlmd", "aeiobcfghkpvwz")[family]) for _ in range(rng.randint(2, 9)))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    tld = lambda: rng.choice((["com", "org", "de", "fr"], ["net", "edu", "io", "es"])[family])

    def checked(start: str, n: int, good: bool = True) -> str:
        body = start + digits(n - 1 - len(start))
        total = sum((2 * int(d) - 9 * (int(d) > 4)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(body)))
        last = -total % 10
        return body + str(last if good else (last + rng.randint(1, 9)) % 10)

    def grouped(d: str) -> str:
        s = rng.choice(([" ", "-", ""], [".", " ", ""])[family])
        return s.join((d[:4], d[4:10], d[10:])) if len(d) in (14, 15) else s.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone(good: bool) -> str:
        if good:
            return rng.choice(([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", digits(10)], [f"0{digits(2)}/{digits(4)} {digits(3)}", f"({digits(3)}) {digits(7)}"[:14], f"{digits(3)} {digits(3)} {digits(4)}", f"0{digits(9)}"])[family])
        return rng.choice(([f"20{digits(2)}-{digits(2)}-{digits(2)}", f"978-{digits(1)}{digits(1)}-{digits(5)}", f"{digits(3)} {digits(3)}", f"19{digits(2)}-20{digits(2)}", f"{digits(2)} {digits(2)}", digits(8), digits(10)], [f"{digits(2)}.{digits(2)}.19{digits(2)}", f"{digits(3)}-{digits(4)}", f"{digits(4)} {digits(4)} {digits(4)}", digits(7), f"20{digits(6)}", digits(11)])[family])

    def card(good: bool) -> str:
        if good:
            start, n = rng.choice([("34", 15), ("37", 15), ("4", 13), ("36", 14), ("38", 14), ("4", 16), ("51", 16)])
            return grouped(checked(start, n))
        return rng.choice(([grouped(checked(rng.choice("3456"), rng.choice([13, 15, 16]), False)), digits(rng.choice([12, 13, 14])), f"{digits(4)}-{digits(2)}-{digits(2)}", checked("978", 13)], [checked(rng.choice("12789"), rng.choice([13, 15, 16])), f"20{digits(12)}", f"{digits(4)}.{digits(3)}", checked("4", 16, False)])[family])

    def email(good: bool) -> str:
        a, b, c = name() + rng.choice(["", "." + name(), digits(2)]), name(), name().capitalize()
        if good:
            return rng.choice(([f"{a} (at) {b} (dot) {tld()}", f"{a}[at]{b}.{tld()}", f"{a} at {b} dot {tld()}", f"{a} @ {b}.{tld()}"], [f"{a} {{at}} {b} {{dot}} {tld()}", f"{a}(at){b}(dot){tld()}", f"{a} at {b}.{tld()}", f"{a}@{b} [dot] {tld()}"])[family])
        return rng.choice(([f"{name()} at {b}. {c}", f"{name()} @ {b}. {c}", f"{name()} at {b} dot {name()}", f"{name()} at {b}.{c}"], [f"{c} at {b}. {c}", f"{name()}@ {b}. {name()}", f"{c} at {b} dot {name()}", f"{name()} @{b} . {name()}"])[family])

    def ip(good: bool) -> str:
        if good:
            return rng.choice(([":".join(hexes(4) for _ in range(8)), f"2001:{hexes(3)}::{hexes(4)}:{hexes(2)}", f"fe80::{hexes(4)}:{hexes(4)}"], [":".join(hexes(rng.randint(1, 4)) for _ in range(8)), f"2a02:{hexes(4)}:{hexes(4)}::{hexes(1)}", f"fd00:{hexes(4)}::{hexes(4)}"])[family])
        return rng.choice(([":".join(hexes(2) for _ in range(6)), ":".join(digits(2) for _ in range(4)), "::".join(("add", rng.choice(["face", "bad", "cafe"])))], [":".join(hexes(2) for _ in range(8)), ":".join(digits(1) for _ in range(rng.randint(4, 6))), "::".join((rng.choice(["dead", "fed"]), "bed"))])[family])

    made = {"phone": phone, "card": card, "email": email, "ip": ip}
    out = []
    for kind in KINDS:
        for i in range(count):
            good = i % 2
            plain = name() + " "
            before = rng.choice([rng.choice(_WORDS[kind][family]), rng.choice(_WORDS[kind][family]), plain]) if good else rng.choice([rng.choice(_OTHER_WORDS[family]), plain, plain])
            if good and kind == "phone" and before is plain:
                before = rng.choice(_WORDS[kind][family])
            out.append((kind, made[kind](good), before, rng.choice([" ", ".", ",", " " + name(), ""]), good))
            if good and kind in ("phone", "card") and i % 6 == 1:  # the same form is something else elsewhere
                out.append((kind, out[-1][1], rng.choice(_OTHER_WORDS[family]), " ", 0))
    return out


def _featured(spark: SparkSession, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Features by the very expressions that score documents."""
    text = json.dumps([dict(zip(("kind", "m", "before", "after", "y"), r)) for r in rows])
    df = spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<kind:string,m:string,before:string,after:string,y:int>>")))
    got = df.select("y", features(F.struct("m", "before", "after")).alias("f")).collect()
    return np.array([[r["f"][f] for f in FEATURES] for r in got], float), np.array([r["y"] for r in got], float)


def _fit(x: np.ndarray, y: np.ndarray) -> boosting.Forest:
    return boosting.fit(x, y, trees=24, depth=4, rate=0.3, bins=24)


def _threshold(odds: np.ndarray, truth: np.ndarray) -> float:
    """The lowest log odds from which on ``MIN_PRECISION`` of the examples are right; even odds at least."""
    order = np.argsort(-odds, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    last = np.append(odds[order][1:] != odds[order][:-1], True)  # equal odds go together
    good = odds[order][(right >= MIN_PRECISION) & last]
    return max(0.0, float(good.min())) if len(good) else float("inf")


def of_no_full_format(kind: str, c: Column) -> Column:
    """Which proposals of documents may count as negatives: those that are surely not of the kind's full format."""
    n, m = _digits(c["m"]), c["m"]
    full = {
        "email": m.rlike(r"(?i)[(\[{]at[)\]}]|\x20dot\x20") | m.rlike(r"@[^\x20]*$") | m.rlike(r"@\x20[A-Za-z0-9-]+\.[a-z]{2,4}$"),
        "ip": m.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$|::"),
        "card": luhn(m) & n.between(13, 19),
        "phone": n.between(9, 12),
    }
    return ~full[kind]


def _of_documents(docs: DataFrame, text: Column, id_col: str) -> list[tuple[str, str, str, str, int]]:
    """Hard negatives: at most ``MOST`` proposals of each kind in the ``SAMPLE`` documents whose ids have the least hashes."""
    key = F.xxhash64(F.lit(7), F.col(id_col))
    least = docs.select(key.alias("_k")).where("_k is not null").distinct().orderBy("_k").limit(SAMPLE)
    last = least.agg(F.max("_k")).first()[0]
    if last is None:
        return []
    some = docs.where(key <= last).select(text.alias("_t")).distinct()  # copies of a text teach nothing more
    shown = _proposed(some.select(F.lit(0).alias("_id"), "_t"))
    tagged = lambda k: F.transform(_only(f"_c_{k}", partial(of_no_full_format, k)), lambda c: F.struct(F.lit(k).alias("kind"), c["m"].alias("m"), c["before"].alias("before"), c["after"].alias("after")))
    rows = shown.select(F.explode(F.concat(*(tagged(k) for k in KINDS))).alias("c")).select("c.*").distinct()
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.xxhash64("m", "before", "after"), "m", "before", "after"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= MOST).orderBy("kind", "rank").collect()
    return [(r.kind, r.m, r.before, r.after, 0) for r in rows]


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, tuple[boosting.Forest, float]]:
    """A forest and a threshold (log odds) by kind, from templates and from proposals of the sampled documents."""
    spark = docs.sparkSession
    real = _of_documents(docs, _clean(F.col(text_col)), id_col)
    train, held = _made(11, MADE) + real[::2], _made(12, MADE, 1) + real[1::2]
    out = {}
    x, y = _featured(spark, train + held)
    kinds = np.array([r[0] for r in train + held])
    is_train = np.arange(len(kinds)) < len(train)
    for kind in KINDS:
        a, b = (kinds == kind) & is_train, (kinds == kind) & ~is_train
        forest = _fit(x[a], y[a])
        out[kind] = forest, _threshold(forest.score(x[b]), y[b])
    return out


def as_column(forest: boosting.Forest, f: Column) -> Column:
    """The forest's log odds as nested CASE expressions over the struct ``f``."""

    def node(i: int) -> Column:
        if forest.left[i] == i:
            return F.lit(float(forest.value[i]))
        return F.when(f[FEATURES[int(forest.feature[i])]] <= float(forest.threshold[i]), node(int(forest.left[i]))).otherwise(node(int(forest.right[i])))

    total = F.lit(forest.bias)
    for root in forest.roots:
        total = total + node(int(root))
    return total


def _no_spans() -> Column:
    return F.array().cast(_PIECE)


def _clean(text: Column) -> Column:
    """``text`` without the marks, null being empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(f"[{_OPEN}{_CLOSE}{_FILL}]"), F.translate(text, _OPEN + _CLOSE + _FILL, _BLANK * 3)).otherwise(text)


def _proposed(texts: DataFrame) -> DataFrame:
    """``texts`` (``_id``, ``_t`` without marks) as ``_id``, base spans ``_b_kind`` and proposals ``_c_kind``."""
    out = texts.select("_id", "_t", F.instr("_t", "@").alias("_at"), F.instr("_t", "+").alias("_plus"), F.col("_t").rlike("[0-9]").alias("_num"))
    may = {"email": F.col("_at") > 0, "ip": F.col("_num"), "card": F.col("_num"), "phone": (F.col("_plus") > 0) & F.col("_num")}
    out = out.select("_id", "_t", "_num", *(F.when(may[k] & F.col("_t").rlike(BASE[k]), matches(F.col("_t"), BASE[k])).otherwise(_no_spans()).alias(f"_b_{k}") for k in KINDS))
    out = out.select("_id", "_t", "_num", *(_only(f"_b_{k}", partial(valid, k), "m").alias(f"_b_{k}") for k in KINDS))
    # the text that they leave, at equal positions: kind after kind, since spans of kinds overlap
    for k in ("email", "phone", "card", "ip"):
        out = out.withColumn("_t", F.when(F.size(f"_b_{k}") > 0, _masked(F.col("_t"), k)).otherwise(F.col("_t")))
    digits = {"email": F.lit(True), "ip": F.lit(True), "card": F.col("_num"), "phone": F.col("_num")}
    found = lambda k: F.concat(*(F.when(digits[k] & F.col("_t").rlike(has), matches(F.col("_t"), g)).otherwise(_no_spans()) for g, has in zip(GENERATORS[k], _HAS[k])))
    return out.select("_id", *(f"_b_{k}" for k in KINDS), *(found(k).alias(f"_c_{k}") for k in KINDS))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: dict[str, tuple[boosting.Forest, float]] | None = None) -> DataFrame:
    """One row per document: its id, ``base`` and ``added`` spans (kind, start, end), by kind, then start."""
    models = models or fitted(docs, id_col, text_col)
    out = _proposed(docs.select(F.col(id_col).alias("_id"), _clean(F.col(text_col)).alias("_t")))
    for k in KINDS:
        forest, threshold = models[k]
        scored = F.transform(f"_c_{k}", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), features(c).alias("f")))
        out = out.withColumn(f"_c_{k}", F.transform(scored, partial(_weighed, k, forest, threshold)))
        out = out.withColumn(f"_c_{k}", F.filter(f"_c_{k}", lambda c: c["over"] >= 0))
    every = F.array_sort(F.concat(*(f"_c_{k}" for k in KINDS)))
    out = out.withColumn("_c", F.when(F.size(F.concat(*(f"_c_{k}" for k in KINDS))) > 1, every).otherwise(F.concat(*(f"_c_{k}" for k in KINDS))))
    out = out.withColumn("_c", F.when(F.size("_c") > 1, _disjoint(F.col("_c"))).otherwise(F.col("_c")))
    added = F.concat(*(_tagged(_only("_c", partial(_is, k), "kind"), k) for k in KINDS))
    return out.select(F.col("_id").alias(id_col), F.concat(*(_tagged(f"_b_{k}", k) for k in KINDS)).alias("base"), added.alias("added"))


def _weighed(kind: str, forest: boosting.Forest, threshold: float, c: Column) -> Column:
    """A proposal with how far its score is above the kind's threshold."""
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), (as_column(forest, c["f"]) - F.lit(threshold)).alias("over"), F.lit(kind).alias("kind"))


def _settled(run: Column) -> Column:
    """Of a run of spans those that stay: by how far they are above their threshold, each unless one that stays overlaps it."""
    ranked = F.array_sort(F.transform(run, lambda c: F.struct((-c["over"]).alias("o"), c["start"].alias("start"), c.alias("c"))))
    best = F.transform(ranked, lambda c: c["c"])

    def add(chosen: Column, c: Column) -> Column:
        return F.when(F.exists(chosen, lambda d: (d["start"] < c["end"]) & (c["start"] < d["end"])), chosen).otherwise(F.concat(chosen, F.array(c)))

    return F.when(F.size(run) > 1, F.array_sort(F.aggregate(best, F.slice(best, 1, 0), add))).otherwise(run)


def _disjoint(every: Column) -> Column:
    """Spans, in order of starts, without those that lose to others. Runs of overlapping spans are settled one by one, so
    the work follows their length, not the text's."""
    none = F.slice(every, 1, 0)
    state = lambda done, run, end: F.struct(done.alias("done"), run.alias("run"), end.alias("end"))

    def step(s: Column, c: Column) -> Column:
        begun = state(F.concat(s["done"], _settled(s["run"])), F.array(c), c["end"].cast("long"))
        return F.when(c["start"] >= s["end"], begun).otherwise(state(s["done"], F.concat(s["run"], F.array(c)), F.greatest(s["end"], c["end"].cast("long"))))

    return F.aggregate(every, state(none, none, F.lit(0).cast("long")), step, lambda s: F.concat(s["done"], _settled(s["run"])))


def _only(array: Column | str, test: Callable[[Column], Column], field: str | None = None) -> Column:
    return F.filter(array, lambda c: test(c[field] if field else c))


def _tagged(array: Column | str, kind: str) -> Column:
    return F.transform(array, lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))


def _is(kind: str, k: Column) -> Column:
    return k == kind


def _masked(text: Column, kind: str) -> Column:
    """``text`` with valid base matches of ``kind`` as filler of the same length."""
    marked = F.split(F.regexp_replace(text, F.lit(BASE[kind]), F.lit(f"{_OPEN}$0{_CLOSE}")), F.lit(_OPEN))

    def fill(piece: Column, i: Column) -> Column:
        m, gap = F.substring_index(piece, _CLOSE, 1), F.substring_index(piece, _CLOSE, -1)
        return F.when(i == 0, piece).otherwise(F.concat(F.when(valid(kind, m), F.repeat(F.lit(_FILL), F.length(m))).otherwise(m), gap))

    return F.array_join(F.transform(marked, fill), "")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query: base counts and hash, and all spans by kind, then start."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    every = F.concat(*(F.array_sort(_only(F.concat("base", "added"), partial(_is, k), "kind")) for k in KINDS))
    return found.select(
        id_col,
        *(F.size(_only("base", partial(_is, k), "kind")).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )

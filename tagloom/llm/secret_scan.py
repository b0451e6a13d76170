"""Secret scans through a trigram inverted index.

From the parse tree of each rule's regex a Boolean query over trigrams is derived (AND of ORs of
ANDs). Each block of texts gets an inverted index of the trigrams which the queries name; postings
are intersected and united, and only the candidates are verified with the regex itself. A rule
without mandatory trigrams (such as a run of hex digits) scans every text of the block.

A private key is its BEGIN line and all up to its END line, however far and whatever is between, unless another BEGIN or
END line comes first; of a key that is cut off, the lines of base64 that follow.

Defined results: a null or empty text has no spans; null ids stay as they are; repeated rows are
scanned each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bounded, numbered, slices

_PARSE = re._parser.parse
_MAX_EXACT = 32

#: A clause is an OR of trigram sets, a query an AND of clauses; no clauses: every text qualifies.
Clause = frozenset[frozenset[str]]
Query = tuple[Clause, ...]


@dataclass(frozen=True)
class Rule:
    """``group`` is the group whose length must reach ``least``; 0: the whole match."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False
    base: bool = False
    closed: bool = False  # a match goes on to ``closing_end``

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.A | (re.I if self.ignore_case else 0))


#: Base rules in their fixed order, then the method's own ones.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, False, True),
    Rule("hex", r"[0-9a-f]{24,}", 24, 0, False, True),  # runs are maximal, so shorter ones need not be looked at
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", closed=True),
)

#: What is found after a key's BEGIN line: the next line of this kind, a key's END line, and a body that is cut off: whole lines of base64
#: and headers, then one shorter line up to its end (groups 1, and 3 of what else is matched).
_NEXT = r"-----(?:BEGIN|END) "
_END = r"-----END [A-Z ]{0,24}PRIVATE KEY-----"
_SEPARATED = r"""(?:[ \t\n\x0b\x0c\r"',>#*|]|\\[nrt])*"""
_CUT_OFF = rf"""((?:{_SEPARATED}(?:(?:Proc-Type|DEK-Info):[^\n\\]*|[A-Za-z0-9+/]{{32,}}={{0,2}}))*)(({_SEPARATED}[A-Za-z0-9+/]{{1,31}}={{0,2}})[ \t\r"']*(?:\n|\\|$))?"""
_NEXT_RE, _END_RE, _CUT_OFF_RE = re.compile(_NEXT), re.compile(_END), re.compile(_CUT_OFF.replace("$", r"\Z"))


def closing_end(text: str, at: int) -> int:
    """Where the key ends whose BEGIN line ends at ``at``. Each call reads up to the next such line."""
    following = _NEXT_RE.search(text, at)
    if following and (end := _END_RE.match(text, following.start())):
        return end.end()
    cut_off = _CUT_OFF_RE.match(text, at)
    if not cut_off.group(1):
        return at
    return cut_off.end(3) if cut_off.group(3) else cut_off.end(1)


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every match of ``pattern`` satisfies, in lower case."""
    clauses: list[Clause] = []

    def absorb(exact: frozenset[str]) -> None:
        if all(len(s) >= 3 for s in exact):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact}
            clauses.append(frozenset(s for s in sets if not any(o < s for o in sets)))

    def walk(items) -> frozenset[str] | None:
        """Exact strings of a sequence, or None after what is known went into clauses."""
        exact, whole = frozenset({""}), True
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                now = frozenset({chr(arg).lower()})
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
                now = frozenset(chr(a).lower() for _, a in arg)
            elif name == "SUBPATTERN":
                now = walk(arg[3])
            elif name == "BRANCH":
                parts = [inner_exact(x) for x in arg[1]]
                now = frozenset().union(*parts) if all(p is not None for p in parts) else None
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, what = arg
                now = inner_exact(what) if high == 1 or low == high == 1 else None
                if now is not None and low == 0:
                    now |= {""}
                elif now is None and low >= 1 and (once := walk(what)) is not None:
                    absorb(once)
            elif name in ("AT", "ASSERT", "ASSERT_NOT"):
                now = frozenset({""})
            else:
                now = None
            joined = now is not None and len(exact) * len(now) <= _MAX_EXACT
            if joined:
                exact = frozenset(a + b for a in exact for b in now)
            else:
                absorb(exact)
                whole, exact = False, now or frozenset({""})
        if whole:
            return exact
        absorb(exact)
        return None

    def inner_exact(items) -> frozenset[str] | None:
        """As ``walk``, but what an optional or alternative part needs is no need of the whole."""
        before = len(clauses)
        got = walk(items)
        del clauses[before:]
        return got

    if (exact := walk(_PARSE(pattern, re.A))) is not None:
        absorb(exact)
    return tuple(clauses)


@lru_cache(8)
def _plan(rules: tuple[Rule, ...]) -> tuple[list[tuple[Rule, re.Pattern, Query]], dict[str, int], np.ndarray]:
    parts = [(rule, rule.compiled(), trigram_query(rule.pattern)) for rule in rules]
    names = sorted({t for _, _, query in parts for clause in query for s in clause for t in s if t.isascii()})
    wanted = {t: i + 1 for i, t in enumerate(names)}
    lookup = np.zeros(1 << 24, np.uint16)
    for t, i in wanted.items():
        a, b, c = t.encode()
        lookup[a << 16 | b << 8 | c] = i
    return parts, wanted, lookup


class BlockIndex:
    """Postings (sorted document numbers) of the wanted trigrams over a block of texts."""

    CHUNK = 1 << 21

    def __init__(self, texts: list[str], wanted: dict[str, int], lookup: np.ndarray):
        raw = [text.encode("utf-8", "surrogatepass").lower() for text in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        pairs = []
        for at in range(0, max(0, len(data) - 2), self.CHUNK):
            a = data[at : at + self.CHUNK + 2].astype(np.uint32)
            found = lookup[a[:-2] << 16 | a[1:-1] << 8 | a[2:]]
            hits = np.flatnonzero(found)
            if len(hits):
                docs = np.searchsorted(ends, hits + at, "right")
                pairs.append(found[hits].astype(np.int64) << 32 | docs)
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        terms, docs = pairs >> 32, pairs & 0xFFFFFFFF
        self.n, self.wanted, self.docs = len(texts), wanted, docs
        self.starts = np.searchsorted(terms, np.arange(len(wanted) + 2))

    def postings(self, trigram: str) -> np.ndarray | None:
        if (i := self.wanted.get(trigram)) is None:  # not ASCII: not indexed
            return None
        return self.docs[self.starts[i] : self.starts[i + 1]]

    def candidates(self, query: Query) -> np.ndarray:
        every = np.arange(self.n)
        out = every
        for clause in query:
            union = np.empty(0, np.int64)
            for terms in clause:
                part = every
                for term in terms:
                    if (got := self.postings(term)) is not None:
                        part = np.intersect1d(part, got, assume_unique=True)
                union = np.union1d(union, part)
            out = np.intersect1d(out, union, assume_unique=True)
        return out


def scan_texts(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """Spans (kind, start, end; code points) of each text by start, then the order of ``rules``."""
    parts, wanted, lookup = _plan(rules)
    index = BlockIndex(texts, wanted, lookup)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for order, (rule, regex, query) in enumerate(parts):
        for i in index.candidates(query):
            for m in regex.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), order, closing_end(texts[i], m.end()) if rule.closed else m.end()))
    return [[(rules[k].kind, s, e) for s, k, e in sorted(x)] for x in found]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its id and ``spans``, all matches of ``rules``. Map-side only."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            spans = scan_texts([t or "" for t in texts], rules)
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans]
            yield pa.RecordBatch.from_arrays([pa.array(ids, kinds[0]), pa.array(rows, _ARROW_SPANS)], ["id", "spans"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(source.schema["id"].dataType)]
    out = bounded(source).mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, spans {SPANS}")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mask``; overlapping spans are joined first."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(at).to_pylist()
                new = [masked(t, s, mask) if s else t for t, s in zip(texts, scan_texts([t or "" for t in texts], rules))]
                columns = [*part.columns]
                columns[at] = pa.array(new, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return numbered(docs).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    out, done = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join([*out, text[done:]])


def span_text(spans: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    chosen = F.filter(spans, keep) if keep else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query: counts and hash of the base rules' spans, and all spans as text."""
    spans, base = F.col("spans"), [r.kind for r in RULES if r.base]
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        *(count(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(span_text(spans, lambda s: s["kind"].isin(base)), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The query in DuckDB's SQL: matches are marked by characters that no rule has, split there, and
    their places are sums of lengths."""

    def spelled(pattern: str) -> str:
        """Letters outside classes in both cases, and no capturing groups but the last."""
        out, inside = "", False
        for i, c in enumerate(pattern):
            inside = (inside or c == "[") and c != "]"
            out += f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() and not inside and pattern[i - 1] != "\\" and pattern[i - 3 : i - 1] != "\\x" else c
        return out

    parts = []
    for order, rule in enumerate(rules):
        pattern = (spelled(rule.pattern) if rule.ignore_case else rule.pattern).replace("'", "''")
        parts.append(f"""
  select r, '{rule.kind}' as kind, {order} as o, unnest(list_transform(range(2, len(x) + 1), lambda i: {{
      's': cast(list_sum(list_transform(x[1 : i - 1], lambda y: length(y))) - (i - 2) as bigint), 'm': split_part(x[i], chr(2), 1)}})) as p, {rule.group} as g, {rule.least} as least, '{pattern}' as pattern
  from (select r, string_split(regexp_replace(text, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as x from d)""")
    base = ", ".join(f"'{rule.kind}'" for rule in rules if rule.base)
    counts = ", ".join(f"count(*) filter (kind = '{rule.kind}') as n_{rule.kind}" for rule in rules if rule.base)
    span = "kind || ':' || p.s || ':' || (p.s + length(p.m) + more)"
    closed = ", ".join(f"'{rule.kind}'" for rule in rules if rule.closed) or "''"
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    # a rule with a group has one before it, in its pattern and so in the match
    return f"""
with d as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) as text from documents),
m as ({" union all ".join(parts)}),
k as (select * from m where length(case when g = 0 then p.m else regexp_extract(p.m, '{(spelled(next(r for r in rules if r.group).pattern)).replace("'", "''")}', 2) end) >= least),
after_ as (select k.*, substr(d.text, cast(p.s + length(p.m) + 1 as bigint)) as rest from k join d using (r) where kind in ({closed})),
upto as (select *, regexp_matches(rest, {quoted("(?s)^.*?" + _NEXT)}) as followed, length(regexp_extract(rest, {quoted("(?s)^(.*?)" + _NEXT)}, 1)) as n from after_),
ends as (select *, length(regexp_extract(substr(rest, n + 1), {quoted("^" + _END)})) as e, length(regexp_extract(rest, {quoted("^" + _CUT_OFF)}, 1)) as whole, length(regexp_extract(rest, {quoted("^" + _CUT_OFF)}, 3)) as last from upto),
every as (
  select r, kind, o, p, 0 as more from k where kind not in ({closed})
  union all
  select r, kind, o, p, case when followed and e > 0 then n + e when whole > 0 then whole + last else 0 end from ends),
a as (select r, {counts}, string_agg({span}, ',' order by p.s, o) filter (kind in ({base})) as base, string_agg({span}, ',' order by p.s, o) as spans from every group by r)
select doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0) as n_{rule.kind}" for rule in rules if rule.base)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (r)
"""

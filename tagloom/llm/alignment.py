"""Cross-tokenizer alignment by hash-set intersection of cumulative ends, and corpus-wide counts of linked ids.

A text is encoded by a byte-level BPE (A) and a sentence-piece BPE with byte fallback (B). The byte offsets where
tokens end are kept in a dictionary from end to index for each tokenizer; the ends found in both, sorted, slice both id
lists into groups, and each group is expanded into the links of its A and B tokens that overlap.

Both tokenizers always cut a text before a single space or line feed between two characters that are not white
space (which is verified for B's pieces), so a text is a row of such units, whose groups join to those of the text. A task encodes and aligns units that it does not
know, many as one text, and remembers the short ones (two generations of a bounded number).

Counts, over all documents:

1. A pass over the texts writes each document's figures and its distinct id pairs with their numbers of links.
2. Documents are counted by pair, in each task before the shuffle; so is the highest count of each A id.
3. Counts are cut into slices of bounded size by pair. Each slice is sent to some lanes, and each document's pairs of
   it to one of these, where they are looked up in arrays; sums by document are added up over slices.

So a pair that is in every document is a row of each task's count, not a row of each document, and no
task holds more than one slice.

Defined results: a null or empty text, or one whose tokens' bytes are not those of a space and the text (such as a
text with U+2581) has no tokens: zeros and an empty ``groups_sha256``; repeated rows, and rows with a
null id, are documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.llm.common import bounded, slices, written

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text that are cut into units at once; units that a task remembers, and the longest of them.
PIECE, REMEMBERED, REMEMBERED_CHARS = 1 << 18, 1 << 18, 48
#: Pairs that a task counts before it gives them on; pairs of a slice, of a chunk of it.
COUNTED, SLICE_PAIRS, CHUNK_PAIRS = 1 << 20, 1 << 21, 1 << 14
#: A space or line feed between two characters that are not white space begins a unit.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: What is before units that are encoded together; no token holds its end and what follows.
LEAD = " ."


#: Of a unit: its groups as text (None: its bytes are not those of its tokens), codes of its links, numbers of A and B tokens and of groups.
Unit = tuple[str | None, bytes, int, int, int]
UNKNOWN: Unit = (None, b"", 0, 0, 0)


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: itself where it is visible, else the next from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner(dict):
    """Aligned units by their text."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        super().__init__()
        self.before: dict[str, Unit] = {}
        self.long: dict[str, Unit] = {}
        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings in a text are then ordinary text
        of = byte_level()
        entry = lambda token: bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        piece = lambda k: bytes([int(self.b.id_to_piece(k)[1:-1], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode()
        by_id = {k: token for token, k in self.a.get_vocab().items()}
        self.bytes_a, self.bytes_b = [entry(by_id.get(k, "")) for k in range(max(by_id) + 1)], [piece(k) for k in range(self.b.get_piece_size())]
        self.long_a, self.long_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        # ids as text, followed by what follows within a group and at its end
        self.text_a, self.text_b = (np.array([f"{k}{c}" for c in ("," + end) for k in range(len(x))], object) for x, end in ((self.bytes_a, "|"), (self.bytes_b, ";")))
        inside = any(" " in p.lstrip(" ") or "\n" in p and len(p) > 1 for p in (x.decode("utf-8", "ignore") for x in self.bytes_b))
        self.whole = inside or self.a.normalizer is not None  # pieces over words: no cuts

    def units(self, text: str) -> Iterator[list[str]]:
        """Units of a space and ``text``, those of a stretch at a time."""
        text, at = f" {text}", 0
        while at < len(text):
            cut = None if self.whole else _CUT.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            yield [text[at:end]] if self.whole else _CUT.split(text[at:end])
            at = end

    def learn(self, units: list[str]) -> None:
        """Align units that are not known, as one text: it is cut between them in any case."""
        units = [LEAD, *units]
        joined = "".join(units)
        a, b = self.a.encode(joined, add_special_tokens=False).ids, self.b.encode(joined[1:])
        raw = joined.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            for u in units[1:] if len(units) > 2 else ():
                self.learn([u])
            if len(units) == 2:
                self._keep(units[1], UNKNOWN)
            return
        a, b = np.array(a), np.array(b)
        ends_a, ends_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        index_a, index_b = ({end: k for k, end in enumerate(ends.tolist(), 1)} for ends in (ends_a, ends_b))
        common = sorted(index_a.keys() & index_b.keys())
        cut_a, cut_b = (np.fromiter(map(index.__getitem__, common), np.int64, len(common)) for index in (index_a, index_b))
        # slices: both sides' ids as text, A's before B's within each group
        size_a, size_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a - 1] = last_b[cut_b - 1] = 1
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + np.repeat(cut_b - size_b, size_a)] = self.text_a[a + len(self.bytes_a) * last_a]
        text[np.arange(len(b)) + np.repeat(cut_a, size_b)] = self.text_b[b + len(self.bytes_b) * last_b]
        # links: in a group, what lies between neighbouring ends of either is in one A and one B token
        ends = np.union1d(ends_a, ends_b)
        codes = (a[np.searchsorted(ends_a, ends)] << 32 | b[np.searchsorted(ends_b, ends)]).astype("<i8").tobytes()
        of_unit = np.cumsum([len(u) for u in units] if joined.isascii() else [len(u.encode()) for u in units])
        to_a, to_b, to_group, to_link = (np.searchsorted(x, of_unit, "right").tolist() for x in (ends_a, ends_b, np.array(common), ends))
        text, i, j, g, k = text.tolist(), to_a[0], to_b[0], to_group[0], to_link[0]
        for unit, i2, j2, g2, k2 in zip(units[1:], to_a[1:], to_b[1:], to_group[1:], to_link[1:]):
            self._keep(unit, ("".join(text[i + j : i2 + j2])[:-1], codes[8 * k : 8 * k2], i2 - i, j2 - j, g2 - g))
            i, j, g, k = i2, j2, g2, k2

    def _keep(self, unit: str, found: Unit) -> None:
        if len(unit) > REMEMBERED_CHARS:
            self.long[unit] = found
            return
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[unit] = found

    def __missing__(self, unit: str) -> Unit:
        found = self.before.get(unit) or self.long.get(unit)
        if found is None:
            self.learn([unit])
            return self.get(unit) or self.long[unit]
        self._keep(unit, found)
        return found

    def prepare(self, some: list[str]) -> None:
        """Learn those of ``some`` that are not known, a stretch at a time; long ones are known until the next call."""
        self.long.clear()
        new, at = [], 0
        for u in set(some).difference(self):
            if u not in self.before:
                if u[-1].isspace():  # the end of a text; it may join the white space of another unit
                    self.learn([u])
                else:
                    new.append(u)
        while at < len(new):
            end, size = at, 0
            while end < len(new) and size < PIECE:
                size += len(new[end])
                end += 1
            self.learn(new[at:end])
            at = end

    def text(self, stretches: Iterable[list[str]]) -> tuple[int, int, int, int, np.ndarray, np.ndarray, str]:
        """Numbers of A and B tokens, groups and links, distinct codes and their numbers, and the hash of the groups, of a text's units."""
        digest, codes, sizes = hashlib.sha256(), [], np.zeros(3, np.int64)
        for some in stretches:
            groups, of, *counts = zip(*map(self.__getitem__, some))
            if None in groups:
                codes.clear()
                break
            if codes:
                digest.update(b";")
            digest.update(";".join(groups).encode())
            codes.append(b"".join(of))
            sizes += [sum(c) for c in counts]
        if not codes:
            return 0, 0, 0, 0, np.empty(0, np.int64), np.empty(0, np.int64), ""
        every = np.frombuffer(b"".join(codes), "<i8")
        distinct, times = np.unique(every, return_counts=True)
        return *sizes.tolist(), len(every), distinct, times, digest.hexdigest()

    def _prepared(self, text: str) -> Iterator[list[str]]:
        for some in self.units(text):
            self.prepare(some)
            yield some

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray, str]]:
        """What ``text`` gives, of each text; short ones are prepared together."""
        held, size = [], 0
        for k, text in enumerate(texts):
            text = text or ""
            if len(text) < PIECE:
                held.append([some for some in self.units(text)] if text else [])
                size += len(text)
            if size >= PIECE or len(text) >= PIECE or k + 1 == len(texts):
                self.prepare([u for stretches in held for some in stretches for u in some])
                yield from map(self.text, held)
                held, size = [], 0
            if len(text) >= PIECE:
                yield self.text(self._prepared(text))


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """Kept for the next task of the same Python worker."""
    return Aligner(a_path, b_path)


_FIGURES = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_KINDS = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
_NAMES = [c.split()[0] for c in _FIGURES.split(", ")]


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A table with a ``row`` number, figures and ``groups_sha256`` of every document, its distinct pairs as ``codes``
    (A id in the upper half) and their ``times``."""
    paths = _paths(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = aligner(*paths), TaskContext.get().partitionId() << 40
        for ids, texts in slices(batches):
            rows = []
            for id_, (*sizes, codes, times, digest) in zip(ids, known.texts(texts)):
                rows.append((row, id_, *sizes, digest, codes.astype("<i8").tobytes(), times.astype("<u4").tobytes()))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], [*_NAMES, "codes", "times"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(bounded(source).mapInArrow(run, f"{_FIGURES}, codes binary, times binary"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A row for each group of every document: id, its number from 0, and its ``a_ids`` and ``b_ids``."""
    paths = _paths(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(*paths)
        for ids, texts in slices(batches):
            for id_, text in zip(ids, texts):
                at, some = 0, [[known[u][0] for u in units] for units in known._prepared(text)] if text else []
                if any(None in part for part in some):
                    continue
                for part in some:
                    sides = [g.split("|") for u in part for g in u.split(";")]
                    lists = [pa.array([list(map(int, s[k].split(","))) for s in sides], pa.list_(pa.int32())) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([id_] * len(sides), pa.int64()), pa.array(np.arange(at, at + len(sides))), *lists], ["doc_id", "group", "a_ids", "b_ids"])
                    at += len(sides)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return bounded(source).mapInArrow(run, "doc_id bigint, group bigint, a_ids array<int>, b_ids array<int>").withColumnRenamed("doc_id", id_col)


def _longs(raw: pa.Array | pa.ChunkedArray, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), kind)


def pair_counts(table: DataFrame) -> DataFrame:
    """``code`` and in how many documents of an ``aligned`` table it is linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([k for _, k in held])).astype(np.int64)

        for batch in batches:
            codes, k = np.unique(_longs(batch.column(0)), return_counts=True)
            held.append((codes, k))
            n += len(codes)
            if n >= COUNTED:
                held[:] = [summed()]
                n = len(held[0][0])
                if n >= COUNTED // 2:  # mostly different ones
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), ["code", "docs"])
                    n = 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, summed())), ["code", "docs"])

    return bounded(table.select("codes")).mapInArrow(count, "code bigint, docs bigint").groupBy("code").agg(F.sum("docs").alias("docs"))


def _chunks(counts: DataFrame, n: int) -> DataFrame:
    """The counts in ``n`` slices, as rows of some pairs each: ``slice``, codes, documents and whether it is its A id's highest."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, docs, best = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            slice_ = codes % n
            for s in np.unique(slice_):
                at = np.flatnonzero(slice_ == s)
                for low in range(0, len(at), CHUNK_PAIRS):
                    k = at[low : low + CHUNK_PAIRS]
                    raw = (codes[k].astype("<i8"), docs[k].astype("<i8"), best[k].astype("<i8"))
                    yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in raw)], ["slice", "codes", "docs", "best"])

    return counts.select("code", "docs", "best").mapInArrow(pack, "slice int, codes binary, docs binary, best binary")


def _segments(table: DataFrame, n: int) -> DataFrame:
    """``table`` with a row for each slice that a document has pairs of (one without pairs for slice 0), and the ``slice``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n == 1:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.zeros(batch.num_rows, np.int32))], [*batch.schema.names, "slice"])
                continue
            rows, parts = [], []
            for k, (codes, times) in enumerate(zip(batch.column("codes").to_pylist(), batch.column("times").to_pylist())):
                codes, times = np.frombuffer(codes, "<i8"), np.frombuffer(times, "<u4")
                slice_ = codes % n
                for s in np.unique(slice_).tolist() or [0]:
                    rows.append(k)
                    parts.append((codes[slice_ == s].tobytes(), times[slice_ == s].tobytes(), s))
            kept = [batch.column(c).take(pa.array(rows)) for c in _NAMES]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(zip(*parts), (pa.binary(), pa.binary(), pa.int32())))], [*_NAMES, "codes", "times", "slice"])

    return bounded(table).mapInArrow(cut, f"{_FIGURES}, codes binary, times binary, slice int")


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counts and best links of every segment; a lane's chunks come before its segments."""
    lane, held, slice_ = None, [], ()
    for batch in batches:
        lanes, of = batch.column("lane").to_numpy(), batch.column("role").to_numpy()
        change = np.flatnonzero((np.diff(lanes, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0)).tolist()
        for low, high in zip(change, [*change[1:], len(lanes)]):
            part = batch.slice(low, high - low)
            if lanes[low] != lane:
                lane, held = lanes[low], []
            if of[low] == 0:
                held.append([_longs(part.column(c)) for c in ("codes", "docs", "best")])
                slice_ = ()
                continue
            if not slice_:
                whole = [np.concatenate(c) for c in zip(*held)] if held else [np.empty(0, np.int64)] * 3
                order = np.argsort(whole[0])
                slice_, held = tuple(x[order] for x in whole), []
            codes, times = _longs(part.column("codes")), _longs(part.column("times"), "<u4").astype(np.int64)
            sizes = np.array([len(c) // 8 for c in part.column("codes").to_pylist()])
            at, doc = np.searchsorted(slice_[0], codes), np.repeat(np.arange(len(sizes)), sizes)
            sums = [np.zeros(len(sizes), np.int64) for _ in range(2)]
            for total, x in zip(sums, (slice_[2], slice_[1])):
                np.add.at(total, doc, times * x[at])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _NAMES), *map(pa.array, sums)], [*_NAMES, "n_best", "count_sum"])


def link_counts(table: DataFrame) -> DataFrame:
    """The figures of an ``aligned`` table with ``n_best`` and ``count_sum`` of each document."""
    counts, parts = written(pair_counts(table)), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-counts.count() // SLICE_PAIRS))
    salts = max(1, -(-parts // n))
    id_a = F.shiftright("code", 32)
    best = counts.withColumn("best", (F.col("docs") == F.max("docs").over(W.partitionBy(id_a))).cast("long"))  # an A id has no more pairs than B has ids
    none = F.lit(None)
    figures = [none.cast(t).alias(c) for c, t in (x.split() for x in _FIGURES.split(", "))]
    chunks = written(_chunks(best, n)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lane = (F.col("slice") * salts + F.col("salt")).cast("int").alias("lane")
    given = chunks.select(lane, F.lit(0).alias("role"), *figures, "codes", none.cast("binary").alias("times"), "docs", "best")
    asked = _segments(table, n).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    asked = asked.select(lane, F.lit(1).alias("role"), *_NAMES, "codes", "times", none.cast("binary").alias("docs"), none.cast("binary").alias("best"))
    work = given.unionAll(asked).repartitionById(n * salts, "lane").sortWithinPartitions("lane", "role")
    sums = bounded(work).mapInArrow(_look_up, f"{_FIGURES}, n_best bigint, count_sum bigint")
    return sums.groupBy(*_NAMES).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per document: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``."""
    out = link_counts(aligned(docs, id_col, text_col, a_path, b_path))
    return out.select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

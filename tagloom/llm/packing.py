"""Mixture-controlled packing of token ids into fixed windows by deficit round-robin.

Every source has a queue. For each window a queue's deficit grows by its share of the window; queues
are served by their deficit, cut freely, and a queue that runs short keeps its deficit for later
windows while others fill its room, so windows are full.

1. Texts are encoded once where they are read; ids are written, in the width the vocabulary needs.
2. Each task's ids of a source are one stream, cut into cards of ``CARD`` ids, and cards are dealt to the
   parts one after another from a part drawn by hash. So a part holds all sources in their proportions
   even if the table is laid out by source, or one source or document is very long.
3. A part uses up all its tokens, so the deficits it ends with follow from token counts by part and
   source; their prefix sums are the deficits with which each part starts. They reach it as rows of its
   own, sorted before its documents, one for each source the part holds.
4. Each part is packed in one pass. What is left at its end is cut into sequences whose lengths are
   powers of two, which need no padding.

A task holds at most about ``buffer`` tokens besides its Arrow batch, and a queue or a running length for
each source that it meets.

Defined results: a null or empty text is the end id alone; null ids and sources stay as they are (a
null source has its own queue); repeated rows are packed each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from tagloom.llm.common import bounded, prefix_sums, written
from tagloom.llm.encoding import Encoder, arrow_bytes

#: Tokens of a part, least and most; between them there are as many parts as the session has shuffle partitions.
PART_TOKENS = (1 << 23, 1 << 27)
#: Ids of a source that are dealt to a part together.
CARD = 2048


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, whose table of parts outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column: ``values`` cut at ``ends`` (the first is 0)."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype("<i4")), pa.py_buffer(values)])


def tokenized(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str, end_id: int) -> DataFrame:
    """A table of stretches of documents' ids, each on one card: ``id``, ``source``, ``start`` in the document, ``n``,
    ``ids`` (2 bytes each, or 4 for a large vocabulary; the last is followed by the end id), ``doc_tokens``, and ``at``,
    its place in the stream of ``source`` in ``task``."""
    source = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType
    kind, width = to_arrow_type(id_type), id_width(path, end_id)
    names = ["id", "source", "start", "n", "ids", "doc_tokens", "task", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, lengths = encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, ends = known.flat(*arrow_bytes(batch.column(2)))
            with_end = np.full(len(ids) + batch.num_rows, end_id, f"<u{width}")
            with_end[np.arange(len(ids)) + np.repeat(np.arange(batch.num_rows), np.diff(ends))] = ids
            ends = ends + np.arange(len(ends))
            n = np.diff(ends)
            at = _streams(batch.column(1), n, lengths)
            cards = (at + n - 1) // CARD - at // CARD + 1
            doc = np.repeat(np.arange(len(n)), cards)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(cards) - cards, cards)
            start = np.maximum(0, (at[doc] // CARD + k) * CARD - at[doc])
            cuts = np.append(ends[doc] + start, ends[-1])
            columns = [batch.column(0).cast(kind).take(pa.array(doc)), batch.column(1).cast(pa.string()).take(pa.array(doc)), pa.array(start), pa.array(np.diff(cuts))]
            columns += [_binary(with_end, cuts), pa.array(n[doc]), pa.array(np.full(len(doc), task, np.int32)), pa.array(at[doc] + start)]
            yield pa.RecordBatch.from_arrays(columns, names)

    types = f"id {id_type.simpleString()}, source string, start bigint, n bigint, ids binary, doc_tokens bigint, task int, at bigint"
    return written(bounded(source).mapInArrow(run, types))


def _streams(sources: pa.Array, n: np.ndarray, lengths: dict) -> np.ndarray:
    """Where each row's ``n`` ids begin in the stream of its source; ``lengths``: of the streams so far, brought up to date."""
    coded = pc.dictionary_encode(sources, null_encoding="encode")
    codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    order = np.argsort(codes, kind="stable")
    before = np.cumsum(n[order]) - n[order]
    first = np.searchsorted(codes[order], np.arange(len(names)))
    so_far = np.array([lengths.get(name, 0) for name in names], np.int64)
    at = np.empty(len(n), np.int64)
    at[order] = before - before[first][codes[order]] + so_far[codes[order]]
    sums = np.zeros(len(names), np.int64)
    np.add.at(sums, codes, n)
    lengths.update(zip(names, (so_far + sums).tolist()))
    return at


def id_width(path: str, end_id: int) -> int:
    return 2 if max(encoder(path).top, end_id) < 1 << 16 else 4


class Packer:
    """Queues of one part, numbered in the order of ``shares``; ``deficits`` are in tokens."""

    def __init__(self, length: int, shares: list[float], deficits: list[float], first: int = 0):
        self.length, self.sequence = length, first
        self.shares, self.deficits = np.array(shares, float), np.array(deficits, float)
        self.waiting = np.zeros(len(shares), np.int64)
        self.queues: list[deque] = [deque() for _ in shares]
        self.total = 0

    def add(self, queue: int, row, ids: np.ndarray, start: int = 0) -> None:
        """``row``: what is returned with each piece; ``start``: ids of the document before these."""
        self.queues[queue].append([row, ids, start, 0])
        self.waiting[queue] += len(ids)
        self.total += len(ids)

    def _take(self, queue: int, n: int, offset: int, out: list) -> None:
        """The next ``n`` ids of a queue, as pieces at ``offset`` of the present sequence."""
        line = self.queues[queue]
        self.waiting[queue] -= n
        self.total -= n
        self.deficits[queue] -= n
        while n:
            row, ids, start, done = head = line[0]
            k = min(n, len(ids) - done)
            out.append((row, start + done, k, ids[done : done + k], self.sequence, offset))
            offset, n = offset + k, n - k
            head[3] += k
            if head[3] == len(ids):
                line.popleft()

    def window(self, size: int) -> list:
        """One full sequence of ``size`` ids; at least so many must wait."""
        self.deficits += self.shares * size
        owed = np.minimum(np.maximum(np.rint(self.deficits), 0), self.waiting).astype(np.int64)
        served = np.flatnonzero(owed)
        out: list = []
        room = size
        for queue in served[np.lexsort((served, -self.deficits[served]))].tolist():  # what is owed to each
            if n := min(room, int(owed[queue])):
                self._take(queue, n, size - room, out)
                room -= n
        while room:  # queues that ran short, or rounding: the others fill the room
            open_ = np.flatnonzero(self.waiting)
            queue = int(open_[np.argmax(self.deficits[open_])])
            n = min(room, int(self.waiting[queue]))
            self._take(queue, n, size - room, out)
            room -= n
        self.sequence += 1
        return out

    def full(self, keep: int) -> Iterator[list]:
        while self.total >= max(keep, self.length):
            yield self.window(self.length)

    def rest(self) -> Iterator[list]:
        yield from self.full(self.length)
        while self.total:
            yield self.window(1 << (self.total.bit_length() - 1))


def _key(source: Column) -> Column:
    """Never null, and distinct for null and every name."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def starts(tokens: DataFrame, total: int, weights: dict[str | None, float] | None) -> DataFrame:
    """For each part and source it holds: the source's share of every window, and its deficit at the part's start.

    ``tokens`` has ``part``, ``source`` and ``n``, in all ``total``. The windows over sources have at most a row for each part.
    """
    counts = written(tokens.groupBy("part", _key(F.col("source")).alias("key")).agg(F.any_value("source").alias("source"), F.sum("n").alias("n")))
    parts = prefix_sums(counts.groupBy("part").agg(F.sum("n").alias("n")), "part", "n", "before")
    if weights:
        names = {("n" if s is None else f"s{s}"): float(w) / sum(weights.values()) for s, w in weights.items()}
        given = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        shares = counts.select("key").distinct().withColumn("share", F.coalesce(given[F.col("key")], F.lit(0.0)))
    else:
        shares = counts.groupBy("key").agg((F.sum("n") / F.lit(float(max(1, total)))).alias("share"))
    taken = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at_start = counts.withColumn("taken", taken).join(parts.select("part", "before"), "part").join(shares, "key")
    return at_start.select("part", "source", "share", (F.col("share") * F.col("before") - F.col("taken")).alias("deficit"))


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: int = 4096,
    tokenizer: str | None = None, end_id: int = 2, weights: dict[str | None, float] | None = None, buffer: int = 1 << 21,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    ``weights``: target proportions by source; without them each source's share of all tokens.
    """
    path = tokenizer or default_tokenizer()
    tokens = tokenized(docs, id_col, text_col, source_col, path, end_id)
    total = tokens.agg(F.sum("n")).first()[0] or 0
    least, most = (-(-total // n) for n in reversed(PART_TOKENS))
    parts = max(1, least, min(most, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    card = F.floor(F.col("at") / CARD)
    first = F.pmod(F.xxhash64("task", "source"), F.lit(parts))
    tokens = tokens.withColumn("part", F.pmod(first + card, F.lit(parts)).cast("int")).withColumn("card", F.xxhash64("task", "source", card))
    columns = ["part", "card", "at", "source", "share", "deficit", "id", "ids", "start", "doc_tokens"]
    none = lambda c: F.lit(None).cast(tokens.schema[c].dataType).alias(c)
    rows = starts(tokens, total, weights).select("part", none("card"), none("at"), "source", "share", "deficit", none("id"), none("ids"), none("start"), none("doc_tokens"))
    rows = rows.unionByName(tokens.select(*(F.lit(None).cast("double").alias(c) if c in ("share", "deficit") else F.col(c) for c in columns)))
    # a part's own rows come first, by source, then its cards in an order drawn by hash
    dealt = rows.repartitionById(parts, "part").sortWithinPartitions("part", F.col("card").asc_nulls_first(), F.col("source").asc_nulls_first(), "at")
    id_type = tokens.schema["id"].dataType
    kind, width = to_arrow_type(id_type), id_width(path, end_id)
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def batch(windows: list) -> pa.RecordBatch:
        rows, start, n, raw, sequence, offset = zip(*(piece for w in windows for piece in w))
        ids, of = zip(*rows)
        every = np.concatenate(raw).astype("<u4")
        columns = [pa.array(ids, kind), pa.array(start, pa.int64()), pa.array(n, pa.int64()), _binary(every, np.concatenate([[0], np.cumsum(n)])), *(pa.array(c, pa.int64()) for c in (of, sequence, offset))]
        return pa.RecordBatch.from_arrays(columns, names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        packer, part, queue_of, shares, deficits = Packer(length, [], []), None, {}, [], []
        for got in batches:
            for p, card, _, source, share, deficit, doc, ids, start, of in zip(*(c.to_pylist() for c in got.columns)):
                if p != part:
                    yield from packer.rest()
                    packer, part, queue_of, shares, deficits = Packer(length, [], []), p, {}, [], []
                if card is None:
                    queue_of[source] = len(shares)
                    shares.append(share)
                    deficits.append(deficit)
                    continue
                if len(packer.queues) != len(shares):
                    packer = Packer(length, shares, deficits, p << 33)
                packer.add(queue_of[source], (doc, of), np.frombuffer(ids, f"<u{width}"), start)
                if packer.total > buffer:
                    yield from packer.full(buffer // 2)
        yield from packer.rest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for window in windows(batches):
            held.append(window)
            if len(held) >= 64:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    types = f"id {id_type.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return bounded(dealt).mapInArrow(run, types).withColumnRenamed("id", id_col)


def digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query: ids as their CRC-32."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

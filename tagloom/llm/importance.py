"""Target-distribution importance resampling: array-scored weights, ranks by parallel sorting by regular sampling.

Features of a text are its runs of 1 to ``longest`` consecutive words, hashed to ``BUCKETS`` buckets. Each task counts
them in one array, and the sums of all tasks, for the documents and for the target, give the gain of every bucket: an
array of fixed size that is sent to the tasks, where a document's weight is the sum of its features' gains. With
Gumbel noise from a hash of seed and id, the highest scores are a sample without replacement that
follows the target.

The ranks of that sample come from parallel sorting by regular sampling:

1. The scored rows are sorted within each task: a run, whose rows know their place in it.
2. Every run gives its rows at regular places, at most about ``lanes`` of them; these few (at most
   ``lanes * lanes`` and one a run) are sorted and give the splitters of ``lanes`` ranges of about equal size.
3. Rows are counted by range. Prefix sums of these counts tell which ranges hold the draw, and
   only these are exchanged; each is sorted where it arrives.
4. A row's rank is its place in its range plus the rows of earlier ranges.

Rows are ordered by score from the highest, then id, null ids last, then run and place, so no two are equal and ranges
are even however many rows share a score.

Defined results: a null or empty text has no features and weight 0; a null id is hashed as the seed and a colon
alone; repeated rows are rows of their own and count, weigh and rank each; an empty table gives an empty
result, and an empty target gains from the smoothing alone; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bounded, slices, written

BUCKETS = 10_000
LONGEST, SEED, MIN_WORDS, PERCENT = 1, 2024, 20, 10
#: Most runs' samples and ranges; what the driver sorts follows its square.
LANES = 512
#: Bytes of a text that are split into words at once, and words whose buckets a task remembers.
PIECE, REMEMBERED, REMEMBERED_BYTES = 1 << 20, 1 << 18, 64
#: Bytes of words are digits, letters (lower-cased) and all beyond ASCII; the others become spaces.
_CLEAN = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


class _Buckets(dict):
    """Bucket of each feature, short ones remembered."""

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % BUCKETS
        if len(feature) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[feature] = bucket
        return bucket

    def of(self, some: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, some), np.int64, len(some))


def features(text: bytes, longest: int = LONGEST) -> Iterator[tuple[int, list[bytes]]]:
    """Features of a UTF-8 text, some at a time, with their words: all single words, then all runs of two, and so on."""
    clean = text.translate(_CLEAN)
    for n in range(1, longest + 1):
        tail: list[bytes] = []
        at = 0
        while at < len(clean):
            end = clean.find(b" ", at + PIECE)
            end = end if end >= 0 else len(clean)
            words = tail + clean[at:end].split()
            yield n, words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
            tail, at = words[max(0, len(words) - n + 1) :] if n > 1 else [], end


def weigh(text: bytes, gain: np.ndarray, known: _Buckets, longest: int = LONGEST) -> tuple[int, int, int]:
    """Words, features and the sum of the features' gains of a text."""
    words = total = weight = 0
    for n, some in features(text, longest):
        words += len(some) if n == 1 else 0
        total += len(some)
        weight += int(gain[known.of(some)].sum())
    return words, total, weight


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST) -> np.ndarray:
    """How often each bucket has a feature in all texts: an array of ``BUCKETS`` numbers, summed by tasks and then by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(), np.zeros(BUCKETS, np.int64)
        for (some,) in slices(batches):
            for text in some:
                for _, part in features(text or b"", longest):
                    total += np.bincount(known.of(part), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    source = texts.select(F.col(text_col).cast("binary").alias("text"))
    sums = bounded(source).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in target and source, rounded down."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def noise(id_: int | None, seed: int) -> int:
    """Thousandths of a Gumbel variable, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
    return int(np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))))


def score(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for ids, texts in slices(batches):
            rows = []
            for id_, text in zip(ids, texts):
                words, total, weight = weigh(text or b"", gain, known, longest)
                rows.append((id_, words, total, weight, weight + noise(id_, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "n_words", "n_features", "weight", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return bounded(source).mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def _keys(rows: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    """What rows are ordered by, the most important last."""
    ids = rows["doc_id"]
    return [rows["at"].to_numpy(), rows["run"].to_numpy(), ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()).astype(np.int8), -rows["score"].to_numpy()]


def _sorted() -> list[Column]:
    """The same order, within a task."""
    return [F.desc("score"), F.asc_nulls_last("doc_id")]


def _longs(*columns: str) -> str:
    return ", ".join(f"{c} bigint" for c in columns)


def _runs(scored: DataFrame) -> DataFrame:
    """``scored`` sorted within tasks, those ``chosen`` first, with the ``run`` and the place in it, ``at``, of every row."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(places), run)), pa.array(places)], [*batch.schema.names, "run", "at"])

    return scored.sortWithinPartitions(F.desc("chosen"), *_sorted()).mapInArrow(place, _longs(*scored.columns, "run", "at"))


def _sample(chosen: DataFrame, total: int, lanes: int) -> pa.Table:
    """The keys of rows at regular places of each run, about ``lanes`` a run and at most about ``lanes * lanes`` in all."""
    runs = chosen.agg(F.count_distinct("run")).first()[0]
    stride = max(1, total // (lanes * max(1, min(runs, lanes))))
    regular = F.pmod(F.col("at") - F.xxhash64("run"), F.lit(stride)) == 0  # a run shorter than the stride is as likely to give one
    return chosen.where(regular).select("score", "doc_id", "run", "at").toArrow()


def _ranges(runs: DataFrame, splitters: pa.Table) -> DataFrame:
    """``runs`` with the ``range`` of each row: how many splitters are not after it."""
    keys, n = _keys(splitters), splitters.num_rows

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.lexsort([np.concatenate(pair) for pair in zip(keys, _keys(batch))])
            range_ = np.empty(len(order), np.int64)
            range_[order] = np.cumsum(order < n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range_[n:])], [*batch.schema.names, "range"])

    return runs.mapInArrow(deal, _longs(*runs.columns, "range"))


def _ranked(ranges: DataFrame, first: list[int], draw: int) -> DataFrame:
    """The rows of ``ranges``, exchanged and sorted by range, with their ``rank`` where it is within ``draw``; ``first``: rows of earlier ranges."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = -1, 0
        for batch in batches:
            ranks = []
            for r in batch.column("range").to_pylist():
                now, at = r, at + 1 if r == now else first[r] + 1
                ranks.append(at if at <= draw else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int64())], [*batch.schema.names, "rank"])

    dealt = ranges.repartitionById(len(first), F.col("range").cast("int")).sortWithinPartitions("range", *_sorted(), "run", "at")
    return dealt.mapInArrow(number, _longs(*ranges.columns, "rank"))


def draw_ranked(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """``scored`` (long columns, ``score`` and ``doc_id`` among them) with ``rank``: 1, 2, 3... for the ``floor(percent * N / 100)``
    first of the N rows that are ``eligible``, else null."""
    names, spark = scored.columns, scored.sparkSession
    runs = written(_runs(scored.withColumn("chosen", F.coalesce(eligible, F.lit(False)).cast("long"))))
    chosen, rest = runs.where("chosen = 1"), runs.where("chosen = 0")
    total = chosen.count()
    draw = total * percent // 100
    lanes = max(1, min(LANES, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sample = _sample(chosen, total, lanes)
    in_order = np.lexsort(_keys(sample))
    cuts = np.unique(np.arange(1, lanes) * len(in_order) // lanes) if len(in_order) else []
    ranges = _ranges(chosen, sample.take(pa.array(in_order[cuts])))
    sizes = dict(ranges.groupBy("range").count().collect())  # a row for each range
    first = np.cumsum([0, *(sizes.get(r, 0) for r in range(len(cuts)))]).tolist()
    needed = max(1, sum(before < draw for before in first))  # ranges that the draw reaches
    none = F.lit(None).cast("long").alias("rank")
    beyond = ranges.where(F.col("range") >= needed)
    return _ranked(ranges.where(F.col("range") < needed), first[:needed], draw).select(*names, "rank").unionAll(beyond.select(*names, none)).unionAll(rest.select(*names, none))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = LONGEST, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: its id, ``n_features``, ``weight``, ``score`` and ``rank``, null unless it is drawn."""
    gain = gains(bucket_counts(docs, text_col, longest), bucket_counts(target, target_col, longest))
    ranked = draw_ranked(score(docs, gain, id_col, text_col, longest, seed), F.col("n_words") >= min_words, percent)
    return ranked.select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank")


#: Bytes of a word as numbers, and the table of CRC-32 by its polynomial, are made in SQL.
ORACLE = r"""
with recursive crc as (
  select i as b, i::bigint as c, 0 as k from range(256) t(i)
  union all
  select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc where k < 8
), tab as (select list(c order by b) as t from crc where k = 8
), texts as (
  select doc_id, false as target, text from documents union all select null, true, text from benchmark
), w as (
  select doc_id, target, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words
  from texts
), every as (select doc_id, target, unnest(words) as word from w
), buckets as (
  select word, xor(list_reduce(list_transform(range(len(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint),
    lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]), 4294967295::bigint), 4294967295) % 10000 as bucket
  from (select distinct word from every), tab
), f as (select doc_id, target, bucket from every join buckets using (word)
), sums as (select bucket, count(*) filter (not target) as s, count(*) filter (target) as t from f group by bucket
), whole as (select coalesce(sum(s), 0) as s, coalesce(sum(t), 0) as t from sums
), gain as (
  select bucket, cast(floor(1000 * ln(((sums.t + 1)::double * (whole.s + 10000)::double) / ((sums.s + 1)::double * (whole.t + 10000)::double))) as bigint) as gain
  from sums, whole
), weights as (select doc_id, sum(gain) as weight from f join gain using (bucket) where not target group by doc_id
), scored as (
  select d.doc_id, len(d.words) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
    cast(coalesce(weight, 0) as bigint) + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296))) as bigint) as score
  from w d left join weights using (doc_id) where not d.target
), r as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= 20
)
select scored.doc_id, cast(n_features as bigint) as n_features, weight, score, cast(case when place <= n * 10 // 100 then place end as bigint) as rank
from scored left join r using (doc_id)
"""

"""Language-model scores by deleted interpolation.

The probability of a token after the one before it mixes three estimates: maximum likelihood of the
bigram, maximum likelihood of the token, and a uniform share. The mixture weights depend on the bucket
of the context's frequency (powers of two) and are learned by expectation-maximisation on held-out
tokens: those of an eighth of the training texts, each with its own text's counts deleted.

Counts cover all training texts and stay distributed. Tasks read texts in blocks of about ``BLOCK``
tokens and ask for the counts of a block's distinct tokens and bigrams; requests are packed arrays of
sorted 64-bit hashes, one row for each block and hash range (``bucket``), which also carry the block's
own training counts. Each bucket sums them and answers all its blocks with packed counts. The blocks
are made a second time from the same scan and joined to their answers. So shuffles carry a few bytes
for each distinct token or bigram of a block, and no key, however frequent, has more than one entry per block.

A frequent token is in every block, so with many blocks a bucket is answered in two levels: blocks are dealt to
sections of bounded number, a section's requests to a bucket are summed to one row of keys and counts, these rows
are summed over sections by ranges of keys (``PARTS`` of a bucket), and each section answers its own blocks. So no group holds
more than a section's requests to a bucket, or a range's entries of all sections. Buckets are at most as many as leave
a block some keys for each.

The hashes of tokens have 64 bits; those of bigrams are cut to the bits that tell a bucket's bigrams
apart with a collision chance of about one in a million, 64 at most. Weights are learned from held-out tokens counted by cells, in
which estimates are rounded to a quarter in log2 (``STEP``), so that what the driver learns from has a fixed size.

Defined results: a null or empty text is one end token; a null id is hashed as an empty text;
repeated rows are counted and scored each; without training texts all counts are 0; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm.common import bounded, slices, written

BLOCK = 1 << 20
#: Bytes of text per bucket of keys.
BUCKET_BYTES = 8 << 20
#: Most buckets; blocks of a section for each bucket; ranges of a bucket's keys that sections are summed by.
MOST_BUCKETS, SECTION_BLOCKS, PARTS = 1 << 15, 8, 32
#: Buckets of context frequency: 0, 1, 2-3, 4-7, ...
LEVELS = 20
_END = b" "  # no word has a space
_BITS = 40

TRAIN, TUNE, HELD = 0, 1, 2


def role_of(id_col: Column) -> Column:
    """2 for the texts kept out of training, 1 for the ones that tune weights, else 0."""
    crc = F.crc32(F.coalesce(id_col.cast("string"), F.lit("")))
    return F.when(crc % 7 == 2, HELD).when(F.floor(crc / 7) % 8 == 0, TUNE).otherwise(TRAIN).cast("int")


def _mix(a: np.ndarray, b: np.ndarray, nbytes: int) -> np.ndarray:
    """Keys of bigrams from the hashes of their tokens."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x & ~np.uint64((1 << (64 - 8 * nbytes)) - 1)


def _planes(keys: np.ndarray, nbytes: int) -> bytes:
    """The upper bytes of sorted keys, plane by plane: the first ones compress to little."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :nbytes].T.tobytes()


def _keys(raw: bytes, nbytes: int) -> np.ndarray:
    out = np.zeros((len(raw) // nbytes, 8), np.uint8)
    out[:, :nbytes] = np.frombuffer(raw, np.uint8).reshape(nbytes, -1).T
    return out.view(">u8").ravel().astype(np.uint64)


def _counts(values: np.ndarray) -> bytes:
    """Numbers in 4 bytes each, or 8 where they need it; the first byte says which."""
    width = 4 if not len(values) or values.max() < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


@dataclass
class Block:
    """Tokens of some texts as numbers of the sorted token hashes ``unigrams``."""

    number: int
    ids: list
    roles: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray
    unigrams: np.ndarray

    @classmethod
    def of(cls, number: int, ids: list, roles: list[int], words: list[list[bytes]]) -> Block:
        every = [w for text in words for w in text]
        place = {w: i for i, w in enumerate(dict.fromkeys(every))}
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, place), np.uint64, len(place))
        unigrams, where = np.unique(hashes, return_inverse=True)
        tokens = where[np.fromiter(map(place.__getitem__, every), np.int64, len(every))]
        return cls(number, ids, np.array(roles, np.int8), np.array([len(w) for w in words], np.int64), tokens.astype(np.uint32), unigrams)

    def bigrams(self, nbytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys, the key's number for each token with what is before it, and each token's context.
        What is before a text's first token is the end token, which is as frequent as texts."""
        first = np.zeros(len(self.tokens), bool)
        starts = np.cumsum(self.lengths) - self.lengths
        first[starts] = True
        before = np.roll(self.tokens, 1)
        before[first] = self.tokens[starts + self.lengths - 1]
        keys, where = np.unique(_mix(self.unigrams[before], self.unigrams[self.tokens], nbytes), return_inverse=True)
        return keys, where, before


def _blocks(batches: Iterator[pa.RecordBatch], wanted: tuple[int, ...], most: int) -> Iterator[Block]:
    """Blocks of a partition's texts with a role in ``wanted``, of ``most`` tokens or a little more; tuning texts have their own blocks, so
    the numbers do not depend on which are wanted."""
    held: dict[bool, list] = {True: [[], [], [], 0, 0], False: [[], [], [], 0, 0]}
    first = TaskContext.get().partitionId() << 24

    def flush(tune: bool) -> Iterator[Block]:
        ids, roles, words, _, count = held[tune]
        if ids:
            yield Block.of(first | count << 1 | tune, ids, roles, words)
        held[tune] = [[], [], [], 0, count + 1]

    for ids, texts, roles in slices(batches):
        for id_, text, role in zip(ids, texts, roles):
            if role not in wanted:
                continue
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            words.append(_END)
            mine = held[role == TUNE]
            mine[0].append(id_)
            mine[1].append(role)
            mine[2].append(words)
            mine[3] += len(words)
            if mine[3] >= most:
                yield from flush(role == TUNE)
    yield from flush(True)
    yield from flush(False)


_REQUEST = "kind int, bucket bigint, block bigint, keys binary, counts binary"
_ANSWER = "block bigint, kind int, bucket bigint, counts binary, types bigint, total bigint"


def _requests(source: DataFrame, buckets: int, nbytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, (TRAIN, TUNE, HELD), BLOCK):
            train = np.repeat(block.roles != HELD, block.lengths)
            pairs, where, _ = block.bigrams(nbytes)
            rows = []
            for kind, keys, at, width in ((0, block.unigrams, block.tokens, 8), (1, pairs, where, nbytes)):
                counts = np.bincount(at[train], minlength=len(keys))
                bucket = _bucket(keys, buckets)
                cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 63))), len(keys))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    rows.append((kind, int(bucket[a]), block.number, _planes(keys[a:b], width), _counts(counts[a:b])))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["kind", "bucket", "block", "keys", "counts"])

    return bounded(source).mapInArrow(run, _REQUEST)


def _answers(requests: DataFrame, nbytes: int) -> DataFrame:
    """For each request the counts of its keys over all blocks; a row of block -1 has a bucket's token types and total."""

    def run(group: pa.Table) -> pa.Table:
        kind, bucket = group["kind"][0].as_py(), group["bucket"][0].as_py()
        width = nbytes if kind else 8
        keys = [_keys(k, width) for k in group["keys"].to_pylist()]
        counts = [_numbers(c) for c in group["counts"].to_pylist()]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts), len(every)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        out = [_counts(x) for x in np.split(total[where], ends[:-1])]
        blocks = group["block"].to_pylist()
        n = len(blocks)
        if kind == 0:
            blocks, out = [*blocks, -1], [*out, b""]
        known = int((total > 0).sum()) if kind == 0 else 0
        pad = [0] * (len(blocks) - 1)
        columns = [blocks, [kind] * len(blocks), [bucket] * len(blocks), out, [*pad, known], [*pad, int(total.sum())]]
        if kind:
            columns[5] = [0] * n
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _ANSWER.split(", ")])

    return requests.groupBy("kind", "bucket").applyInArrow(run, _ANSWER)


def _packed(keys: np.ndarray, counts: np.ndarray, width: int) -> tuple[bytes, bytes]:
    return _planes(keys, width), _counts(counts)


def _answers_by_section(requests: DataFrame, buckets: int, nbytes: int, sections: int) -> DataFrame:
    """As ``_answers``, in two levels."""
    requests = requests.withColumn("section", F.pmod(F.xxhash64("block"), F.lit(sections)))
    by = ["kind", "bucket", "section"]

    def summed(group: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Bytes of a key, the group's distinct keys, their counts, and of each entry of its rows the key's number; rows' ends."""
        width = nbytes if group["kind"][0].as_py() else 8
        keys, counts = [_keys(k, width) for k in group["keys"].to_pylist()], [_numbers(c) for c in group["counts"].to_pylist()]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        return width, every, np.bincount(where, np.concatenate(counts), len(every)).astype(np.int64), where, np.cumsum([len(k) for k in keys])

    def of_section(group: pa.Table) -> pa.Table:
        width, every, total, _, _ = summed(group)
        part = (_bucket(every, buckets * PARTS) % np.uint64(PARTS)).astype(np.int64)  # ranges of a bucket, in order
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(every)).tolist()
        rows = [(int(part[a]), *_packed(every[a:b], total[a:b], width)) for a, b in zip(cuts[:-1], cuts[1:])]
        same = group.select(by).slice(0, 1).take(pa.array([0] * len(rows)))
        return pa.table([*same.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary())))], [*by, "part", "keys", "counts"])

    def of_part(group: pa.Table) -> pa.Table:
        _, _, total, where, ends = summed(group)
        whole = [_counts(x) for x in np.split(total[where], ends[:-1])]
        first = group["kind"][0].as_py() == 0
        more = [int((total > 0).sum()), int(total.sum())] if first else [0, 0]  # told once a part
        rest = [0] * (len(whole) - 1)
        return pa.table([*group.select([*by, "part"]).columns, pa.array(whole, pa.binary()), pa.array([more[0], *rest]), pa.array([more[1], *rest])], [*by, "part", "counts", "types", "total"])

    def answer(asked: pa.Table, sums: pa.Table) -> pa.Table:
        _, every, _, where, ends = summed(asked)
        order = np.argsort(sums["part"].to_numpy())
        total = np.concatenate([_numbers(c) for c in sums["counts"].take(pa.array(order)).to_pylist()])
        if len(total) != len(every):
            raise RuntimeError("a block differs between two scans of the same input")
        out, n = [_counts(x) for x in np.split(total[where], ends[:-1])], asked.num_rows
        return pa.table([asked["block"], asked["kind"], asked["bucket"], pa.array(out, pa.binary()), pa.array([0] * n), pa.array([0] * n)], [c.split()[0] for c in _ANSWER.split(", ")])

    kinds = "kind int, bucket bigint, section bigint, part bigint"
    partial = requests.groupBy(*by).applyInArrow(of_section, f"{kinds}, keys binary, counts binary")
    sums = written(partial.groupBy("kind", "bucket", "part").applyInArrow(of_part, f"{kinds}, counts binary, types bigint, total bigint"))
    replies = requests.groupBy(*by).cogroup(sums.select(*by, "part", "counts").groupBy(*by)).applyInArrow(answer, _ANSWER)
    told = sums.where("types > 0 or total > 0").select(F.lit(-1).cast("long"), "kind", "bucket", F.lit(None).cast("binary"), "types", "total")
    return replies.unionAll(told)


def _payload(source: DataFrame, wanted: tuple[int, ...]) -> DataFrame:
    """Blocks as rows: ids apart from the numbers, which are packed."""
    id_type = source.schema["id"].dataType
    kind = pa.list_(to_arrow_type(id_type))
    names = ["block", "ids", "roles", "lengths", "tokens", "unigrams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, wanted, BLOCK):
            low = b.tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            row = (b.number, b.ids, b.roles.tobytes(), b.lengths.astype("<i8").tobytes(), low, _planes(b.unigrams, 8))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [pa.int64(), kind, *[pa.binary()] * 4])], names)

    return bounded(source).mapInArrow(run, f"block bigint, ids array<{id_type.simpleString()}>, roles binary, lengths binary, tokens binary, unigrams binary")


def _restored(left: pa.Table, right: pa.Table, nbytes: int):
    """A block with, for each token, the counts of itself, of its context and of both, and their numbers."""
    r = left.slice(0, 1).to_pylist()[0]
    tokens = np.ascontiguousarray(np.frombuffer(r["tokens"], np.uint8).reshape(4, -1).T).view("<u4").ravel()
    block = Block(r["block"], r["ids"], np.frombuffer(r["roles"], np.int8), np.frombuffer(r["lengths"], "<i8"), tokens, _keys(r["unigrams"], 8))
    pairs, where, before = block.bigrams(nbytes)
    counts: dict[int, list] = {0: [], 1: []}
    for kind, _, raw in sorted(zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), right["counts"].to_pylist()), key=lambda x: x[:2]):
        counts[kind].append(_numbers(raw))
    have = []
    for kind, n in ((0, len(block.unigrams)), (1, len(pairs))):
        whole = np.concatenate(counts[kind]) if counts[kind] else np.empty(0, np.int64)
        if len(whole) != n:
            raise RuntimeError("a block differs between two scans of the same input")
        have.append(whole)
    return block, have[0][tokens], have[0][before], have[1][where], where, before


def level(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency."""
    return np.where(context > 0, np.minimum(np.floor(np.log2(np.maximum(context, 1))) + 1, LEVELS - 1), 0).astype(np.int64)


def _own(block: Block, numbers: np.ndarray) -> np.ndarray:
    """How often each token's entry occurs in its own text."""
    text = np.repeat(np.arange(len(block.lengths)), block.lengths)
    code = text.astype(np.int64) << 32 | numbers.astype(np.int64)
    _, where, n = np.unique(code, return_inverse=True, return_counts=True)
    return n[where]


#: Cells of held-out tokens: steps of log2 of the estimates, for each of the two.
STEP, LOWEST = 0.25, -160


def _cells(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.maximum(np.round(np.log2(p) / STEP), LOWEST + 1), LOWEST).astype(np.int64)


def learn_weights(cells: list[tuple[int, int, int, int]], uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, token, uniform) of each level from (level, bigram cell, token cell, count) by
    expectation-maximisation; a level without held-out tokens has those of the nearest lower one."""
    out = np.tile(np.array([0.3, 0.6, 0.1]), (LEVELS, 1))
    data = np.array(cells, np.int64).reshape(-1, 4)
    back = lambda c: np.where(c == LOWEST, 0.0, np.exp2(c * STEP))
    for k in range(LEVELS):
        rows = data[data[:, 0] == k]
        if not len(rows):
            out[k] = out[k - 1] if k else out[k]
            continue
        p = np.stack([back(rows[:, 1]), back(rows[:, 2]), np.full(len(rows), uniform)], 1)
        w, n = np.array([0.4, 0.4, 0.2]), rows[:, 3].astype(float)
        for _ in range(rounds):
            part = p * w
            part *= (n / part.sum(1))[:, None]
            w = np.maximum(part.sum(0) / n.sum(), 1e-7)
            w /= w.sum()
        out[k] = w
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    (add-one token model) and ``score`` (the interpolated model), both log10 probabilities.

    ``docs`` is scanned more than once and must deal its rows alike each time, as a file scan does;
    write other inputs to a table first. A difference is noticed and fails the job.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), role_of(F.col(id_col)).alias("role"))
    measured = source.select(F.octet_length("text").alias("n"), F.spark_partition_id().alias("part"))
    size, parts = measured.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0)) + 1).first()
    buckets = min(MOST_BUCKETS, max(8, size // BUCKET_BYTES))
    fuller = max(0, (size // (buckets * BUCKET_BYTES)).bit_length() - 1)  # doublings of a bucket's keys
    nbytes = min(8, -(-(int(buckets).bit_length() + _BITS + 2 * fuller) // 8))
    blocks = size // (2 * BLOCK) + 2 * parts  # at most: a token has two bytes at least
    sections = -(-blocks // max(1, int(SECTION_BLOCKS * buckets)))
    requests = _requests(source, buckets, nbytes)
    answers = written(_answers(requests, nbytes) if sections == 1 else _answers_by_section(requests, buckets, nbytes, sections))
    got = answers.where("block = -1").agg(F.sum("types"), F.sum("total")).first()
    types, total = int(got[0] or 0), int(got[1] or 0)
    uniform = 1.0 / (types + 1)
    replies = answers.where("block >= 0").select("block", "kind", "bucket", "counts")

    def tally(left: pa.Table, right: pa.Table) -> pa.Table:
        cells = np.empty((0, 4), np.int64)
        if left.num_rows:
            block, one, context, both, where, before = _restored(left, right, nbytes)
            text = np.repeat(np.arange(len(block.lengths)), block.lengths)
            size = block.lengths[text]
            context_own = _own(block, before)  # each word of a text is a context once, as its end token is for the first
            one, context, both = one - _own(block, block.tokens), context - context_own, both - _own(block, where)
            p2 = np.where(context > 0, both / np.maximum(context, 1), 0.0)
            p1 = one / np.maximum(total - size, 1)
            code = np.stack([level(context), _cells(p2), _cells(p1)], 1)
            kinds, n = np.unique(code, axis=0, return_counts=True)
            cells = np.column_stack([kinds, n])
        return pa.table([pa.array(cells[:, i]) for i in range(4)], ["level", "two", "one", "n"])

    tune = _payload(source, (TUNE,)).groupBy("block").cogroup(replies.where("block % 2 = 1").groupBy("block"))
    cells = tune.applyInArrow(tally, "level bigint, two bigint, one bigint, n bigint").groupBy("level", "two", "one").agg(F.sum("n").alias("n"))
    weights = learn_weights([tuple(r) for r in cells.collect()], uniform)  # cells of a fixed grid

    id_type = source.schema["id"].dataType
    kind = to_arrow_type(id_type)
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise RuntimeError("a block differs between two scans of the same input")
        block, one, context, both, _, _ = _restored(left, right, nbytes)
        at = np.cumsum(block.lengths) - block.lengths
        w = weights[level(context)]
        p = w[:, 0] * np.where(context > 0, both / np.maximum(context, 1), 0.0) + w[:, 1] * (one / max(total, 1)) + w[:, 2] * uniform
        base = np.log10((one + 1.0) / (total + types + 1.0))
        columns = [
            pa.array(block.ids, kind), pa.array(block.roles == HELD), pa.array(block.lengths), pa.array(np.add.reduceat((one > 0).astype(np.int64), at)),
            pa.array(np.full(len(at), total, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at)),
        ]
        return pa.table(columns, names)

    every = _payload(source, (TRAIN, TUNE, HELD)).groupBy("block").cogroup(replies.groupBy("block"))
    out = every.applyInArrow(score, f"id {id_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)

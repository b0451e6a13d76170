"""Near duplicates by fast similarity sketching, banding and exact verification.

A document is its set of word shingles, as 64-bit hashes. Its sketch has T coordinates. In each round
every shingle is thrown into one coordinate by a hash of shingle and round; a coordinate keeps the
smallest hash of the first round that reaches it. After T rounds the missing coordinates are filled
one by one from all shingles, so each is filled for any set, and since a round throws all shingles,
about T*log(T) throws suffice whatever the set's size. Two sets agree in a coordinate with the
probability of their Jaccard similarity, and agreements concentrate as for independent coordinates.

1. Equal sets are one class, with its smallest document.
2. Bands of R coordinates are hashed; classes sharing a band are joined to the band's smallest class
   (a star, not all pairs), and the components of these stars are the clusters to verify. Each batch joins its own
   first and sends one class a band, so bands are shuffled once and one that many share is a few rows.
3. Clusters are cut into blocks of bounded size, whose exact similarities link their members.
4. Clusters of several blocks: the linked groups of all blocks are tested against the cluster's
   largest ones. For what is still unconnected, pairs of different components of which one member is outside the
   largest are proposed, so the large component is not compared with itself. They come from shared bands, or, where
   these would give many, from an exact prefix filter if that gives fewer: in an order of shingles from the cluster's
   rarest on, two sets at the threshold share one of their first 15 %, at places that leave room for the rest. So
   neither text that a template gives to all members nor texts put together from the same parts propose
   most pairs. What is proposed is first held against sketches of one byte a coordinate; only pairs that agree in
   ``AGREE`` of them (a similarity of 0.74) are verified on their sets.
5. Components of all links give the result.

A pair at the threshold 0.85 misses all bands with probability (1-0.85^8)^48 = 2e-7, and agrees in fewer than
``AGREE`` coordinates, 6 deviations below what is expected, with 1e-9.

Defined results: a null or empty text (or one of white space) has an empty set, is linked with nothing
and kept; a null id is never a component's id unless all its members' are null; repeated rows are
copies; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window as W

from tagloom.llm.common import bounded, fresh, numbered, released, slices, written
from tagloom.llm.components import components

BANDS, ROWS = 48, 8
T = BANDS * ROWS
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 85
WIDTH = 5
#: Members and shingles of a block.
BLOCK_MEMBERS, BLOCK_SHINGLES = 384, 1 << 21
#: Shingles of small clusters that are verified in one call.
UNIT_SHINGLES = 1 << 18
#: Largest groups of a cluster against which all its groups are tested.
PIVOTS = 8
#: Coordinates in which sketches of one byte each agree at least; pairs a shingle that bands may give before the prefix filter, which
#: writes and sorts shingles, is tried.
AGREE, BAND_PAIRS = 284, 2
#: Bits of the filter that tells which documents' sets are needed; a fixed size, so it can be sent to tasks.
FILTER_BITS = 1 << 26

_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)
_BAND_ODD = np.random.default_rng(5).integers(1, 1 << 63, ROWS, dtype=_U) * _U(2) + _U(1)
_BAND_SEED = np.arange(BANDS, dtype=_U) * _U(0xE7037ED1A0B428DB)


def _avalanche(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct ``width``-word shingles; of all words as one if there are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, _U)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, n)
    k = min(n, width)
    total = np.full(n - k + 1, k * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF, _U)
    for i in range(k):
        total += _avalanche(hashes[i : n - k + 1 + i] * _ODD[i % 5] + _U(i))
    return np.unique(_avalanche(total))


def sketch(items: np.ndarray, t: int = T) -> np.ndarray:
    """``t`` coordinates of a non-empty set: each the round and hash that filled it."""
    out, filled, first = np.zeros(t, _U), np.zeros(t, bool), 0
    per = max(1, -(-4608 // len(items)))
    while not filled.all() and first < t:
        rounds = np.arange(first, min(t, first + per), dtype=_U)
        x = _avalanche(items[None, :] ^ _avalanche((rounds + _U(1)) * _ODD[0])[:, None])
        place = (x >> _U(32)) * _U(t) >> _U(32)
        order = (rounds - _U(first))[:, None]
        code = np.sort((place << _U(48) | order << _U(32) | (x & _U(0xFFFFFFFF))).ravel())
        at = (code >> _U(48)).astype(np.int64)
        lead = np.flatnonzero(np.diff(at, prepend=-1))
        new = lead[~filled[at[lead]]]
        out[at[new]] = (code[new] & _U(0xFFFFFFFFFFFF)) + (_U(first) << _U(32))
        filled[at[new]] = True
        first += len(rounds)
    for i in np.flatnonzero(~filled):
        x = _avalanche(items ^ _avalanche(_U(t + i + 1) * _ODD[:1])) & _U(0xFFFFFFFF)
        out[i] = (_U(t + i) << _U(32)) | x.min()
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    return _avalanche((coordinates.reshape(BANDS, ROWS) * _BAND_ODD).sum(1, dtype=_U) + _BAND_SEED)


def set_hash(items: np.ndarray) -> int:
    """A signed 64-bit hash of a set: its class."""
    return xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63)


def intersections(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections of ``sets`` with ``others`` (or each other), by products of 0/1 matrices
    whose columns are the items found on both sides, some columns at a time."""
    left = np.concatenate(sets)
    right = left if others is None else np.concatenate(others)
    if others is None:
        shared, n = np.unique(left, return_counts=True)
        shared = shared[n > 1]
    else:
        shared = np.intersect1d(left, right)

    def cells(parts: list[np.ndarray], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        at = np.searchsorted(shared, whole)
        good = at < len(shared)
        good[good] = shared[at[good]] == whole[good]
        row, at = row[good], at[good]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    a = cells(sets, left)
    b = a if others is None else cells(others, right)
    m = len(sets) if others is None else len(others)
    out = np.zeros((len(sets), m), np.float32)
    step = max(64, (1 << 22) // max(len(sets), m))
    for low in range(0, len(shared), step):
        width = min(step, len(shared) - low)
        dense = []
        for (row, at), n in ((a, len(sets)), (b, m)) if others is not None else ((a, len(sets)),):
            i, j = np.searchsorted(at, (low, low + width))
            x = np.zeros((n, width), np.float32)
            x[row[i:j], at[i:j] - low] = 1
            dense.append(x)
        out += dense[0] @ dense[-1].T
    if others is None:  # items of one set only
        out[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    return out.astype(np.int64)


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs reach the threshold, from intersections and sizes, in whole numbers."""
    return 100 * common >= PERCENT * (a[:, None] + b[None, :] - common)


def local_groups(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set the first set of its component, and its number of links."""
    sizes = np.array([len(s) for s in sets])
    links = linked(intersections(sets), sizes, sizes)
    root = np.arange(len(sets))
    while True:  # smallest neighbour, then pointers halved, until nothing moves
        new = np.where(links, root[None, :], len(sets)).min(1)
        new = np.minimum(new, root)[np.minimum(new, root)]
        if (new == root).all():
            return root, links.sum(1) - 1
        root = new


def _sets(docs: DataFrame, id_col: str, text_col: str, sketches: bool, wanted=None) -> DataFrame:
    """``doc_id``, ``n``, ``node`` (class; null for an empty set) and ``data``: band keys, or the set itself."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if wanted is not None:
        source = source.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for ids, texts, *bits in slices(batches):
            rows = []
            for k, (id_, text) in enumerate(zip(ids, texts)):
                if wanted is not None and not wanted.value[bits[0][k] >> 3] >> (bits[0][k] & 7) & 1:
                    continue
                items = shingles(text or "")
                node = set_hash(items) if len(items) else None
                if sketches:
                    data = band_keys(sketch(items)).tobytes() if len(items) else None
                elif node is None or node in seen:
                    continue
                else:
                    seen.add(node)
                    data = items.tobytes()
                rows.append((id_, len(items), node, data))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "n", "node", "data"])

    return bounded(source).mapInArrow(run, "doc_id bigint, n bigint, node bigint, data binary")


def _bands(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands of a batch's classes (node, data), sorted: keys, classes, and where each key begins with its smallest class."""
    nodes, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
    keys = np.frombuffer(b"".join(batch.column(1).take(pa.array(first)).to_pylist()), np.int64)
    order = np.argsort(keys, kind="stable")  # of equal keys the smaller class stays first
    keys = keys[order]
    return keys, np.repeat(nodes, BANDS)[order], np.diff(keys, prepend=~keys[:1]) != 0


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest class of each band that a batch has."""
    for batch in batches:
        keys, nodes, begins = _bands(batch)
        yield pa.RecordBatch.from_arrays([pa.array(keys[begins]), pa.array(nodes[begins])], ["key", "node"])


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the bands within a batch."""
    for batch in batches:
        _, nodes, begins = _bands(batch)
        lead = np.repeat(nodes[begins], np.diff(np.append(np.flatnonzero(begins), len(nodes))))
        a, b = np.unique(np.stack([nodes[~begins], lead[~begins]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _stars(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all classes sharing a band, through the band's smallest class. A class may be in many rows."""
    rows = bounded(rows.where("node is not null").select("node", "data"))
    heads = rows.mapInArrow(_heads, "key bigint, node bigint").withColumn("lead", F.min("node").over(W.partitionBy("key")))  # a row a batch
    return rows.mapInArrow(_inner, "a bigint, b bigint").unionAll(heads.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")))


def _filter_of(ids: DataFrame):
    """A bitmap of ``FILTER_BITS`` bits with the hashes of ``doc_id``, sent to the tasks."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)) + 1  # bitmap functions count from 1
    parts = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    whole = bytearray(FILTER_BITS // 8)
    for r in parts.collect():  # at most FILTER_BITS / 32,768 rows of 4 KB
        whole[(r["part"] - 1) * 4096 : r["part"] * 4096] = r["bits"]
    return whole


def _arrays(raw: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, _U) for x in raw.to_pylist()]


def _by(table: pa.Table, *names: str) -> Iterator[np.ndarray]:
    """Row numbers of each group of equal ``names``."""
    columns = [table[c].to_numpy() for c in names]
    order = np.lexsort(columns[::-1])
    change = np.zeros(len(order), bool)
    for c in columns:
        change[1:] |= c[order][1:] != c[order][:-1]
    yield from np.split(order, np.flatnonzero(change))


def _link_blocks(table: pa.Table) -> pa.Table:
    """Members of whole blocks: each with its local group (smallest class) and number of links."""
    nodes, out = table["node"].to_numpy(), []
    for rows in _by(table, "root", "block"):
        rows = rows[np.argsort(nodes[rows])]
        part = table.take(pa.array(rows))
        group, degree = local_groups(_arrays(part["data"]))
        out.append(pa.table({"root": part["root"], "node": part["node"], "local": pa.array(nodes[rows][group]), "degree": pa.array(degree)}))
    released()
    return pa.concat_tables(out)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set, few sets at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            sets = _arrays(part.column(2))
            at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            items = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(items)], ["root", "node", "item"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys and one byte of each coordinate instead of the set."""
    for batch in batches:
        of = [sketch(x) for x in _arrays(batch.column("data"))]
        columns = [batch.column(c) for c in ("root", "node", "label", "outer", "n")]
        fine = [(_avalanche(x) >> _U(56)).astype(np.uint8).tobytes() for x in of]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([band_keys(x).tobytes() for x in of], pa.binary()), pa.array(fine, pa.binary())], ["root", "node", "label", "outer", "n", "bands", "fine"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, T) for c in ("x_fine", "y_fine"))
        yield batch.filter(pa.array((x == y).sum(1) >= AGREE)).select(["x", "y"])


def _band_heads(shaped: DataFrame) -> DataFrame:
    """A row (root, item, node, label, outer) for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            items = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("root").take(at), pa.array(items), *(batch.column(c).take(at) for c in ("node", "label", "outer"))], ["root", "item", "node", "label", "outer"])

    return bounded(shaped.select("root", "node", "label", "outer", "bands")).mapInArrow(run, "root bigint, item bigint, node bigint, label bigint, outer boolean")


def _prefix_heads(placed: DataFrame) -> DataFrame:
    """A row for each shingle at the head of each set: the first 15 % in an order from the cluster's rarest on."""
    items = bounded(placed.select("root", "node", "data")).mapInArrow(_items, "root bigint, node bigint, item bigint")
    often = items.groupBy("root", "item").agg(F.count("*").alias("k")).where("k > 1")
    ranked = items.join(often, ["root", "item"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    ranked = ranked.withColumn("at", F.row_number().over(W.partitionBy("node").orderBy("k", "item")))  # one text's shingles
    shape = placed.select("node", "label", "outer", "n")
    heads = ranked.join(shape, "node").where((F.col("k") > 1) & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1))
    return heads.select("root", "item", "node", "label", "outer", "n", "at")


def _open(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items that propose something, and how many pairs those of each ``root`` do. What is found in one
    component only, or in none that is wanted, proposes nothing."""
    counts = heads.groupBy("root", "item").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count_if("outer").alias("o"), F.count("*").alias("c"))
    items = written(counts.where("l < h and o > 0").select("root", "item", (F.col("o") * F.col("c")).alias("pairs")))
    return items.select("root", "item"), items.groupBy("root").agg(F.sum("pairs").alias("pairs"))


def candidates(placed: DataFrame) -> DataFrame:
    """Pairs (x, y) of nodes that may be linked. ``placed``, a table, has ``root`` (cluster), ``node``
    (once each), ``label`` (what is connected), ``outer`` (whether pairs of it are wanted; one of a pair must be) and ``data``."""
    placed = placed.withColumn("n", F.expr("length(data) div 8"))
    shaped = written(bounded(placed).mapInArrow(_sketched, "root bigint, node bigint, label bigint, outer boolean, n bigint, bands binary, fine binary"))
    heads = _band_heads(shaped)
    items, by_bands = _open(heads)
    by_bands = shaped.groupBy("root").agg(F.sum("n").alias("shingles")).join(by_bands, "root")
    dense = written(by_bands.where(F.col("pairs") > BAND_PAIRS * F.col("shingles")).select("root", "pairs"))
    heads = heads.join(items, ["root", "item"])
    fine = shaped.select("node", "fine")

    def pairs(heads: DataFrame, *more: str) -> DataFrame:
        x = heads.where("outer").select("root", "item", *(F.col(c).alias(f"x_{c}") for c in ("node", "label", *more)))
        return x.join(heads, ["root", "item"]).where("label <> x_label and (not outer or node > x_node)")

    if dense.isEmpty():
        found = pairs(heads).select("x_node", "node")
    else:
        prefixes = written(_prefix_heads(placed.join(dense.select("root"), "root")))
        its, by_prefixes = _open(prefixes)
        fewer = written(dense.join(by_prefixes.withColumnRenamed("pairs", "other"), "root", "left").where(F.coalesce("other", F.lit(0)) < F.col("pairs")).select("root"))
        p = pairs(prefixes.join(its, ["root", "item"]).join(fewer, "root"), "n", "at")
        common = F.least(F.col("n") - F.col("at"), F.col("x_n") - F.col("x_at")) + 1  # the most, if this is the first in common
        fit = 100 * common >= PERCENT * (F.col("n") + F.col("x_n") - common)
        found = p.where(fit).select("x_node", "node").unionAll(pairs(heads.join(fewer, "root", "left_anti")).select("x_node", "node"))
    found = found.select(F.col("x_node").alias("x"), F.col("node").alias("y")).distinct()
    side = lambda c: fine.select(F.col("node").alias(c), F.col("fine").alias(f"{c}_fine"))
    return bounded(found.join(side("x"), "x").join(side("y"), "y").select("x", "y", "x_fine", "y_fine")).mapInArrow(_agreeing, "x bigint, y bigint")


def _link_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = _arrays(batch.column(1)), _arrays(batch.column(3))
        common = np.array([len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y)], np.int64)
        sizes = np.array([[len(s), len(t)] for s, t in zip(x, y)], np.int64).reshape(-1, 2)
        good = pa.array(100 * common >= PERCENT * (sizes.sum(1) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["a", "b"]).filter(good)


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (with ``label``), labels joined by ``links`` (a, b) made one."""
    roots = components(links)
    return nodes.join(roots.select(F.col("node").alias("label"), F.col("root").alias("_root")), "label", "left").withColumn("label", F.coalesce("_root", "label")).drop("_root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``."""
    rows, of_class, _ = _classes_of(docs, id_col, text_col)
    out = rows.select("doc_id", "n", "node").join(of_class, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.col("node").isNull())
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each component: a row of its smallest id
    (and class). Rows without words all stay."""
    _, _, chosen = _classes_of(docs, id_col, text_col)
    words = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    at, schema, names = docs.columns.index(text_col), docs.schema, docs.columns
    node_col, key_col = fresh(docs, "_node"), fresh(docs, "_id")
    quoted = [f"`{c}`" for c in names]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                nodes = [set_hash(shingles(t)) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nodes, pa.int64())], [*names, node_col])

    none = F.lit(-(1 << 63)).cast("long")
    with_node = numbered(docs.where(words)).mapInArrow(add, StructType([*schema.fields, StructField(node_col, LongType())]))
    keyed = with_node.withColumn(key_col, F.coalesce(F.col(id_col).cast("long"), none))
    wanted = chosen.select(F.col("node").alias(node_col), F.coalesce("doc_id", none).alias(key_col))
    one = keyed.join(wanted, [node_col, key_col], "left_semi").dropDuplicates([node_col, key_col])
    return one.select(*quoted).unionAll(docs.where(~words))


def _classes_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, node), each class's ``component_id``, and the chosen class (node, doc_id) of each component."""
    spark = docs.sparkSession
    rows = written(_sets(docs, id_col, text_col, True))
    classes = written(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n")))

    # clusters: components of the stars of shared bands
    clusters = components(_stars(rows))
    found = clusters.join(classes.select("node", "doc_id", "n"), "node")
    sizes = written(clusters.join(classes.select("node", "n"), "node").groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("items")))
    blocks_of = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("items") / BLOCK_SHINGLES))
    found = written(found.join(sizes.select("root", blocks_of.alias("blocks")), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))))

    # the sets of their members, once: each task sends a class once, and of these one is kept before the join
    wanted = spark.sparkContext.broadcast(bytes(_filter_of(found)))  # a fixed size
    sets = _sets(docs, id_col, text_col, False, wanted).select("node", "data").dropDuplicates(["node"])
    sets = written(sets.join(found.select("node", "root", "blocks", "block"), "node"))

    # links within blocks; small clusters share units of bounded size
    units = 1 + (sizes.agg(F.sum("items")).first()[0] or 0) // UNIT_SHINGLES
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(units))).otherwise(F.xxhash64("root", "block"))
    local = sets.select(unit.alias("unit"), "root", "block", "node", "data").groupBy("unit").applyInArrow(lambda t: _link_blocks(t), "root bigint, node bigint, local bigint, degree bigint")
    local = written(local)
    labels = local.select("node", F.col("local").alias("label"))

    # clusters of several blocks: groups against the largest groups
    many = sizes.where(blocks_of > 1).select("root")
    if not many.isEmpty():
        groups = local.join(many, "root").groupBy("root", "local").agg(F.count("*").alias("size"), F.max(F.struct("degree", "node"))["node"].alias("node"))
        groups = written(groups)
        rank = F.row_number().over(W.partitionBy("root").orderBy(F.desc("size"), "local"))
        pivots = groups.withColumn("rank", rank).where(F.col("rank") <= PIVOTS)
        of_many = sets.where("blocks > 1")
        with_set = written(groups.join(of_many.select("node", "data"), "node").select("root", "local", "data"))
        pivot_sets = written(with_set.join(pivots.select("root", "local"), ["root", "local"]).select("root", F.col("local").alias("p_local"), F.col("data").alias("p_data")))
        tests = with_set.join(pivot_sets, "root").where("local <> p_local").select("local", "data", "p_local", "p_data")
        labels = written(_labels(labels, bounded(tests).mapInArrow(_link_pivots, "a bigint, b bigint")))
        # members outside a cluster's largest component and those of others that they may be linked with
        placed = written(of_many.join(labels, "node"))
        largest = placed.groupBy("root", "label").agg(F.count("*").alias("size")).groupBy("root").agg(F.max(F.struct("size", "label"))["label"].alias("main"))
        placed = placed.join(written(largest), "root")
        outside = written(placed.where("label <> main").select("root").distinct())
        if not outside.isEmpty():
            every = written(placed.join(outside, "root").select("root", "node", "label", (F.col("label") != F.col("main")).alias("outer"), "data"))
            side = lambda c: every.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"), F.col("data").alias(f"{c}_data"))
            tests = written(candidates(every)).join(side("x"), "x").join(side("y"), "y").select("x_label", "x_data", "y_label", "y_data")
            labels = written(_labels(labels, bounded(tests).mapInArrow(_link_pivots, "a bigint, b bigint")))

    # the smallest document of each component; classes outside clusters stand alone
    member = classes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    member = written(member)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "doc_id", "node"))
    best = written(member.groupBy("label").agg(first.alias("first")).select("label", "first.doc_id", "first.node"))
    of_class = written(member.select("node", "label").join(best.select("label", F.col("doc_id").alias("component_id")), "label").select("node", "component_id"))
    return rows, of_class, best.select("node", "doc_id")


ORACLE = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as sh
  from d
), c as (
  select list_sort(sh) as sh, min(doc_id) as rep from s where len(sh) > 0 group by 1
), x as (
  select rep, len(sh) as n, unnest(sh) as h from c
), p as (
  select a.rep as a, b.rep as b from x a join x b on a.h = b.h and a.rep < b.rep
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e as (select a, b from p union all select b, a from p), r as (
  select rep as node, rep as root from c
  union
  select e.b, r.root from r join e on e.a = r.node
), m as (select node, min(root) as component_id from r group by 1)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles,
  coalesce(m.component_id, s.doc_id) as component_id, s.doc_id = coalesce(m.component_id, s.doc_id) as kept
from s left join c on c.sh = list_sort(s.sh) and len(s.sh) > 0 left join m on m.node = c.rep
"""

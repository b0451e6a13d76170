"""Near-duplicate vectors by an exact metric range join: pivots partition vectors, cells join independently.

Two vectors are linked when they have the same label and length and a cosine of at least ``THRESHOLD``; for
unit vectors that is a Euclidean distance of at most ``EPS``, a metric.

1. Equal vectors of a label are one class, which goes on once with the number of its members.
2. A label's classes are a cell. A cell with more than ``HOMES`` of them is split by pivots, taken from a sample of
   the cell and apart from each other. A vector's home is the cell of its nearest pivot. It is a guest in every other
   cell that it may have a partner in: by the triangle inequality that is only where it is no further than ``EPS`` beyond
   each border that the cell's pivot shares with another one (the plane between the two). Cells that are still
   too large are split again; guests of a cell are dealt to its parts in the same way.
3. All partners of a vector are in its home cell, so each cell counts the links of its home vectors by itself and gives
   the connected ones their component. Cells are cut into units of bounded size, homes by members, which are matrix products.
4. In a cell of several units the triangle inequality saves most of a dense group: vectors within half of ``EPS`` of
   the pivot are all linked, and are never compared with each other, nor with those beyond one and a half.
5. Components of all links give the result.

Pairs within 1e-12 of the threshold are decided by sums of products that are rounded once each.

Defined results: a vector that is null, empty, all zeros or holds a null or non-finite component, or whose label is
null, is linked with nothing; a null id is never a component's id unless all its members' are null; rows with
the same vector and label are linked, whatever their ids; labels, vectors and cells are known by 64-bit
hashes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bounded, written
from tagloom.llm.components import components

THRESHOLD = 0.98
#: Most home vectors of a cell that is not split further, of a block of rows, and members of a slice of columns.
HOMES, COLUMNS = 2048, 8192
#: Vectors that pivots are chosen from (about as many), pivots of a cell, and rounds of splitting.
SAMPLE, PIVOTS, LEVELS = 512, 32, 8
#: Vectors of a cell that are dealt to its parts together.
DEALT = 1 << 14
#: Zones of a cell by the distance to its pivot, and which of them may hold links that need a comparison.
CORE, NEAR, FAR = range(3)
COMPARED = {CORE: (NEAR,), NEAR: (CORE, NEAR, FAR), FAR: (NEAR, FAR)}
#: What rounding may add to a distance.
SLACK = 1e-6


def reach(threshold: float) -> float:
    """The distance of unit vectors whose cosine is ``threshold``."""
    return math.sqrt(2 - 2 * threshold)


def units_of(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors from components in single or double precision."""
    out = np.empty((len(raw), dim))
    wide = np.array([len(r) == 8 * dim for r in raw], bool)
    for kind, rows in (("<f4", ~wide), ("<f8", wide)):
        if rows.any():
            out[rows] = np.frombuffer(b"".join(r for r, w in zip(raw, rows) if w), kind).reshape(-1, dim)
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def cosine(a: bytes, b: bytes, dim: int) -> float:
    x, y = (np.frombuffer(r, f"<f{len(r) // dim}").astype(float) for r in (a, b))
    x, y = ((v / np.abs(v).max()).tolist() for v in (x, y))
    return math.sumprod(x, y) / (math.sqrt(math.sumprod(x, x)) * math.sqrt(math.sumprod(y, y)))


def links(rows: np.ndarray, columns: np.ndarray, raw_rows: list[bytes], raw_columns: list[bytes], threshold: float) -> np.ndarray:
    """Which rows and columns are linked."""
    product = rows @ columns.T
    out = product >= threshold
    for i, j in zip(*np.nonzero(np.abs(product - threshold) <= 1e-12)):
        out[i, j] = cosine(raw_rows[i], raw_columns[j], rows.shape[1]) >= threshold
    return out


def bipartite_roots(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of the component of each row and column; a number beyond all rows for columns without a link."""
    n = len(link)
    row = np.arange(n)
    while True:  # smallest row of the columns' rows, then pointers halved, until nothing moves
        column = np.where(link, row[:, None], n).min(0)
        new = np.minimum(row, np.where(link, column[None, :], n).min(1))
        new = new[new]
        if (new == row).all():
            return row, column
        row = new


def choose_pivots(units: np.ndarray, most: int, eps: float) -> np.ndarray:
    """At most ``most`` of the vectors, in their order, that are well apart; each moved to the middle of those about it.
    One alone: the middle of all."""
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < most:
        apart = np.flatnonzero(nearest <= 1 - (2.5 * eps) ** 2 / 2)
        if not len(apart):
            break
        chosen.append(int(apart[0]))
        nearest = np.maximum(nearest, units @ units[apart[0]])
    if len(chosen) == 1:
        middle = units.sum(0, keepdims=True)
    else:
        about = units @ units[chosen].T >= 1 - eps**2 / 2
        middle = about.T.astype(float) @ units
    length = np.sqrt((middle * middle).sum(1, keepdims=True))
    return np.where(length > 1e-9, middle / np.maximum(length, 1e-9), units[chosen])


def deal(units: np.ndarray, home: np.ndarray, pivots: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each pivot the vectors in its cell, whether it is their home, and their zone."""
    product = units @ pivots.T
    nearest = product.argmax(1)
    between = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))
    np.fill_diagonal(between, np.inf)
    for j in range(len(pivots)):
        beyond = ((product - product[:, j : j + 1]) / np.maximum(between[j], 1e-9)).max(1) if len(pivots) > 1 else np.zeros(len(units))
        at = np.flatnonzero((beyond <= eps + SLACK) | (nearest == j))
        distance = np.sqrt(np.maximum(2 - 2 * product[at, j], 0))
        zone = np.where(distance <= eps / 2 - SLACK, CORE, np.where(distance <= 1.5 * eps + SLACK, NEAR, FAR))
        yield at, home[at] & (nearest[at] == j), zone


_MEMBER = "cell bigint, node bigint, w bigint, dim int, home boolean, zone int, last boolean, raw binary"
_NAMES = [c.split()[0] for c in _MEMBER.split(", ")]


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest(repr(parts).encode()) - (1 << 63)


def _vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id`` of every row, and for those that take part ``node`` (class), ``cell`` (label and length), ``dim`` and ``raw``."""
    values = F.col(vector_col).cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col(label_col).isNotNull() & ~bad & F.exists(values, lambda x: x != 0), F.lit(False))
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, F.xxhash64(F.col(label_col).cast("string"), F.size(values))).alias("cell"), F.when(good, values).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            flat, sizes = batch.column(2).flatten().to_numpy(zero_copy_only=False) + 0.0, batch.column(2).value_lengths().fill_null(0).to_numpy()
            for cell, v in zip(batch.column(1).to_pylist(), np.split(flat, np.cumsum(sizes)[:-1])):
                if cell is None:
                    rows.append((None, 0, None))
                    continue
                with np.errstate(over="ignore"):
                    narrow = v.astype("<f4")
                raw = (narrow if (narrow == v).all() else v.astype("<f8")).tobytes()
                rows.append((xxhash.xxh3_64_intdigest(raw, seed=cell & 0xFFFFFFFF) - (1 << 63), len(v), raw))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["vec_id", "cell", "node", "dim", "raw"])

    return bounded(source).mapInArrow(run, "vec_id bigint, cell bigint, node bigint, dim int, raw binary")


def _pivots(members: DataFrame, open_: DataFrame, level: int, eps: float) -> DataFrame:
    """``cell`` and its ``pivots``, from about ``SAMPLE`` of its homes by their hashes."""
    chance = (F.xxhash64("node", F.lit(level)) / float(1 << 64)) + 0.5
    sample = members.where("home").join(open_, "cell").where(chance < SAMPLE / F.col("homes")).select("cell", "homes", "node", "dim", "raw")

    def choose(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort([_hash(level, n) for n in t["node"].to_pylist()])))
        units = units_of(t["raw"].to_pylist(), t["dim"][0].as_py())
        most = min(PIVOTS, max(2, -(-3 * t["homes"][0].as_py() // (2 * HOMES))))
        return pa.table({"cell": t["cell"][:1], "pivots": pa.array([choose_pivots(units, most, eps).tobytes()])})

    return bounded(sample).groupBy("cell").applyInArrow(choose, "cell bigint, pivots binary")


def _split(members: DataFrame, pivots: DataFrame, eps: float) -> DataFrame:
    """The members of cells that have pivots, in their parts. A cell is dealt in stretches of bounded size, each with the pivots."""
    parts = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    dealt = members.join(pivots.select("cell", "salts"), "cell").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))

    def run(some: pa.Table, pivot: pa.Table) -> pa.Table:
        if not some.num_rows or not pivot.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(_NAMES, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.bool_(), pa.binary()))})
        dim, cell = some["dim"][0].as_py(), some["cell"][0].as_py()
        points = np.frombuffer(pivot["pivots"][0].as_py()).reshape(-1, dim)
        out = []
        for j, (at, home, zone) in enumerate(deal(units_of(some["raw"].to_pylist(), dim), some["home"].to_numpy(), points, eps)):
            kept, n = some.select(["node", "w", "dim", "raw"]).take(pa.array(at)), len(at)
            out.append(pa.table({"cell": pa.array(np.full(n, _hash(cell, j))), "node": kept["node"], "w": kept["w"], "dim": kept["dim"], "home": pa.array(home), "zone": pa.array(zone, pa.int32()), "last": pa.array(np.full(n, len(points) == 1)), "raw": kept["raw"]}))
        return pa.concat_tables(out)

    return bounded(dealt.select("cell", "salt", "node", "w", "dim", "home", "raw")).groupBy("cell", "salt").cogroup(parts.select("cell", "salt", "pivots").groupBy("cell", "salt")).applyInArrow(run, _MEMBER)


def cells(classes: DataFrame, eps: float) -> DataFrame:
    """The members of all final cells."""
    level, done = classes, []
    for n in range(LEVELS):
        sizes = written(level.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("members"), F.any_value("last").alias("last")))
        open_ = sizes.where((F.col("homes") > HOMES) & ~F.col("last"))
        if open_.isEmpty():
            break
        pivots = _pivots(level, open_.select("cell", "homes"), n, eps)
        pivots = written(pivots.join(open_.select("cell", F.ceil(F.col("members") / DEALT).alias("salts")), "cell"))
        done.append(level.join(pivots.select("cell"), "cell", "left_anti"))
        level = written(_split(level, pivots, eps))
    for part in done:
        level = level.unionByName(part)
    return level


def _units(members: DataFrame) -> DataFrame:
    """Members in their units, as ``row``, ``column`` or both. ``lane``: what is worked on together."""
    blocks = lambda n, of: F.ceil(n / of)
    pick = lambda stem, z: F.element_at(F.array(*(F.col(f"{stem}{k}") for k in COMPARED)), z + 1)
    zone, one = F.col("zone"), F.col("members") <= COLUMNS
    block, slice_ = (F.pmod(F.xxhash64("node", F.lit(k)), F.greatest(blocks(pick(stem, zone), of), F.lit(1))) for k, stem, of in ((1, "h", HOMES), (2, "m", COLUMNS)))

    def numbers(stem: str, z: int, of: int) -> Column:
        n = blocks(F.col(f"{stem}{z}"), of)
        return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))

    def at(zr: Column, b: Column, zc: Column, s: Column, row: bool) -> Column:
        return F.struct(F.xxhash64("cell", zr, b, zc, s).alias("unit"), F.lit(row).alias("row"), F.lit(not row).alias("column"))

    def as_row(other: int) -> Column:
        return F.transform(numbers("m", other, COLUMNS), lambda s: at(zone, block, F.lit(other), s, True))

    def as_column(other: int) -> Column:
        return F.transform(numbers("h", other, HOMES), lambda b: at(F.lit(other), b, zone, slice_, False))

    none = F.array().cast("array<struct<unit:bigint,row:boolean,column:boolean>>")
    places = []
    for z, others in COMPARED.items():
        for other in others:
            places += [F.when((zone == z) & F.col("home"), as_row(other)).otherwise(none), F.when(zone == z, as_column(other)).otherwise(none)]
    alone = F.array(F.struct(F.col("cell").alias("unit"), F.col("home").alias("row"), F.lit(True).alias("column")))
    out = members.withColumn("place", F.explode(F.when(one, alone).otherwise(F.concat(*places))))
    lane = F.when(one, F.pmod(F.xxhash64("cell"), F.col("lanes"))).otherwise(F.col("place.unit"))
    return out.select(lane.alias("lane"), "place.unit", "place.row", "place.column", "node", "w", "dim", "raw")


def _join(lane: pa.Table, threshold: float) -> pa.Table:
    """Links of the rows of a lane's units: ``n``, those of a node; ``root``, a node that it is connected with."""
    out = []
    unit = lane["unit"].to_numpy()
    order = np.argsort(unit, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
        part = lane.take(pa.array(rows))
        node, w, raw, dim = part["node"].to_numpy(), part["w"].to_numpy(), part["raw"].to_pylist(), part["dim"][0].as_py()
        r, c = np.flatnonzero(part["row"].to_numpy()), np.flatnonzero(part["column"].to_numpy())
        vectors, n = units_of(raw, dim), np.zeros(len(r), np.int64)
        raw_r = [raw[i] for i in r]
        for low in range(0, len(c), HOMES):
            k = c[low : low + HOMES]
            link = links(vectors[r], vectors[k], raw_r, [raw[i] for i in k], threshold)
            link &= node[r][:, None] != node[k][None, :]
            if not link.any():
                continue
            n += link @ w[k]
            row, column = bipartite_roots(link)
            some, others = np.flatnonzero(link.any(1)), np.flatnonzero(column < len(r))
            for nodes, roots in ((node[r][some], row[some]), (node[k][others], column[others])):
                out.append(pa.table({"node": nodes, "n": np.zeros(len(nodes), np.int64), "root": node[r][roots]}))
        some = np.flatnonzero(n)
        out.append(pa.table({"node": node[r][some], "n": n[some], "root": node[r][some]}))
    return pa.concat_tables(out)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` (smallest id reachable) and ``kept``."""
    eps = reach(threshold)
    rows = written(_vectors(vectors, id_col, vector_col, label_col))
    of_node = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("w"), F.any_value("cell").alias("cell"), F.any_value("dim").alias("dim"), F.any_value("raw").alias("raw"))
    classes = written(of_node.withColumns({"home": F.lit(True), "zone": F.lit(FAR), "last": F.lit(False)}))
    members = written(cells(classes.select(_NAMES), eps))

    in_zone = lambda z, of: F.count_if((F.col("zone") == z) & of)
    counts = [x for z in COMPARED for x in (in_zone(z, F.col("home")).alias(f"h{z}"), in_zone(z, F.lit(True)).alias(f"m{z}"))]
    core = F.col("zone") == CORE
    sizes = members.groupBy("cell").agg(F.count("*").alias("members"), *counts, F.sum(F.when(core, F.col("w"))).alias("core_w"), F.min(F.when(core, F.col("node"))).alias("core_node"))
    sizes = written(sizes)
    lanes = 1 + (sizes.where(F.col("members") <= COLUMNS).agg(F.sum("members")).first()[0] or 0) // COLUMNS
    sized = members.join(sizes.withColumn("lanes", F.lit(lanes)), "cell")
    found = bounded(_units(sized)).groupBy("lane").applyInArrow(lambda t: _join(t, threshold), "node bigint, n bigint, root bigint")
    # in a cell of several units the vectors of the core are all linked
    dense = sized.where(core & (F.col("members") > COLUMNS)).select("node", F.when(F.col("home"), F.col("core_w") - F.col("w")).otherwise(0).alias("n"), F.col("core_node").alias("root"))
    found = written(found.unionAll(dense))

    n_links = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("node", "vec_id", "w").join(n_links, "node", "left").join(roots, "node", "left")
    of_class = written(of_class.select("node", "vec_id", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    best = of_class.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    of_class = written(of_class.join(best, "root").select("node", "n_links", "component_id"))
    out = rows.select("vec_id", "node").join(of_class, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False) | F.col("node").isNull()).alias("kept"))


ORACLE = """
with recursive v as (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
), good as (
  select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), links as (
  select a.r as a, b.r as b from good a join good b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98
), reached as (
  select r as node, r as root from v
  union
  select links.b, reached.root from reached join links on links.a = reached.node
), c as (select node, min(vec_id) as component_id from reached join v on v.r = reached.root group by node
), n as (select a, count(*) as n_links from links group by a)
select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, vec_id = component_id as kept
from v join c on c.node = v.r left join n on n.a = v.r
"""

"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidate rows are packed into blocks, each kept as postings: for every term (component) the rows
that have it and their integer weights. Blocks are dealt to lanes; a lane is what one task holds. Queries
are packed into full blocks of their own, and each is sent once to every lane. There each query scatters
its weights times the postings of its terms into a dense array with one score per row of a block, block
after block, and the lane keeps its k best; these few rows per query and lane are merged.

The work is that of all queries against all rows; what is sent is the candidates once and the queries once
per lane. Memory is a lane's blocks, in the narrowest type, and one block of postings.

Defined results: rows whose vector is null, or holds a null or non-finite component, and rows with a
null id take no part; an absent component counts 0, so lengths may differ; a query's own row is left
out, other rows with its id are not; ties go to the smaller id; a
score beyond a long is given as the nearest long; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.llm.common import bounded, estimated_bytes, written

#: Rows of a block of candidates and of queries; bytes of a lane's blocks.
ROWS, QUERY_ROWS, LANE_BYTES = 8192, 2048, 256 << 20
#: A row's place is its block's number times this, plus its number there.
PLACES = 8192
SCALE = 256.0
#: Sums below this are exact in float64.
EXACT = float(1 << 53)


def postings(matrix: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each term the rows with a non-zero weight and these weights; all rows: a slice."""
    out = []
    for column in matrix.T:
        rows = np.flatnonzero(column)
        out.append((slice(None), np.ascontiguousarray(column)) if len(rows) == len(column) else (rows, column[rows]))
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= limit)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((near, ids[near], -scores[near]))[:k]]


def search_block(queries: np.ndarray, own: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """(id, score) of each query's ``k`` best rows. ``own``: a query's position in this block, or -1.
    Matrices are float64 where sums stay exact, else of Python integers."""
    lists = postings(matrix)
    out = []
    scores = np.empty(len(matrix), matrix.dtype)
    for query, mine in zip(queries, own.tolist()):
        scores[:] = 0
        for term in np.flatnonzero(query[: len(lists)]).tolist():
            rows, weights = lists[term]
            if isinstance(rows, slice):
                scores += weights * query[term]
            else:
                scores[rows] += weights * query[term]
        if mine < 0:
            at = best(scores, ids, k)
        else:
            rest = np.delete(np.arange(len(matrix)), mine)
            at = rest[best(scores[rest], ids[rest], k)]
        out.append([(int(ids[i]), int(scores[i])) for i in at.tolist()])
    return out


def _pack(vectors: list[np.ndarray]) -> tuple[bytes, int, str]:
    """Weights as one matrix in the narrowest exact type, rows padded by zeros."""
    width = max(map(len, vectors), default=0)
    matrix = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        matrix[i, : len(v)] = v
    most = float(np.abs(matrix).max()) if matrix.size else 0.0
    kind = "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "f8"
    return matrix.astype(f"<{kind}").tobytes(), width, kind


def _unpack(raw: bytes, width: int, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<{kind}").reshape(n, width)


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = (float(np.abs(a).max()) if a.size else 0.0) * (float(np.abs(b).max()) if b.size else 0.0) * max(1, a.shape[1])
    if most < EXACT:
        return a.astype(np.float64), b.astype(np.float64)
    whole = np.vectorize(int, otypes=[object])
    return (whole(a) if a.size else a.astype(object)), (whole(b) if b.size else b.astype(object))


_KINDS = {"block": pa.int64(), "n": pa.int64(), "width": pa.int32(), "kind": pa.string(), "ids": pa.binary(), "weights": pa.binary(), "places": pa.binary(), "query": pa.bool_()}
_BLOCK = "block bigint, n bigint, width int, kind string, ids binary, weights binary, places binary, query boolean"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS.values())], list(_KINDS))


def _blocks(vectors: DataFrame, id_col: str, vector_col: str, every: int) -> DataFrame:
    """Packed rows; each candidate block is followed by its queries. ``places``: number of each row, distinct in the table."""
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    source = source.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    parts = max(1, min(100_000, estimated_bytes(vectors) // (ROWS * 256)))
    source = source.coalesce(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[np.ndarray] = []
        block = TaskContext.get().partitionId() << 20

        def packed() -> pa.RecordBatch:
            chosen = [i for i, x in enumerate(ids) if x % every == 0]
            out = []
            for at, is_query in ((range(len(ids)), False), (chosen, True)):
                if at:
                    raw, width, kind = _pack([rows[i] for i in at])
                    places = np.array(list(at), "<i8") + block * PLACES
                    out.append((block, len(at), width, kind, np.array([ids[i] for i in at], "<i8").tobytes(), raw, places.tobytes(), is_query))
            return _packed(out)

        for batch in batches:
            values, ends = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            floors = np.floor(SCALE * values)
            ids += batch.column(0).to_pylist()
            rows += np.split(floors, ends[:-1])
            while len(ids) >= ROWS:
                later = ids[ROWS:], rows[ROWS:]
                del ids[ROWS:], rows[ROWS:]
                yield packed()
                ids, rows = later
                block += 1
        if ids:
            yield packed()

    return bounded(source).mapInArrow(run, _BLOCK)


def _full_queries(blocks: DataFrame, some: int) -> DataFrame:
    """The ``some`` queries of all candidate blocks, packed again into full blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, places, block = [], [], [], TaskContext.get().partitionId() << 20
        for batch in batches:
            for r in batch.to_pylist():
                ids += np.frombuffer(r["ids"], "<i8").tolist()
                places += np.frombuffer(r["places"], "<i8").tolist()
                rows += list(_unpack(r["weights"], r["width"], r["kind"], r["n"]).astype(np.float64))
                while len(ids) >= QUERY_ROWS:
                    yield _packed([_query_block(block, ids[:QUERY_ROWS], rows[:QUERY_ROWS], places[:QUERY_ROWS])])
                    ids, rows, places, block = ids[QUERY_ROWS:], rows[QUERY_ROWS:], places[QUERY_ROWS:], block + 1
        if ids:
            yield _packed([_query_block(block, ids, rows, places)])

    return bounded(blocks.where("query").coalesce(max(1, some // (8 * QUERY_ROWS)))).mapInArrow(run, _BLOCK)


def _query_block(block: int, ids: list, rows: list, places: list) -> tuple:
    raw, width, kind = _pack(rows)
    return block, len(ids), width, kind, np.array(ids, "<i8").tobytes(), raw, np.array(places, "<i8").tobytes(), True


def _lane_best(q: dict, candidates: list[dict], k: int) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """Places and ids of a query block's rows, and the (id, score) of each one's ``k`` best in a lane."""
    ids, places = np.frombuffer(q["ids"], "<i8"), np.frombuffer(q["places"], "<i8")
    weights = _unpack(q["weights"], q["width"], q["kind"], q["n"])
    top: list[list[tuple[int, int]]] = [[] for _ in ids]
    for r in candidates:
        a, b = _exact(weights, _unpack(r["weights"], r["width"], r["kind"], r["n"]))
        own = np.where(places // PLACES == r["block"], places % PLACES, -1)
        for i, got in enumerate(search_block(a, own, b, np.frombuffer(r["ids"], "<i8"), k)):
            top[i] = sorted(top[i] + got, key=lambda x: (-x[1], x[0]))[:k] if top[i] else got
    return places, ids, top


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` for the rows whose id ``every`` divides."""
    spark = vectors.sparkSession
    blocks = written(_blocks(vectors, id_col, vector_col, every))
    size = blocks.agg(F.sum(F.when(F.col("query"), F.col("n"))), F.sum(F.when(~F.col("query"), F.octet_length("weights"))), F.sum((~F.col("query")).cast("long"))).first()
    lanes = max(1, -(-(size[1] or 0) // LANE_BYTES), min(size[2] or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    queries = written(_full_queries(blocks, size[0] or 0)).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    candidates = blocks.where("not query").withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int"))
    # a lane's candidates come before the queries
    work = candidates.unionByName(queries).repartitionById(lanes, "lane").sortWithinPartitions("lane", "query", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        lane = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["lane"] != lane:
                    held, lane = [], r["lane"]
                if not r["query"]:
                    held.append(r)
                    continue
                places, ids, top = _lane_best(r, held, k)
                flat = [(int(n), int(q), v, min(max(s, -(1 << 63)), (1 << 63) - 1)) for n, q, x in zip(places, ids, top) for v, s in x]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], ["row", "query_id", "vec_id", "score"])

    partial = bounded(work).mapInArrow(run, "row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, row_number() over () as r, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w
  from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, q.r, c.vec_id, cast(list_sum(list_transform(list_zip(q.w, c.w), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.r <> c.r
), t as (select *, cast(row_number() over (partition by query_id, r order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from t where rank <= 5
"""

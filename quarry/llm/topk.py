"""Exact top-k inner products through a pivot-distance index.

Vectors become whole numbers, floor(scale * x), so scores are exact.  One
more component, sqrt(M^2 - |x|^2) with M the greatest norm, turns the
greatest inner product with a query into the least distance to it.  Every
vector is keyed by its nearest pivot and its distance to it; the keys are
range-sorted, which spreads a crowded pivot over many tasks, and cut into
annuli.  A query expands the annuli of a stretch of the index nearest first
and stops where the triangle inequality puts the next one beyond its k-th
best.  The k-th best of its own annulus is its first bound.  Only the pivots
(a fixed number of vectors) are sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.rank import top_n_per_group
from quarry.llm.common import ship, tidy, written

SCALE, K, PIVOTS = 64, 20, 64
#: vectors of an annulus, of a stretch of the index, queries of a block
ANNULUS, STRETCH, QUERIES = 1024, 16_384, 1024
#: scores of vectors under this squared length (a little under 2^63) fit 64 bits
LARGEST = 9.2e18


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(_id, _v) with _v the whole-number components.  Rows without an id, and
    vectors that are null, hold a null or non-finite component or (times
    scale) have a squared length of ``LARGEST`` or more take no part.  An empty
    vector takes part, as zeros."""
    def fit(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(LARGEST ** 0.5))
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_x"))
    rows = rows.filter(F.col("_id").isNotNull() & F.col("_x").isNotNull() & F.forall("_x", fit))
    rows = rows.select("_id", F.transform("_x", lambda x: F.floor(x.cast("double") * scale)).alias("_v"))
    return rows.filter(squared("_v") < F.lit(LARGEST))


def squared(column: str) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x)


def _matrix(column: pa.Array, dim: int, whole) -> np.ndarray:
    """List column as rows of ``dim``; shorter vectors are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dim), whole)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(0, most - (v * v).sum(1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


def _slack(most: float, dim: int) -> float:
    """More than rounding can move a distance between lifted vectors."""
    return 1e-6 + 8 * float(np.sqrt((dim + 8) * 2.0 ** -52 * most))


def _assigner(pivots: np.ndarray, most: float, dim: int, whole):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lifted = _lifted(pivots, most)
        for batch in batches:
            v = _matrix(batch.column("_v"), dim, whole)
            away = _distances(_lifted(v, most), lifted)
            near = away.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_q"), pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(v)), near]),
                 pa.array([x.tobytes() for x in v], pa.binary())], ["_id", "_q", "_pivot", "_dist", "_vec"])
    return tidy(run)


INDEX = "stretch int, ids binary, vecs binary, cuts binary, pivots binary, low binary, high binary, queries binary"


#: what the search reads of a pair of stretch and block
SEARCHED = ("ids", "vecs", "cuts", "pivots", "low", "high", "qids", "qvecs", "least")


def _packer(dim: int, annulus: int, stretch: int):
    """Stretches of the sorted index, each with its annuli: they end where
    the pivot changes or are full."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []

        def packed(table: pa.Table) -> pa.RecordBatch:
            pivot, dist = (table[c].to_numpy() for c in ("_pivot", "_dist"))
            edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1), len(pivot)]
            cuts = np.array([*(c for a, b in zip(edges, edges[1:]) for c in range(a, b, annulus)), len(pivot)])
            blobs = [table["_id"].to_numpy().tobytes(), b"".join(table["_vec"].to_pylist()), cuts.astype(np.int64).tobytes(),
                     pivot[cuts[:-1]].astype(np.int64).tobytes(), dist[cuts[:-1]].tobytes(), dist[cuts[1:] - 1].tobytes(),
                     table["_q"].to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)],
                                              [x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            while table.num_rows >= stretch:
                yield packed(table.slice(0, stretch))
                table = table.slice(stretch)
            held = table.to_batches()
        if held and sum(b.num_rows for b in held):
            yield packed(pa.Table.from_batches(held))
    return tidy(run)


class _Stretch:
    def __init__(self, row: dict, dim: int, kind, whole):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vecs = np.frombuffer(row["vecs"], whole).reshape(-1, dim).astype(kind)
        self.cuts, self.pivots = (np.frombuffer(row[c], np.int64) for c in ("cuts", "pivots"))
        self.low, self.high = (np.frombuffer(row[c], np.float64) for c in ("low", "high"))


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int, k: int, least: np.ndarray):
    """The k best of each query (ties to smaller ids), and their new bounds."""
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    first = np.searchsorted(q, np.arange(n))
    rank = np.arange(len(q)) - first[q]
    good = rank < k
    last = rank == k - 1
    least = least.copy()
    least[q[last]] = np.maximum(least[q[last]], score[last])
    return q[good], score[good], ids[good], least


def _query_maker(dim: int, k: int, kind, whole):
    """Each query with its annulus and the k-th best score there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s, is_query = _Stretch(row, dim, kind, whole), np.frombuffer(row["queries"], np.uint8)
                for g, (a, b) in enumerate(zip(s.cuts, s.cuts[1:])):
                    at = np.flatnonzero(is_query[a:b])
                    if not len(at):
                        continue
                    least = np.full(len(at), np.iinfo(np.int64).min)
                    if b - a > k:
                        score = (s.vecs[a:b][at] @ s.vecs[a:b].T).astype(np.int64)
                        score[s.ids[a:b][at][:, None] == s.ids[a:b]] = np.iinfo(np.int64).min
                        least = np.partition(score, -k, axis=1)[:, -k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.ids[a:b][at]), pa.array([x.tobytes() for x in s.vecs[a:b][at].astype(whole)], pa.binary()),
                         pa.array(least), pa.array(np.full(len(at), s.pivots[g])), pa.array(np.full(len(at), s.low[g]))],
                        ["_id", "vec", "least", "pivot", "low"])
    return tidy(run)


def _block_maker(queries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, queries):
                part = batch.slice(k, queries)
                blobs = [part.column("_id").to_numpy().tobytes(), b"".join(part.column("vec").to_pylist()),
                         part.column("least").to_numpy().tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], ["qids", "qvecs", "least"])
    return tidy(run)


def _searcher(pivots: np.ndarray, most: float, dim: int, k: int, kind, stored):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lifted, slack = _lifted(pivots, most), _slack(most, dim)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_buffer() for c in SEARCHED}  # the batch's own bytes
                s = _Stretch(row, dim, kind, stored)
                qids, least = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["least"], np.int64)
                whole = np.frombuffer(row["qvecs"], stored).reshape(-1, dim)
                wide, n = whole.astype(np.float64), len(qids)
                square = (wide * wide).sum(1)
                away = _distances(np.hstack([wide, np.zeros((n, 1))]), lifted)[:, s.pivots]
                bound = np.maximum(0, np.maximum(away - s.high, s.low - away))
                order = np.argsort(bound, axis=1, kind="stable")
                vecs = whole.astype(kind)
                q, score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                alive = np.arange(n)
                for t in range(order.shape[1]):  # the t-th nearest annulus of each query still searching
                    next_one = order[alive, t]
                    lower = bound[alive, next_one]
                    far = np.sqrt(np.maximum(0, square[alive] + most - 2 * least[alive].astype(np.float64)))
                    going = lower <= far * (1 + 1e-9) + slack
                    alive, next_one = alive[going], next_one[going]
                    if not len(alive):
                        break
                    new = [(q, score, ids)]
                    for g in np.unique(next_one):
                        mine, a, b = alive[next_one == g], s.cuts[g], s.cuts[g + 1]
                        got = (vecs[mine] @ s.vecs[a:b].T).astype(np.int64)
                        i, j = np.nonzero((got >= least[mine][:, None]) & (qids[mine][:, None] != s.ids[a:b]))
                        new.append((mine[i], got[i, j], s.ids[a:b][j]))
                    q, score, ids, least = _best(*(np.concatenate(x) for x in zip(*new)), n, k, least)
                good = score >= least[q]
                yield pa.RecordBatch.from_arrays([pa.array(qids[q[good]]), pa.array(ids[good]), pa.array(score[good])],
                                                 ["query_id", "vec_id", "score"])
    return tidy(run)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
          scale: int = SCALE, pivots: int = PIVOTS, annulus: int = ANNULUS, stretch: int = STRETCH,
          queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the greatest inner
    product for every row for which ``is_query`` holds (a column of ``_id``).

    A row is not compared with rows of its own id.  Shorter vectors are
    filled with zeros.  Equal scores go to the smaller id; all others are
    returned if fewer than k.  Which rows take part: see ``whole_vectors``.
    A repeated row is a
    candidate each time; the queries of one id are one query, the vector first in
    byte order.
    Other columns are not read.  No vectors, no rows.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vec_col, scale).withColumn("_q", is_query)
    n, dim, most, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("_v")), F.max(squared("_v")),
                                     F.max(F.array_max(F.transform("_v", lambda x: F.abs(x))))).first()
    dim, most, largest = dim or 1, most or 0.0, largest or 0
    kind = np.float32 if dim * largest ** 2 < 1 << 24 else np.float64 if dim * largest ** 2 < 1 << 53 else np.int64
    whole = next((t for t in (np.int8, np.int16, np.int32) if largest <= np.iinfo(t).max), np.int64)
    chosen = rows.orderBy(F.xxhash64("_id"), "_id").limit(pivots).select("_v").collect()  # a fixed number of vectors
    centres = np.zeros((max(1, len(chosen)), dim), whole)
    for i, row in enumerate(chosen):
        centres[i, :len(row[0])] = row[0]
    keyed = rows.mapInArrow(_assigner(centres, most, dim, whole), "_id long, _q boolean, _pivot int, _dist double, _vec binary")
    order = ("_pivot", "_dist", "_id")
    index = written(keyed.repartitionByRange(max(1, -(-n // stretch)), *order).sortWithinPartitions(*order)
                    .mapInArrow(_packer(dim, annulus, stretch), INDEX), "pivot-index")
    found = index.mapInArrow(_query_maker(dim, k, kind, whole), "_id long, vec binary, least long, pivot long, low double")
    # one query for each id
    single = found.groupBy("_id").agg(F.min(F.struct("vec", "least", "pivot", "low")).alias("x")).select("_id", "x.*")
    blocks = written(single.sortWithinPartitions("pivot", "low").select("_id", "vec", "least")
                     .mapInArrow(_block_maker(queries), "qids binary, qvecs binary, least binary"), "pivot-queries")
    last = index.agg(F.max("stretch")).first()[0]
    # every block of queries goes to every stretch of the index, by its number; Spark judges these copies by
    # the blocks' own size and would broadcast them, through the driver
    sent = blocks.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.lit(last or 0))))
    pairs = index.drop("queries").join(sent.hint("shuffle_merge"), "stretch")
    best = pairs.mapInArrow(_searcher(centres, most, dim, k, kind, whole), "query_id long, vec_id long, score long")
    ranked = top_n_per_group(best, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k, "rank")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: brute force in SQL, for the registered query
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_resize(list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT),
                             (SELECT max(len(embedding)) FROM embeddings), 0) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ship(__name__)

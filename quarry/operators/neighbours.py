"""Exact k nearest neighbours of every row among the others.

Rows are dealt to the cells of pivots (the nearest pivot's), ordered by their
distance from it and cut into blocks of consecutive rows.  A block knows how far
its rows lie from each pivot, at least and at most, and how far its rows'
k-th neighbours can be: the largest k-th distance inside the block itself, or
what the cells' sizes and radii allow.  By the triangle inequality two blocks
are as far apart as their distance ranges from any one pivot are, so

* a block only asks the cells, and of a cell only the blocks, that may hold a
  nearer row: the pairs are found by an equi-join on the cell before any
  vector is sent;
* a task meets a block's partners nearest first and stops when the rest is
  farther than all k-th distances found.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.rank import global_rank, rank_within
from quarry.session import work_path

#: pivots at most, and rows of a block
PIVOTS, BLOCK = 32, 1024
#: bytes of vectors that Spark hands a task at once
BATCH_BYTES = 16 << 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BLOCKS = "bid long, cell long, n long, theta double, lo array<double>, hi array<double>, ids binary, vectors binary"


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the shared folder, its rows handed to Python in batches bounded by bytes."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    path, before = work_path(spark, name), spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x from all of y (few), term by term."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in y], 1)


def _merged(best: tuple, x: np.ndarray, ids: np.ndarray, y: np.ndarray, other: np.ndarray, k: int) -> tuple:
    """``best`` (squared distances, ids; k a row, ties by id) with the rows of y."""
    have, names = best
    near = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T
    slack = 1e-9 * (1 + np.abs(near).max(initial=0) + (x * x).sum(1).max(initial=0) + (y * y).sum(1).max(initial=0))
    near[ids[:, None] == other] = np.inf
    most = have[:, -1]
    if near.shape[1] > k:
        most = np.minimum(most, np.partition(near, k - 1, 1)[:, k - 1] + slack)
    row, col = np.nonzero(near <= most[:, None] + slack)  # all that can be among the k, by the rounded product
    keep = np.isfinite(near[row, col])
    row, col = row[keep], col[keep]
    exact = np.concatenate([((x[row[i:i + 100_000]] - y[col[i:i + 100_000]]) ** 2).sum(1) for i in range(0, max(1, len(row)), 100_000)])
    n = len(x)
    old = np.isfinite(have)
    rows = np.concatenate([np.nonzero(old)[0], row])
    dist, name = np.concatenate([have[old], exact]), np.concatenate([names[old], other[col]])
    by = np.lexsort((name, dist, rows))
    rows, dist, name = rows[by], dist[by], name[by]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    first = place < k
    have, names = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
    have[rows[first], place[first]], names[rows[first], place[first]] = dist[first], name[first]
    return have, names


def _empty(n: int, k: int) -> tuple:
    return np.full((n, k), np.inf), np.full((n, k), -1, np.int64)


def _placer(pivots: np.ndarray):
    """(id, x, cell, dist): the nearest pivot, the first of equals."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column("x")), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(cell, pa.int64()), pa.array(d[np.arange(len(d)), cell])],
                                                 ["id", "x", "cell", "dist"])
    return run


def _describer(pivots: np.ndarray, k: int):
    """Blocks with their bounds, from (cell, bid, rows: array of (id, x))."""
    def run(batches):
        for batch in batches:
            out = []
            for cell, bid, rows in zip(batch.column("cell").to_pylist(), batch.column("bid").to_pylist(), batch.column("rows")):
                ids, x = rows.values.field("id").to_numpy(), _matrix(rows.values.field("x"))
                d = _distances(x, pivots)
                theta = float(np.sqrt(_merged(_empty(len(x), k), x, ids, x, ids, k)[0][:, -1].max()))
                out.append((bid, cell, len(x), theta, d.min(0).tolist(), d.max(0).tolist(), ids.tobytes(), x.tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(("bid", "cell", "n", "theta", "lo", "hi", "ids", "vectors"), r)) for r in out], pa.schema(
                [("bid", pa.int64()), ("cell", pa.int64()), ("n", pa.int64()), ("theta", pa.float64()), ("lo", pa.list_(pa.float64())),
                 ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("vectors", pa.binary())]))
    return run


def _asker(cells: list, k: int):
    """(bid, cell, theta, lo, hi) for every cell that may hold a nearer row than a
    block's k-th; cells are (cell, n, lo, hi) over all their blocks."""
    number, n = np.array([c[0] for c in cells]), np.array([c[1] for c in cells])
    low, high = (np.array([c[i] for c in cells]) for i in (2, 3))
    radius = high[np.arange(len(number)), number]

    def run(batches):
        for batch in batches:
            out = []
            for bid, theta, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("bid", "theta", "lo", "hi"))):
                lo, hi = np.array(lo), np.array(hi)
                reach = hi[number] + radius  # no row of the cell is farther than this
                by = np.argsort(reach)
                enough = np.searchsorted(np.cumsum(n[by]), k + 1)  # a row itself is one of them
                if enough < len(by):
                    theta = min(theta, reach[by[enough]])
                apart = np.maximum(low - hi, lo - high).max(1)
                out += [(bid, int(c), theta, lo.tolist(), hi.tolist()) for c in number[apart <= theta * (1 + 1e-9)]]
            yield pa.RecordBatch.from_pylist([dict(zip(("bid", "cell", "theta", "lo", "hi"), r)) for r in out], pa.schema(
                [("bid", pa.int64()), ("cell", pa.int64()), ("theta", pa.float64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]))
    return run


def _searcher(k: int):
    """The k nearest of each row of a block, from (bid, apart, ids, vectors) by
    block and distance, the block itself first."""
    def run(batches):
        def done():
            rank = np.broadcast_to(np.arange(1, k + 1), best[0].shape)
            some = best[1] >= 0
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], some.shape)[some]), pa.array(best[1][some]), pa.array(best[0][some]),
                                               pa.array(rank[some], pa.int32())], ["id", "nb", "dist2", "nb_rank"])

        block = None
        for batch in batches:
            for bid, apart, names, vectors in zip(*(batch.column(c) for c in ("bid", "apart", "ids", "vectors"))):
                other = np.frombuffer(names.as_py(), np.int64)
                y = np.frombuffer(vectors.as_py(), np.float64).reshape(len(other), -1)
                if bid.as_py() != block:
                    if block is not None:
                        yield done()
                    block, ids, x = bid.as_py(), other, y
                    best = _merged(_empty(len(ids), k), x, ids, x, ids, k)
                else:
                    near = best[0][:, -1] * (1 + 1e-9) >= apart.as_py() ** 2  # rows that may still find a nearer one
                    if near.any():
                        some = np.flatnonzero(near)
                        part = _merged((best[0][some], best[1][some]), x[some], ids[some], y, other, k)
                        best[0][some], best[1][some] = part
        if block is not None:
            yield done()
    return run


def nearest_neighbours(df: DataFrame, key: str, features: str, k: int, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(key, nb_key, nb_features, dist2, nb_rank): the ``k`` rows nearest to each
    row (all others, if fewer), by squared Euclidean distance, ties by key.

    Exact at every size; where the bounds rule nothing out (many random
    dimensions) the work is that of all pairs, in blocks.  Rows whose vector
    is NULL or holds a NULL or a number that is not finite take no part.  Rows
    of one key are different rows.
    """
    spark = df.sparkSession
    x = F.col(features).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(x) > 0)
    rows = global_rank(df.filter(fine).select(F.col(key).alias("key"), x.alias("x")), ["key", F.xxhash64("x")], "id")
    rows = _written(rows, "neighbour-rows")  # ids in the order of the keys
    out = "id long, nb long, dist2 double, nb_rank int"
    some = np.array([r["x"] for r in rows.orderBy(F.xxhash64("id")).limit(pivots).select("x").collect()], np.float64)
    if len(some):
        placed = rank_within(rows.select("id", "x").mapInArrow(_placer(some), "id long, x array<double>, cell long, dist double"), ["cell"], ["dist", "id"], "pos")
        bid = F.col("cell") * F.lit(1 << 40) + F.floor((F.col("pos") - 1) / F.lit(block))
        gathered = placed.groupBy("cell", bid.cast("long").alias("bid")).agg(F.collect_list(F.struct("id", "x")).alias("rows"))  # at most ``block`` rows
        blocks = _written(gathered.mapInArrow(_describer(some, k), _BLOCKS), "neighbour-blocks")
        m = range(len(some))
        cells = blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.min(F.col("lo")[i]) for i in m]).alias("lo"), F.array(*[F.max(F.col("hi")[i]) for i in m]).alias("hi"))
        known = [(r["cell"], r["n"], list(r["lo"]), list(r["hi"])) for r in cells.collect()]  # one row a pivot
        asked = blocks.select("bid", "theta", "lo", "hi").mapInArrow(_asker(known, k), "bid long, cell long, theta double, lo array<double>, hi array<double>")
        theirs = blocks.select("cell", F.col("bid").alias("other"), F.col("lo").alias("low"), F.col("hi").alias("high"))
        gaps = F.zip_with(F.zip_with("low", "hi", lambda a, b: a - b), F.zip_with("lo", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b))
        pairs = asked.join(theirs, "cell").withColumn("apart", F.greatest(F.lit(0.0), F.array_max(gaps) * (1 - 1e-9))).filter(
            (F.col("other") != F.col("bid")) & (F.col("apart") <= F.col("theta") * (1 + 1e-9))).select("bid", "other", "apart")
        sent = pairs.join(blocks.select(F.col("bid").alias("other"), "ids", "vectors"), "other").select("bid", "apart", "ids", "vectors")
        own = blocks.select("bid", F.lit(-1.0).alias("apart"), "ids", "vectors")
        found = _written(own.unionByName(sent).repartition("bid").sortWithinPartitions("bid", "apart").mapInArrow(_searcher(k), out), "neighbours")
    else:
        found = spark.createDataFrame([], out)
    one = rows.select(F.col("id").alias("_q_id"), F.col("key").alias("_q_key"))
    two = rows.select(F.col("id").alias("_q_nb"), F.col("key").alias("nb_key"), F.col("x").alias("nb_features"))
    pairs = found.withColumnsRenamed({"id": "_q_id", "nb": "_q_nb"}).join(one, "_q_id").join(two, "_q_nb")
    return pairs.select(F.col("_q_key").alias(key), "nb_key", "nb_features", "dist2", "nb_rank")


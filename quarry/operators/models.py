"""Model-building jobs on feature tables.

Estimators are Spark ML (distributed fitting); the glue around them -
scaling, bootstrap weights, feature choice - is built from Column
expressions so it stays in the JVM.
"""

from __future__ import annotations

import math
import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression)
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.expr import scalar_struct, unit_hash
from quarry.functions.rank import top_n_per_group
from quarry.functions.vectors import as_vector, dot, lit_array
from quarry.operators.newton import fit_logistic
from quarry.session import shuffle_files_dropped, small_batches, work_path


# task functions travel by value: workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def standardise(df: DataFrame, cols, kind: str = "zscore", suffix: str | None = None) -> DataFrame:
    """Z-score ((x - mean) / sample sd) or min-max ((x - min) / (max - min)).

    The statistics are one aggregate read back as a single scalar subquery
    (one pass over the input); no join.  A column of one value has no scale:
    NULL.
    """
    suffix = suffix or ("_z" if kind == "zscore" else "_mm")
    if kind == "zscore":
        st = scalar_struct(df.agg(*[F.avg(c).alias(f"a_{c}") for c in cols],
                                  *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]))
        exprs = {f"{c}{suffix}": F.try_divide(F.col(c) - st[f"a_{c}"], st[f"s_{c}"]) for c in cols}
    elif kind == "minmax":
        st = scalar_struct(df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols],
                                  *[F.max(c).alias(f"hi_{c}") for c in cols]))
        exprs = {f"{c}{suffix}": F.try_divide(F.col(c) - st[f"lo_{c}"], st[f"hi_{c}"] - st[f"lo_{c}"]) for c in cols}
    else:
        raise ValueError("kind must be 'zscore' or 'minmax'")
    return df.withColumns(exprs)


def _prep(df: DataFrame, features: str, y: str, positive) -> DataFrame:
    return df.withColumn("_q_y", (F.col(y) == F.lit(positive)).cast("double")).withColumn(
        "_q_v", as_vector(features))


def _finish(out: DataFrame) -> DataFrame:
    drop = [c for c in ("_q_v", "rawPrediction", "probability") if c in out.columns]
    return out.drop(*drop).withColumnRenamed("_q_y", "target")


def elastic_net(df: DataFrame, features: str, y: str, positive, alpha: float, lam: float, task: str = "classification"):
    """Logistic regression with the elastic-net penalty
    lam * (alpha * L1 + (1 - alpha) / 2 * L2); with ``task`` "regression",
    least squares of the number ``y`` (``positive`` unused) with the same
    penalty on the coefficients of the columns as they are.  Returns
    (df + prediction, model)."""
    if task == "regression":
        data = df.withColumn("_q_v", as_vector(features)).withColumn("_q_y", F.col(y).cast("double"))
        spread = data.agg(F.stddev_pop("_q_y")).first()[0] or 1.0
        # Spark divides the penalty by the label's spread; multiplied here, lam means what it says
        est = LinearRegression(featuresCol="_q_v", labelCol="_q_y", elasticNetParam=alpha, regParam=lam * spread if alpha == 0 else lam,
                               standardization=False, maxIter=100, solver="normal" if alpha == 0 else "auto")
        model = est.fit(data)
        return _finish(model.transform(data)), model
    data = _prep(df, features, y, positive)
    model = LogisticRegression(featuresCol="_q_v", labelCol="_q_y", elasticNetParam=alpha,
                               regParam=lam, maxIter=100).fit(data)
    return _finish(model.transform(data)), model


def feature_subset_indices(n_features: int, share: float, seed: str) -> list[int]:
    """The features kept by ``feature_subset``: the round(share * d) indices
    with the smallest md5(seed || index), ties by index (a d-sized list,
    computed on the driver; DuckDB reproduces it with the same rule)."""
    import hashlib
    m = max(1, int(round(share * n_features)))
    keyed = sorted(range(n_features), key=lambda j: (hashlib.md5(f"{seed}{j}".encode()).hexdigest(), j))
    return sorted(keyed[:m])


def feature_subset(df: DataFrame, features: str, share: float, seed: str, out_col: str | None = None):
    """A seeded sample of the features (the same seed keeps the same
    set).  Returns (df with the sliced array, chosen indices)."""
    dim = len(df.select(features).first()[0])
    idx = feature_subset_indices(dim, share, seed)
    sliced = F.array(*[F.col(features)[i] for i in idx])
    return df.withColumn(out_col or features, sliced), idx


def shallow_tree(df: DataFrame, features: str, y: str, positive, max_depth: int = 3,
                 min_instances: int = 1, max_bins: int = 64):
    """A decision tree bounded in depth.  Returns (df + prediction, model)."""
    data = _prep(df, features, y, positive)
    model = DecisionTreeClassifier(featuresCol="_q_v", labelCol="_q_y", maxDepth=max_depth,
                                   minInstancesPerNode=min_instances, maxBins=max_bins, seed=1).fit(data)
    return _finish(model.transform(data)), model


# P(N <= n) for Poisson(1), n = 0 to 12 (a rule: sum e^-1 / k!); the hash has 32 bits, and beyond 12
# lies less than 2^-32, so no value of it is cut off
_POISSON1_CDF = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(13)])


def bootstrap_weight(salt: str, *cols) -> Column:
    """Poisson(1) bootstrap count of a row from a hash of ``cols``: the
    distributed bootstrap (no resampled copy of the data is built)."""
    u = unit_hash(salt, *cols)
    return sum(((u >= F.lit(float(edge))).cast("double") for edge in _POISSON1_CDF), F.lit(0.0))


def bagging_mixed(df: DataFrame, features: str, y: str, positive, key: str, seed: int = 17,
                  models=("logistic", "tree", "svm")) -> DataFrame:
    """Bag different kinds of model: each sees its own Poisson bootstrap
    (as row weights), and the final call is the majority vote.
    Returns df + (one column per model, votes, prediction)."""
    data = _prep(df, features, y, positive)
    out = data
    names = []
    for i, kind in enumerate(models):
        w = f"_q_w{i}"
        train = data.withColumn(w, bootstrap_weight(f"{seed}.{i}.", F.col(key)))
        name = f"pred_{kind}"
        names.append(name)
        if kind == "logistic":
            out = out.withColumn(name, fit_logistic(train, features, "_q_y", w, reg=0.01).prediction(features))
            continue
        if kind == "tree":
            est = DecisionTreeClassifier(featuresCol="_q_v", labelCol="_q_y", weightCol=w, maxDepth=5, seed=seed)
        elif kind == "svm":
            est = LinearSVC(featuresCol="_q_v", labelCol="_q_y", weightCol=w, regParam=0.01)
        else:
            raise ValueError(kind)
        model = est.fit(train)
        model.setPredictionCol(name)
        model.setRawPredictionCol(f"_q_raw{i}")
        if hasattr(model, "setProbabilityCol"):
            model.setProbabilityCol(f"_q_prob{i}")
        out = model.transform(out)
        out = out.drop(*[c for c in (f"_q_raw{i}", f"_q_prob{i}") if c in out.columns])
    votes = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    out = out.withColumn("votes", votes).withColumn(
        "prediction", (F.col("votes") > F.lit(len(names) / 2.0)).cast("double"))
    return _finish(out)


def early_stopping(df: DataFrame, features: str, y: str, positive, is_validation: Column,
                   max_iter: int = 20, tol: float = 0.01, seed: int = 3):
    """Gradient-boosted trees that stop adding trees once the loss on
    the validation rows stops improving by ``tol``.  Returns
    (df + prediction + n_trees, model)."""
    data = _prep(df, features, y, positive).withColumn("_q_val", is_validation.cast("boolean"))
    model = GBTClassifier(featuresCol="_q_v", labelCol="_q_y", maxIter=max_iter, maxDepth=3,
                          validationIndicatorCol="_q_val", validationTol=tol, seed=seed).fit(data)
    out = _finish(model.transform(data)).drop("_q_val")
    return out.withColumn("n_trees", F.lit(model.getNumTrees)), model


def pca(df: DataFrame, features: str, k: int):
    """The first k principal components of the feature vectors.

    The covariance matrix is aggregated on the executors (standard deviations
    and correlations); only its d x d numbers reach the driver, which takes
    the eigenvectors.  Rows are projected as they are, not centred.  Returns
    (df + components array, model) with the model's ``pc`` (d x k),
    ``explainedVariance`` and ``covariance``.
    """
    data = df.withColumn("_q_v", as_vector(features))
    std = np.nan_to_num(data.select(Summarizer.std(F.col("_q_v"))).first()[0].toArray())
    corr = np.nan_to_num(Correlation.corr(data, "_q_v").first()[0].toArray())
    np.fill_diagonal(corr, 1.0)
    covariance = corr * np.outer(std, std)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:k]
    pc = vectors[:, order]
    x = F.col(features).cast("array<double>")
    out = df.withColumn("components", F.array(*[dot(x, lit_array(c)) for c in pc.T]))
    total = float(values.sum()) or 1.0
    return out, SimpleNamespace(pc=pc, explainedVariance=values[order] / total, covariance=covariance)


#: ratings of a block of ALS, which a task holds several times over while it builds the block
BLOCK_RATINGS = 4_000_000


def als_blocks(ratings: int) -> int:
    """How many blocks ALS deals users and items to: Spark's 10 until they are
    full, then as many as the ratings need.  Ids go to blocks by their remainder, so
    the number has no small divisor: ids in steps would leave blocks empty."""
    blocks = max(10, -(-ratings // BLOCK_RATINGS))
    while blocks > 10 and any(blocks % p == 0 for p in (2, 3, 5, 7)):
        blocks += 1
    return blocks


def als_recommend(interactions: DataFrame, user: str, item: str, rating: str, top_n: int = 5,
                  seed: int = 1, rank: int = 8, max_iter: int = 10) -> DataFrame:
    """Matrix factorisation (ALS, blocked on the executors) and the
    ``top_n`` items per user, found exactly without scoring every
    (user, item) pair (see ``top_items``).

    ALS needs int ids.  Ids that already fit are used as they are; larger
    ones are numbered by a distributed dense index (global sort), never a
    driver-side label list.  Ratings are summed per (user, item) first.
    Blocks grow in number, not in size (``als_blocks``), and stay on disk between
    iterations; the factors are checkpointed every iteration, which lets the
    shuffle files of the last one go.  Returns (user, item, score, rank).
    """
    from quarry.operators.business import dense_index
    # ratings per (user, item), written once
    with shuffle_files_dropped(interactions.sparkSession):
        r = _stored(interactions.groupBy(user, item).agg(F.sum(rating).alias("_q_r")), "ratings")
    rng = r.agg(F.min(user), F.max(user), F.min(item), F.max(item), F.count(F.lit(1))).first()
    int_max = 2 ** 31 - 1
    if rng[0] is not None and rng[0] >= 0 and rng[1] <= int_max:
        ui = None
        r = r.withColumn("_q_u", F.col(user).cast("int"))
    else:  # ids beyond int: number them by a distributed sort
        ui = dense_index(r, user, "_q_u")
        r = r.join(ui, user)
    if rng[2] is not None and rng[2] >= 0 and rng[3] <= int_max:
        ii = None
        r = r.withColumn("_q_i", F.col(item).cast("int"))
    else:
        ii = dense_index(r, item, "_q_i")
        r = r.join(ii, item)
    data = r.select("_q_u", "_q_i", "_q_r")
    blocks = als_blocks(rng[4])
    model = ALS(userCol="_q_u", itemCol="_q_i", ratingCol="_q_r", rank=rank, maxIter=max_iter,
                seed=seed, coldStartStrategy="drop", nonnegative=True, numUserBlocks=blocks, numItemBlocks=blocks,
                intermediateStorageLevel="DISK_ONLY", checkpointInterval=1).fit(data)
    recs = top_items(model.userFactors, model.itemFactors, top_n)
    recs = recs.select(F.col("user").alias("_q_u"), F.col("item").alias("_q_i"), "score", "rank")
    recs = recs.join(ui, "_q_u") if ui is not None else recs.withColumn(user, F.col("_q_u").cast("long"))
    recs = recs.join(ii, "_q_i") if ii is not None else recs.withColumn(item, F.col("_q_i").cast("long"))
    return recs.select(user, item, "score", "rank")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, worked out once."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


USERS = "part long, ids binary, vecs binary, least binary, stretches array<long>"
ITEMS = "stretch long, ids binary, vecs binary, norm double"
#: scores that a task works out at once, and (user block, item stretch) pairs from which several blocks share a copy of the items
SCORES, FEW_PAIRS = 1 << 20, 512


def _reach(u: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How long an item must be to score ``least`` with each user."""
    size = np.linalg.norm(u, axis=1)
    return np.where(least > 0, np.divide(least, size, out=np.zeros(len(u)), where=size > 0), 0.0)


def _pilot_bounds(pilot: np.ndarray, top_n: int):
    """Each user's ``top_n``-th best score among the pilot items, and how
    long an item must be to beat it."""
    rows = max(1, SCORES // max(1, len(pilot)))

    def run(batches):
        for batch in batches:
            u = np.stack(batch.column("u").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, pilot.shape[1]))
            least = np.full(len(u), -np.inf)
            if len(pilot) >= top_n:
                for k in range(0, len(u), rows):  # bounded temporaries
                    score = u[k:k + rows] @ pilot.T
                    score.partition(len(pilot) - top_n, axis=1)
                    least[k:k + rows] = score[:, -top_n]
            least -= 1e-9 * np.abs(np.where(np.isfinite(least), least, 0.0))  # rounding of another product
            yield pa.RecordBatch.from_arrays([batch.column("user"), batch.column("u"), pa.array(least), pa.array(_reach(u, least))], ["user", "u", "least", "reach"])
    return run


def _user_blocks(block: int, stretches: np.ndarray, norms: np.ndarray, kind: str):
    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId()
        for batch in batches:
            for k in range(0, batch.num_rows, block):
                part = batch.slice(k, block)
                least, reach = (part.column(c).to_numpy() for c in ("least", "reach"))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part.column("user").to_numpy().tobytes()], pa.binary()),
                                                  pa.array([np.stack(part.column("u").to_numpy(zero_copy_only=False)).astype(kind).tobytes()], pa.binary()),
                                                  pa.array([least.tobytes()], pa.binary()),
                                                  pa.array([stretches[norms >= reach.min()]], pa.list_(pa.int64()))],
                                                 ["part", "ids", "vecs", "least", "stretches"])
    return run


def _item_stretches(stretch: int, kind: str):
    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, batch.num_rows, stretch):
                part = batch.slice(k, stretch)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part.column("item").to_numpy().tobytes()], pa.binary()),
                                                  pa.array([np.stack(part.column("v").to_numpy(zero_copy_only=False)).astype(kind).tobytes()], pa.binary()),
                                                  pa.array([float(part.column("norm").to_numpy().max())])], ["stretch", "ids", "vecs", "norm"])
                number += 1
    return run


def _block_scorer(top_n: int, user_kind: str, item_kind: str):
    """The best ``top_n`` of each pair of block and stretch; a task holds one
    pair and ``SCORES`` scores at once."""
    def scored(users, u, least, items, v):
        norms = np.linalg.norm(v, axis=1)  # falling
        k = 0
        while k < len(u):
            rows = max(1, SCORES // max(1, len(v)))
            low = _reach(u[k:k + rows], least[k:k + rows]).min() * (1 - 1e-9)
            far = int(np.searchsorted(-norms, -low, side="right"))  # longer ones only
            score = u[k:k + rows] @ v[:far].T
            at, j = np.nonzero(score >= least[k:k + rows, None])
            value = score[at, j]
            order = np.lexsort((items[j], -value, at))
            good = order[np.arange(len(at)) - np.searchsorted(at, at) < top_n]  # ``at`` rises already
            yield users[k + at[good]], items[j[good]], value[good]
            k += rows

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                held = {c: batch.column(c)[r].as_buffer() for c in ("ids", "vecs", "least", "i_ids", "i_vecs")}
                users, items, least = (np.frombuffer(held[c], t) for c, t in (("ids", np.int64), ("i_ids", np.int64), ("least", np.float64)))
                u, v = (np.frombuffer(held[c], t).reshape(n, -1).astype(np.float64) for c, t, n in (("vecs", user_kind, len(users)), ("i_vecs", item_kind, len(items))))
                parts = [*scored(users, u, least, items, v)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["user", "item", "score"])
    return run


def top_items(users: DataFrame, items: DataFrame, top_n: int, stretch: int = 8192, block: int = 2048, pilot: int = 2048) -> DataFrame:
    """Exact top ``top_n`` items per user by dot product of factors, without
    scoring every (user, item) pair.

    A score is at most |u| |v|.  The ``pilot`` longest items give each user a
    first bound, and with it the least length an item must have to beat it.
    Items are range-sorted by length and packed in stretches, users in
    blocks of like reach; a block meets only the stretches with items that
    are long enough, and scores them as matrix products of bounded size.  The
    longest items are met by every block: each part, some blocks of like reach,
    gets its own copy of the stretches it meets, so that no task has them
    all.  The result equals scoring all items.  ``users``/``items`` are (id, features), ids
    whole numbers; returns (user, item, score, rank).
    """
    spark = users.sparkSession
    kinds = ["<f4" if d.schema["features"].dataType.simpleString() == "array<float>" else "<f8" for d in (users, items)]  # as they came
    it = items.select(F.col("id").cast("long").alias("item"), F.col("features").cast("array<double>").alias("v"))
    it = it.withColumn("norm", F.sqrt(dot("v", "v")))
    longest = it.orderBy(F.desc("norm"), "item").limit(pilot).select("v").collect()  # a fixed number of items
    if not longest:
        return spark.createDataFrame([], "user long, item long, score double, rank long")
    n = it.count()
    path = work_path(spark, "item-stretches")
    (it.repartitionByRange(max(1, -(-n // stretch)), F.desc("norm"), F.col("item")).sortWithinPartitions(F.desc("norm"), "item")
     .mapInArrow(_item_stretches(stretch, kinds[1]), ITEMS).write.parquet(path))
    packed = spark.read.parquet(path)
    sizes = packed.select("stretch", "norm").collect()  # two numbers for each ``stretch`` items
    lengths = np.array([r[0] for r in sizes]), np.array([r[1] for r in sizes])
    u = users.select(F.col("id").cast("long").alias("user"), F.col("features").cast("array<double>").alias("u"))
    bounded = _stored(u.mapInArrow(_pilot_bounds(np.array([r[0] for r in longest]), top_n), "user long, u array<double>, least double, reach double"), "user-bounds")
    n_blocks = -(-bounded.count() // block)
    share = min(8, max(1, n_blocks * len(sizes) // FEW_PAIRS))  # blocks of a part
    blocks = _stored(bounded.repartitionByRange(max(1, -(-n_blocks // share)), "reach", "user").sortWithinPartitions("reach")
                     .mapInArrow(_user_blocks(block, *lengths, kinds[0]), USERS), "user-blocks")
    sent = blocks.withColumn("stretch", F.explode("stretches")).drop("stretches")
    met = sent.select("stretch", "part").distinct()
    copies = packed.select("stretch", F.col("ids").alias("i_ids"), F.col("vecs").alias("i_vecs")).join(F.broadcast(met), "stretch")
    pairs = sent.join(copies.hint("shuffle_merge"), ["stretch", "part"])
    best = pairs.mapInArrow(_block_scorer(top_n, *kinds), "user long, item long, score double")
    with small_batches(spark), shuffle_files_dropped(spark):  # a pair is some 400 KB
        return _stored(top_n_per_group(best, ["user"], [F.col("score").desc(), F.col("item")], top_n), "top-items")

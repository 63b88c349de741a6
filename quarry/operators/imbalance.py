"""Imbalanced samples.

Sampling is deterministic: rows are ordered by a hash of (seed, key), so the
same seed keeps the same rows on any cluster, and DuckDB reproduces it.
Model fitting uses Spark ML estimators (distributed per iteration); the
logistic members of the ensembles are fitted by Newton's method.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LinearSVC
from pyspark.ml.clustering import KMeans
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.expr import materialize_small, stable_hash
from quarry.functions.joins import bounded_broadcast, join_on_keys
from quarry.functions.rank import global_rank, rank_within
from quarry.operators.mixture import fit_mixture
from quarry.operators.models import pca
from quarry.operators.neighbours import nearest_neighbours
from quarry.operators.newton import LogisticModel, fit_logistic
from quarry.operators.stats import exact_quantile
from quarry.functions.vectors import as_vector, dot, lit_array, sq_dist, unit_from_hash

# what tasks call goes with them: workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def class_balance(df: DataFrame, y: str) -> DataFrame:
    """G1: rows and frequency p(y) of each class.  Returns (y, n, p)."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    # one row per class: the window spans the (small) class table only
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def inverse_freq_weight(df: DataFrame, y: str, weight_col: str = "weight") -> DataFrame:
    """weight = 1 / p(y), so each class carries the same total weight in
    a loss.  The class table is broadcast behind a size check."""
    cb = class_balance(df, y).select(F.col(y).alias("_q_cls"), (1.0 / F.col("p")).alias(weight_col))
    cb = bounded_broadcast(cb)
    return df.join(cb, F.col(y).eqNullSafe(F.col("_q_cls"))).drop("_q_cls")


def threshold_move(df: DataFrame, score: str, t: float = 0.2, pred_col: str = "pred") -> DataFrame:
    """Call a row positive when its score exceeds ``t`` (not 0.5)."""
    return df.withColumn(pred_col, (F.col(score) > F.lit(t)).cast("int"))


def minority_label(df: DataFrame, y: str):
    """The least frequent class (ties: the smallest label)."""
    row = df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).orderBy("n", y).first()
    return row[0], row[1]


def undersample(df: DataFrame, y: str, key: str, seed: str, batch: str | None = None,
                ratio: float = 1.0, margin_sd: float = 6.0) -> DataFrame:
    """Keep every row of the smallest class and, from each other class,
    ``ratio`` x that many rows - per batch when ``batch`` is given.

    Rows are taken in ``md5(seed || key)`` order (ties by key).  The hash is
    uniform, so a class that keeps k of its n rows first keeps only rows
    whose hash lies below a threshold set 6 standard deviations above the
    expected k-th value (about k + 6 sqrt(k) rows); the count is checked and
    a class that came up short takes all its rows.  Only these candidates
    are ranked (one global sort), so the rest of a large class is never
    sorted.  Returns the kept rows.
    """
    groups = [y] + ([batch] if batch else [])
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_q_n"))
    if batch:
        keep = sizes.groupBy(batch).agg(F.min("_q_n").alias("_q_keep"))
        sizes = join_on_keys(sizes, keep, [batch])
    else:
        sizes = sizes.withColumn("_q_keep", F.min("_q_n").over(Window.partitionBy()))
    sizes = sizes.withColumn(
        "_q_keep", F.when(F.col("_q_n") == F.col("_q_keep"), F.col("_q_n"))
        .otherwise(F.floor(F.col("_q_keep") * F.lit(ratio))))
    span = float(2 ** 32)
    n, k = F.col("_q_n").cast("double"), F.col("_q_keep").cast("double")
    cut = F.least(F.lit(span), F.greatest(F.lit(0.0), F.ceil(
        (k + F.lit(margin_sd) * F.sqrt(k) + F.lit(1.0)) / n * F.lit(span))))
    sizes = sizes.withColumn("_q_t", F.when(F.col("_q_keep") >= F.col("_q_n"), F.lit(span)).otherwise(cut))
    sizes = materialize_small(sizes)  # one row per (class, batch)
    # a NULL key hashes like any other value
    hashed = df.withColumn("_q_h", stable_hash(seed, F.coalesce(F.col(key).cast("string"), F.lit("\x00"))))
    cand = join_on_keys(hashed, bounded_broadcast(sizes), groups).filter(
        F.col("_q_h") < F.col("_q_t"))
    short = join_on_keys(sizes, cand.groupBy(*groups).agg(F.count(F.lit(1)).alias("_q_c")), groups, "left")
    short = short.filter(F.coalesce(F.col("_q_c"), F.lit(0)) < F.col("_q_keep")).select(*groups)
    if not short.isEmpty():  # rare: those classes take every row
        fixed = join_on_keys(sizes, short.withColumn("_q_short", F.lit(True)), groups, "left").withColumn(
            "_q_t", F.when(F.col("_q_short"), F.lit(span)).otherwise(F.col("_q_t"))).drop("_q_short")
        sizes = materialize_small(fixed)
        cand = join_on_keys(hashed, bounded_broadcast(sizes), groups).filter(
            F.col("_q_h") < F.col("_q_t"))
    ranked = rank_within(cand.drop("_q_n", "_q_t"), groups, ["_q_h", key], "_q_rk")
    return ranked.filter(F.col("_q_rk") <= F.col("_q_keep")).drop("_q_h", "_q_rk", "_q_keep")


def oversample_copies(df: DataFrame, y: str, minority, copies: int, copy_col: str = "copy") -> DataFrame:
    """Repeat each minority row ``copies`` times (``copy`` = 1..L); the
    other rows once.  Equivalent to weight L on the minority in a loss."""
    n = F.when(F.col(y) == F.lit(minority), F.lit(copies)).otherwise(F.lit(1))
    return df.withColumn(copy_col, F.explode(F.sequence(F.lit(1), n)))


# ------------------------------------------------------------------ G6 SMOTE


def near_neighbours(df: DataFrame, key: str, features: str, k: int) -> DataFrame:
    """The ``k`` nearest other rows of every row, exactly; (key, nb_key,
    nb_features, dist2, nb_rank), see ``neighbours.nearest_neighbours``."""
    return nearest_neighbours(df, key, features, k)


def smote(df: DataFrame, key: str, features: str, y: str, minority, k: int, per_row: int,
          seed: int = 11) -> DataFrame:
    """Synthetic minority rows between a row and one of its nearest neighbours.

    For minority row x, copy c in 1..per_row: neighbour nb = one of its k
    nearest neighbours (chosen by hash of (seed, key, c)); attribute j becomes
    x_j + u_j (nb_j - x_j) with u_j in [0, 1) from a hash of
    (seed, key, c, j) - each attribute moved on its own.  Returns
    (key, copy, features, y) for the new rows only.
    """
    mino = df.filter(F.col(y) == F.lit(minority)).select(key, F.col(features).cast("array<double>").alias(features))
    nbs = near_neighbours(mino, key, features, k)
    # a row without a neighbour (a minority of one) is its own: its copies are the row itself
    alone = mino.join(nbs.select(key), key, "left_anti").select(key, F.col(key).alias("nb_key"), F.col(features).alias("nb_features"),
                                                                F.lit(0.0).alias("dist2"), F.lit(1).alias("nb_rank"))
    nbs = nbs.unionByName(alone)
    n_nb = nbs.groupBy(key).agg(F.count(F.lit(1)).alias("_q_nn"))
    copies = mino.join(n_nb, key).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(per_row))))
    pick = (F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("copy")), F.col("_q_nn")) + 1)
    copies = copies.withColumn("nb_rank", pick.cast("int"))
    joined = copies.join(nbs.select(key, "nb_rank", "nb_features"), [key, "nb_rank"])
    moved = F.transform(
        F.arrays_zip(F.col(features).alias("x"), F.col("nb_features").alias("n")),
        lambda e, j: e["x"] + unit_from_hash(F.lit(seed), F.col(key), F.col("copy"), j) * (e["n"] - e["x"]))
    return joined.select(key, "copy", moved.alias(features), F.lit(minority).alias(y))


# ------------------------------------------------------------------ G7 cluster undersampling


def _allocate(sizes: DataFrame, total: int, n: int) -> DataFrame:
    """Split ``total`` centres over groups (``_q_b``, ``_q_n`` rows) in
    proportion to their rows, by largest remainder, so the shares add up to
    exactly ``total`` and none is larger than its group.  Runs in Spark on
    the group table (one row per group); returns (_q_b, _q_k)."""
    total = min(total, n)
    exact = F.col("_q_n") * F.lit(total) / F.lit(n)
    base = sizes.withColumn("_q_floor", F.floor(exact).cast("long")).withColumn(
        "_q_frac", exact - F.floor(exact))
    rest = base.agg(F.lit(total) - F.sum("_q_floor")).scalar()
    ranked = global_rank(base, [F.col("_q_frac").desc(), F.col("_q_b")], "_q_r")
    extra = F.when(F.col("_q_r") <= rest, F.lit(1)).otherwise(F.lit(0))
    return ranked.select("_q_b", (F.col("_q_floor") + extra).cast("int").alias("_q_k"))


#: rows of a cell that one task clusters at most, and steps of Lloyd's method at most
CELL_ROWS, LLOYD_STEPS = 1 << 16, 50


def _spread_start(x: np.ndarray, k: int, rng) -> np.ndarray:
    """k rows of x, each next one by its squared distance from those before."""
    first = int(rng.integers(len(x)))
    chosen, near = [first], ((x - x[first]) ** 2).sum(1)
    for _ in range(k - 1):
        total = near.sum()
        if total > 0:
            at = min(int(np.searchsorted(np.cumsum(near), rng.random() * total, "right")), len(x) - 1)
        else:  # fewer distinct rows than centres
            at = len(chosen)
        chosen.append(at)
        near = np.minimum(near, ((x - x[at]) ** 2).sum(1))
    return x[chosen]


def _two_nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centre, distance from it, distance from the second)."""
    out = np.empty(len(x), np.int64), np.empty(len(x)), np.full(len(x), np.inf)
    square = (centres * centres).sum(1)
    for i in range(0, len(x), 4096):
        part = x[i:i + 4096]
        d = np.maximum((part * part).sum(1)[:, None] + square - 2 * part @ centres.T, 0)
        at = d.argmin(1)
        rows = np.arange(len(part))
        out[0][i:i + 4096], out[1][i:i + 4096] = at, np.sqrt(d[rows, at])
        if len(centres) > 1:
            d[rows, at] = np.inf
            out[2][i:i + 4096] = np.sqrt(d.min(1))
    return out


def _lloyd(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means centres of x.  Hamerly's bounds leave out rows whose centre
    cannot have changed; a centre without rows stays where it is."""
    centres = _spread_start(x, k, np.random.default_rng(seed))
    if k >= len(x):
        return centres
    at, near, far = _two_nearest(x, centres)
    for _ in range(LLOYD_STEPS):
        count = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        some = np.flatnonzero(count)
        moved = centres.copy()
        moved[some] = np.add.reduceat(x[order], np.cumsum(count[some]) - count[some]) / count[some, None]
        step = np.sqrt(((moved - centres) ** 2).sum(1))
        centres = moved
        if step.max() <= 1e-9 * (1 + np.abs(centres).max()):
            break
        near, far = near + step[at], far - step.max()
        check = np.flatnonzero(near > far)
        near[check] = np.sqrt(((x[check] - centres[at[check]]) ** 2).sum(1))
        check = check[near[check] > far[check]]
        at[check], near[check], far[check] = _two_nearest(x[check], centres)
    return centres


def _cell_centres(seed: int):
    """The centres of one cell: (y, features), ``_q_k`` of them."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_q_r").combine_chunks()
        x = rows.column("_q_x").combine_chunks()
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        k = int(rows.column("_q_k")[0].as_py())
        centres = _lloyd(x, k, seed)
        return pa.table({"y": rows.column("_q_y").take(pa.array([0] * k)), "features": pa.array(list(centres), pa.list_(pa.float64()))})
    return run


def cluster_undersample(df: DataFrame, key: str, features: str, y: str, seed: int = 5) -> DataFrame:
    """Replace the majority rows by N cluster centres, N = minority size,
    and keep every minority row.

    Two levels of k-means, the same at every size.  Spark ML KMeans parts the
    majority in about sqrt(N) clusters; a (class, cluster) cell of more than
    ``CELL_ROWS`` rows is ordered along a direction of its own (from its cluster's centre to the
    next one) and cut into equal slices.  Each cell gets its share of the N
    centres, which a task finds by Lloyd's method with Hamerly's bounds from a
    spread start, so neither N nor a hot cluster is ever in one place.  All
    classes other than the smallest share the N centres by their rows; a
    NULL class is a class.  Returns (key, features, y, kind) with kind
    'centre' or 'original'; a centre's key is NULL.
    """
    mino_label, n_min = minority_label(df, y)
    base = df.select(key, F.col(features).cast("array<double>").alias(features), y)
    is_minority = F.col(y).eqNullSafe(F.lit(mino_label))
    minority = base.filter(is_minority).withColumn("kind", F.lit("original"))
    majority = base.filter(~is_minority)
    n_maj = majority.count()
    if not n_maj:
        return minority
    parts = math.isqrt(max(0, int(n_min) - 1)) + 1
    if parts > 1:
        model = KMeans(k=parts, seed=seed, featuresCol="_q_v", predictionCol="_q_c", maxIter=30).fit(majority.select(as_vector(features).alias("_q_v")))
        centres = [c.tolist() for c in model.clusterCenters()]  # about sqrt(N) of them
        ways = [(np.array(centres[(i + 1) % len(centres)]) - np.array(c)) for i, c in enumerate(centres)]
        placed = model.transform(majority.withColumn("_q_v", as_vector(features))).drop("_q_v")
        along = dot(F.col(features), F.element_at(F.array(*[lit_array(w) for w in ways]), F.col("_q_c") + 1))
    else:
        placed, along = majority.withColumn("_q_c", F.lit(0)), F.element_at(features, 1)
    placed = placed.withColumn("_q_cell", F.struct(F.col(y).alias("y"), F.col("_q_c").alias("c"))).withColumn("_q_a", along)
    whole = materialize_small(placed.groupBy("_q_cell").agg(F.count(F.lit(1)).alias("_q_m")))
    ranked = rank_within(placed.join(bounded_broadcast(whole), "_q_cell"), ["_q_cell"], ["_q_a", F.col(key)], "_q_r")
    slices = F.ceil(F.col("_q_m") / CELL_ROWS)
    cut = ranked.select(F.struct("_q_cell.y", "_q_cell.c", F.floor((F.col("_q_r") - 1) * slices / F.col("_q_m")).alias("s")).alias("_q_b"),
                        "_q_r", F.col(features).alias("_q_x"), F.col(y).alias("_q_y"))
    alloc = materialize_small(cut.groupBy("_q_b").agg(F.count(F.lit(1)).alias("_q_n")))
    shares = materialize_small(_allocate(alloc, int(n_min), n_maj).filter(F.col("_q_k") > 0))
    kind = df.schema[y].dataType.simpleString()
    found = cut.join(bounded_broadcast(shares), "_q_b").groupBy("_q_b").applyInArrow(_cell_centres(seed), f"y {kind}, features array<double>")
    centres = found.select(F.lit(None).cast(dict(df.dtypes)[key]).alias(key), F.col("features").alias(features), F.col("y").alias(y), F.lit("centre").alias("kind"))
    return minority.unionByName(centres)


# ------------------------------------------------------------------ G8, G9 penalised models


def penalised_svm(df: DataFrame, features: str, y: str, positive, reg: float = 0.01,
                  weighted: bool = True, max_iter: int = 50) -> DataFrame:
    """Linear SVM whose loss charges each class by 1 / p(class), so
    errors on the rare class cost more.  Returns df + prediction (0/1)."""
    data = df.withColumn("_q_y", (F.col(y) == F.lit(positive)).cast("double")).withColumn(
        "_q_v", as_vector(features))
    if weighted:
        data = inverse_freq_weight(data, "_q_y", "_q_w")
    svc = LinearSVC(featuresCol="_q_v", labelCol="_q_y", regParam=reg, maxIter=max_iter)
    if weighted:
        svc.setWeightCol("_q_w")
    model = svc.fit(data)
    out = model.setPredictionCol("prediction").transform(data)
    return out.drop("_q_v", "_q_w", "rawPrediction").withColumnRenamed("_q_y", "target")


def penalised_lda(df: DataFrame, features: str, y: str, positive, costs=None) -> DataFrame:
    """Two-class linear discriminant with misclassification costs.

    Class means and counts come from ``Summarizer``; the pooled covariance
    from each class's ``Correlation`` matrix and standard deviations (both
    tree-aggregated on the executors).  Only d x d numbers reach the driver,
    where w = S^-1 (mu1 - mu0) is solved.  A row is positive when
    w.x > w.(mu1 + mu0)/2 - ln(pi1 c1 / (pi0 c0)); by default the costs are
    1 / p(class), which makes the prior term vanish.
    Returns df + (score, prediction).
    """
    data = df.withColumn("_q_y", (F.col(y) == F.lit(positive)).cast("int")).withColumn(
        "_q_v", as_vector(features))
    stats, covs = {}, {}
    for cls in (0, 1):
        part = data.filter(F.col("_q_y") == cls)
        s = part.select(Summarizer.metrics("mean", "std", "count").summary(F.col("_q_v")).alias("s")).first()["s"]
        std = np.nan_to_num(s["std"].toArray())
        if int(s["count"]) < 2:  # a one-row class has no spread (and no correlation)
            covs[cls] = np.zeros((len(std), len(std)))
        else:
            corr = np.nan_to_num(Correlation.corr(part, "_q_v").first()[0].toArray())
            np.fill_diagonal(corr, 1.0)
            covs[cls] = corr * np.outer(std, std)
        stats[cls] = (s["mean"].toArray(), int(s["count"]))
    (m0, n0), (m1, n1) = stats[0], stats[1]
    pooled = ((n0 - 1) * covs[0] + (n1 - 1) * covs[1]) / max(n0 + n1 - 2, 1)
    pooled = pooled + np.eye(len(m0)) * 1e-9 * max(np.trace(pooled), 1.0)
    w = np.linalg.solve(pooled, m1 - m0)
    p0, p1 = n0 / (n0 + n1), n1 / (n0 + n1)
    c0, c1 = costs if costs else (1.0 / p0, 1.0 / p1)
    cut = float(w @ (m1 + m0) / 2.0 - math.log((p1 * c1) / (p0 * c0)))
    score = dot(F.col(features).cast("array<double>"), lit_array(w))
    return data.drop("_q_v", "_q_y").withColumn("score", score - F.lit(cut)).withColumn(
        "prediction", (F.col("score") > 0).cast("double"))


# ------------------------------------------------------------------ G10-G12 ensembles


def _member(data: DataFrame, features: str) -> LogisticModel:
    """A logistic member: Newton's method on ``_q_y``."""
    return fit_logistic(data, features, "_q_y", reg=0.01)


def divide_conquer_ensemble(df: DataFrame, features: str, y: str, positive, n_models: int = 3,
                            seed: int = 3, value: str | None = None, split: Column | None = None) -> DataFrame:
    """Split the majority into L clusters; model l sees cluster l plus
    every minority row; the final call is the majority vote (sum > L/2; a
    tie is 0).  ``split`` numbers the majority's rows 0 to L - 1 in place of
    the clusters; a row with another number, or NULL, is in no member's
    sample.  Returns df + (votes, prediction).

    With ``value`` the task is regression: model l is a linear regression of
    that column and the prediction is the mean of the models'; ``votes`` is
    then their sum."""
    data = df.withColumn("_q_y", (F.col(y) == F.lit(positive)).cast("double")).withColumn(
        "_q_v", as_vector(features))
    majority = data.filter(F.col("_q_y") == 0)
    if split is None:
        clustered = KMeans(k=n_models, seed=seed, featuresCol="_q_v", predictionCol="_q_c").fit(majority).transform(majority)
    else:
        clustered = majority.withColumn("_q_c", split)
    minority = data.filter(F.col("_q_y") == 1)
    out = data
    votes = None
    for l in range(n_models):
        train = clustered.filter(F.col("_q_c") == l).drop("_q_c").unionByName(minority)
        if value is None:
            out = out.withColumn(f"_q_m{l}", _member(train, features).prediction(features))
        else:
            model = LinearRegression(featuresCol="_q_v", labelCol=value, regParam=0.01, elasticNetParam=0.0).fit(train)
            out = model.setPredictionCol(f"_q_m{l}").transform(out)
        votes = F.col(f"_q_m{l}") if votes is None else votes + F.col(f"_q_m{l}")
    final = (F.col("votes") > F.lit(n_models / 2.0)).cast("double") if value is None else F.col("votes") / F.lit(n_models)
    out = out.withColumn("votes", votes).withColumn("prediction", final)
    return out.drop("_q_v", *[f"_q_m{l}" for l in range(n_models)]).withColumnRenamed("_q_y", "target")


def vote_rule(p1: Column, p2: Column, p3: Column, rule: str = "majority") -> Column:
    """G11 combination.  The note says "vote" but then "false only if L2
    and L3 are both false"; those differ on (F, F, T).  ``majority`` is the
    default, ``l2_or_l3`` the stated rule."""
    if rule == "majority":
        return ((p1 + p2 + p3) >= 2).cast("double")
    if rule == "l2_or_l3":
        return ((p2 + p3) >= 1).cast("double")
    raise ValueError(rule)


def layered_ensemble(train: DataFrame, test: DataFrame, features: str, y: str, positive,
                     rule: str = "majority") -> DataFrame:
    """L1 on all training rows; L2 on the rows L1 gets wrong; L3 on the
    rows where L1 and L2 disagree; combined per ``vote_rule``.  A layer whose
    rows hold a single class cannot be fitted and falls back to L1.
    Returns test + (p1, p2, p3, prediction)."""
    def prep(d):
        return d.withColumn("_q_y", (F.col(y) == F.lit(positive)).cast("double"))

    def fitted(rows: DataFrame, otherwise: LogisticModel) -> LogisticModel:
        return _member(rows, features) if rows.select("_q_y").distinct().count() == 2 else otherwise

    tr, te = prep(train), prep(test)
    m1 = _member(tr, features)
    p1 = m1.prediction(features)
    m2 = fitted(tr.filter(p1 != F.col("_q_y")), m1)
    p2 = m2.prediction(features)
    m3 = fitted(tr.filter(p1 != p2), m1)
    out = te.withColumns({"p1": p1, "p2": p2, "p3": m3.prediction(features)})
    return out.withColumn("prediction", vote_rule(F.col("p1"), F.col("p2"), F.col("p3"), rule)).withColumnRenamed("_q_y", "target")


def anomaly_then_classify(df: DataFrame, features: str, y: str, positive, share: float = 0.1,
                          k: int = 8, seed: int = 9, method: str = "kmeans", components: int = 4,
                          max_steps: int = 30, tol: float = 1e-4) -> DataFrame:
    """Outliers first, then a classifier trained on them.

    Score by ``method``: ``kmeans``, the squared distance to the row's own of
    k centres (k = 1: to the mean); ``mixture``, minus the log density of a
    mixture of k Gaussians, on the first ``components`` principal components
    if the vectors are longer (``fit_mixture`` has ``max_steps`` and ``tol``).  Rows above the ceil((1 - share) n)-th smallest
    score are outliers, exactly.  A logistic model is fitted on the outliers
    (both classes needed, else on all rows) and predicts every row.  Returns
    df + (score, outlier, prediction).
    """
    data = df.withColumn("_q_y", (F.col(y) == F.lit(positive)).cast("double")).withColumn(
        "_q_v", as_vector(features))
    x = F.col(features).cast("array<double>")
    if method == "mixture":
        size = data.agg(F.max(F.size(features))).first()[0] or 0
        points = (pca(data, features, components)[0].withColumnRenamed("components", "_q_p") if size > components
                  else data.withColumn("_q_p", x))
        model = fit_mixture(points, "_q_p", k, max_steps, tol)
        scored = points.withColumn("score", -model.log_density("_q_p") if model else F.lit(None).cast("double")).drop("_q_p")
    elif method == "kmeans" and k == 1:
        mean = data.select(Summarizer.mean(F.col("_q_v"))).first()[0].toArray()
        scored = data.withColumn("score", sq_dist(x, lit_array(mean)))
    elif method == "kmeans":
        km = KMeans(k=k, seed=seed, featuresCol="_q_v", predictionCol="_q_c").fit(data)
        # k x d centres on the driver (k is a small parameter)
        centres = F.array(*[lit_array(c) for c in km.clusterCenters()])
        scored = km.transform(data).withColumn("score", sq_dist(x, F.element_at(centres, F.col("_q_c") + 1))).drop("_q_c")
    else:
        raise ValueError(method)
    cut = exact_quantile(scored, "score", 1.0 - share)
    scored = scored.withColumn("outlier", F.col("score") > F.lit(cut))
    outliers = scored.filter("outlier")
    two = outliers.select("_q_y").distinct().count() == 2
    model = _member(outliers if two else scored, features)
    return scored.withColumn("prediction", model.prediction(features)).drop("_q_v").withColumnRenamed("_q_y", "target")

"""Instances of the model operators that have a closed form, so that DuckDB
can check them: G9 and J7 in the plane, J2 as ridge regression, J4 as a
stump, J6 as boosted stumps, H7 with two regressors, G12 with one centre and with a mixture in the
plane, I11's search, the
bootstrap of J5, and the ensembles' logistic members in the plane with their
votes (G10, G11, J5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import imbalance as G
from quarry.operators import models as J
from quarry.operators import stats as H
from quarry.operators.mixture import fit_mixture
from quarry.operators.newton import fit_logistic
from quarry.operators.stumps import fit_stumps
from quarry.plans.q_imbalance import MINORITY, _emb, split_train_test
from quarry.plans.registry import register
from quarry.sources.tables import load

_XY = "SELECT vec_id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings"


def _plane(spark, sf):
    return _emb(spark, sf).withColumn("embedding", F.slice("embedding", 1, 2))


@register("penalised_lda_plane", "R", section="G9", sql=f"""
WITH x AS ({_XY}),
     s AS (SELECT label = {MINORITY} AS pos, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb,
                  covar_samp(a, b) AS c FROM x GROUP BY 1),
     p AS (SELECT o.ma - z.ma AS da, o.mb - z.mb AS db, (o.ma + z.ma) / 2 AS ha, (o.mb + z.mb) / 2 AS hb,
                  ((z.n - 1) * z.va + (o.n - 1) * o.va) / (z.n + o.n - 2) AS va, ((z.n - 1) * z.vb + (o.n - 1) * o.vb) / (z.n + o.n - 2) AS vb,
                  ((z.n - 1) * z.c + (o.n - 1) * o.c) / (z.n + o.n - 2) AS c FROM s z, s o WHERE NOT z.pos AND o.pos),
     q AS (SELECT da, db, ha, hb, c, va + 1e-9 * greatest(va + vb, 1) AS va, vb + 1e-9 * greatest(va + vb, 1) AS vb FROM p),
     w AS (SELECT *, (vb * da - c * db) / (va * vb - c * c) AS wa, (va * db - c * da) / (va * vb - c * c) AS wb FROM q)
SELECT vec_id, round(wa * (a - ha) + wb * (b - hb), 5) AS score, (wa * (a - ha) + wb * (b - hb) > 0)::DOUBLE AS prediction FROM x, w
""")
def q_penalised_lda_plane(spark, sf):
    out = G.penalised_lda(_plane(spark, sf), "embedding", "label", MINORITY)
    return out.select("vec_id", F.round("score", 5).alias("score"), "prediction")


@register("pca_plane", "R", section="J7", sql=f"""
WITH x AS ({_XY}),
     c AS (SELECT var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM x),
     e AS (SELECT *, (va + vb) / 2 + sqrt(power((va - vb) / 2, 2) + c * c) AS l FROM c),
     v AS (SELECT c / sqrt(c * c + power(l - va, 2)) AS u, (l - va) / sqrt(c * c + power(l - va, 2)) AS w FROM e)
SELECT vec_id, round(abs(a * u + b * w), 6) AS first, round(abs(b * u - a * w), 6) AS second FROM x, v
""")
def q_pca_plane(spark, sf):
    out, _ = J.pca(_plane(spark, sf), "embedding", 2)  # the axes' signs are free
    return out.select("vec_id", *[F.round(F.abs(F.col("components")[i]), 6).alias(n) for i, n in enumerate(("first", "second"))])


_PART_XY = "SELECT p_partkey, p_size::DOUBLE AS a, p_partkey / 1000.0::DOUBLE AS b, p_retailprice AS y FROM part"


def _part(spark, sf):
    p = load(spark, sf, "part").withColumns({"a": F.col("p_size").cast("double"), "b": F.col("p_partkey") / 1000.0, "y": F.col("p_retailprice")})
    return p.select("p_partkey", "a", "b", "y", F.array("a", "b").alias("x"))


@register("ridge_regression", "R", section="J2", sql=f"""
WITH x AS ({_PART_XY}),
     m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) + 0.5 AS va, var_pop(b) + 0.5 AS vb, covar_pop(a, b) AS c,
                  covar_pop(a, y) AS ya, covar_pop(b, y) AS yb FROM x),
     w AS (SELECT *, (vb * ya - c * yb) / (va * vb - c * c) AS wa, (va * yb - c * ya) / (va * vb - c * c) AS wb FROM m)
SELECT p_partkey, round(my + wa * (a - ma) + wb * (b - mb), 4) AS prediction FROM x, w
""")
def q_ridge_regression(spark, sf):
    out, _ = J.elastic_net(_part(spark, sf), "x", "y", None, alpha=0.0, lam=0.5, task="regression")
    return out.select("p_partkey", F.round("prediction", 4).alias("prediction"))


@register("multiple_regression", "R", section="H7", sql=f"""
WITH x AS ({_PART_XY}),
     m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c,
                  covar_pop(a, y) AS ya, covar_pop(b, y) AS yb, var_pop(y) AS vy FROM x),
     w AS (SELECT *, (vb * ya - c * yb) / (va * vb - c * c) AS wa, (va * yb - c * ya) / (va * vb - c * c) AS wb FROM m),
     r AS (SELECT *, round((wa * ya + wb * yb) / vy, 8) AS r2 FROM w)
SELECT 'a' AS term, round(wa, 6) AS coefficient, r2 FROM r UNION ALL SELECT 'b', round(wb, 6), r2 FROM r
UNION ALL SELECT 'intercept', round(my - wa * ma - wb * mb, 4), r2 FROM r
""")
def q_multiple_regression(spark, sf):
    out = H.multiple_regression(_part(spark, sf), ["a", "b"], "y")
    places = F.when(F.col("term") == "intercept", F.round("coefficient", 4)).otherwise(F.round("coefficient", 6))
    return out.select("term", places.alias("coefficient"), F.round("r2", 8).alias("r2"))


@register("decision_stump", "R", section="J4", sql="""
WITH x AS (SELECT p_partkey, p_size AS s, (p_size > 30 OR p_partkey % 5 = 0)::INT AS y FROM part),
     c AS (SELECT s, count(*) AS n, sum(y) AS k FROM x GROUP BY s),
     r AS (SELECT s, sum(n) OVER (ORDER BY s) AS nl, sum(k) OVER (ORDER BY s) AS kl, sum(n) OVER () AS n, sum(k) OVER () AS k FROM c),
     g AS (SELECT s, nl, kl, n, k, (nl - (kl * kl + (nl - kl) * (nl - kl)) / nl) + ((n - nl) - ((k - kl) * (k - kl) + (n - nl - k + kl) * (n - nl - k + kl)) / (n - nl)) AS gini
           FROM r WHERE nl < n),
     b AS (SELECT * FROM g ORDER BY gini, s LIMIT 1)
SELECT p_partkey, y::DOUBLE AS target, (CASE WHEN x.s <= b.s THEN 2 * kl > nl ELSE 2 * (k - kl) > n - nl END)::DOUBLE AS prediction FROM x, b
""")
def q_decision_stump(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", F.array(F.col("p_size").cast("double")).alias("x"),
                                       ((F.col("p_size") > 30) | (F.col("p_partkey") % 5 == 0)).cast("int").alias("y"))
    out, _ = J.shallow_tree(p, "x", "y", 1, max_depth=1)
    return out.select("p_partkey", "target", "prediction")


def _rounds_sql(rounds: int, bins: int = 8) -> str:
    """CTEs c0 to c<rounds>, the rows' margins after each round, and loss<k>."""
    cell = lambda v: f"least(greatest(floor(({v} - l{v}) / w{v}), 0), {bins - 1})::INT AS b{v}"
    ctes = [f"""x AS (SELECT p_partkey, p_size::DOUBLE AS a, p_partkey / 1000.0::DOUBLE AS b, (p_size > 30 OR p_partkey % 5 = 0)::DOUBLE AS y, p_partkey % 4 = 0 AS val FROM part),
     o AS (SELECT min(a) AS la, (max(a) - min(a)) / {bins} AS wa, min(b) AS lb, (max(b) - min(b)) / {bins} AS wb, ln(avg(y) / (1 - avg(y))) AS m FROM x WHERE NOT val)""",
            f"c0 AS MATERIALIZED (SELECT y, val, {cell('a')}, {cell('b')}, m FROM x, o)"]
    for k in range(rounds + 1):
        ctes.append(f"loss{k} AS (SELECT {k} AS round, avg(ln(1 + exp(m)) - y * m) AS loss FROM c{k} WHERE val)")
        if k < rounds:
            ctes.append(f"""c{k + 1} AS MATERIALIZED (
  WITH p AS (SELECT *, 1 / (1 + exp(-m)) AS p FROM c{k} WHERE NOT val),
       h AS (SELECT 0 AS j, ba AS s, sum(y - p) AS g, sum(p * (1 - p)) AS h FROM p GROUP BY ba UNION ALL SELECT 1, bb, sum(y - p), sum(p * (1 - p)) FROM p GROUP BY bb),
       w AS (SELECT j, s, sum(g) OVER (PARTITION BY j ORDER BY s) AS gl, sum(h) OVER (PARTITION BY j ORDER BY s) AS hl,
                    sum(g) OVER (PARTITION BY j) AS g, sum(h) OVER (PARTITION BY j) AS h, max(s) OVER (PARTITION BY j) AS last FROM h),
       t AS (SELECT j, s, 0.3 * gl / (hl + 1) AS l, 0.3 * (g - gl) / (h - hl + 1) AS r FROM w WHERE s < last
             ORDER BY power(gl, 2) / (hl + 1) + power(g - gl, 2) / (h - hl + 1) DESC, j, s LIMIT 1)
  SELECT c.* EXCLUDE (m), m + CASE WHEN (CASE j WHEN 0 THEN ba ELSE bb END) <= s THEN l ELSE r END AS m FROM c{k} c, t)""")
    return ",\n".join(ctes)


_ROUNDS, _TOL = 8, 0.05


@register("early_stopping_rounds", "R", section="J6", sql=f"""
WITH {_rounds_sql(_ROUNDS)},
     l AS ({' UNION ALL '.join(f"SELECT * FROM loss{k}" for k in range(_ROUNDS + 1))}),
     s AS (SELECT min(round) AS stop FROM (SELECT *, lag(loss) OVER (ORDER BY round) - loss AS gain FROM l) WHERE gain < {_TOL} * greatest(loss, 0.01))
SELECT round, round(loss, 8) AS loss, round < coalesce(stop, {_ROUNDS + 1}) AS kept FROM l, s WHERE round <= coalesce(stop, {_ROUNDS})
""")
def q_early_stopping_rounds(spark, sf):
    rows = _noisy(spark, sf).withColumn("y", F.col("y").cast("double"))
    model = fit_stumps(rows, "x", "y", F.col("p_partkey") % 4 == 0, rounds=_ROUNDS, tol=_TOL, bins=8)
    found = [(k, float(v), k <= model.kept) for k, v in enumerate(model.losses)]
    return spark.createDataFrame(found, "round int, loss double, kept boolean").withColumn("loss", F.round("loss", 8))


@register("anomaly_distance", "R", section="G12", sql="""
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS j FROM embeddings),
     m AS (SELECT j, avg(v) AS m FROM e GROUP BY j),
     d AS (SELECT vec_id, label, sum(power(v - m, 2)) AS score FROM e JOIN m USING (j) GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM d)
SELECT vec_id, round(score, 8) AS score, k > ceil(0.9 * n - 1e-9) AS outlier FROM r
""")
def q_anomaly_distance(spark, sf):
    out = G.anomaly_then_classify(_emb(spark, sf), "embedding", "label", MINORITY, share=0.1, k=1)
    return out.select("vec_id", F.round("score", 8).alias("score"), "outlier")


def _mixture_sql(steps: int) -> str:
    """CTEs g0 to g<steps>, the two components after each step, and d<step>,
    each row's log density before the next."""
    ctes = [f"x AS ({_PART_XY})",
            "o AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_samp(a) AS sa, stddev_samp(b) AS sb, covar_samp(a, b) AS cv FROM x)",
            """g0 AS (SELECT c, 0.5::DOUBLE AS w, ma + (c - 0.5) * sa AS ma, mb + (c - 0.5) * sb AS mb, sa * sa + 1e-9 * (sa * sa + sb * sb) AS va,
       sb * sb + 1e-9 * (sa * sa + sb * sb) AS vb, cv FROM o, (VALUES (0), (1)) k(c))"""]
    for k in range(steps + 1):
        ctes += [f"""e{k} AS (SELECT x.p_partkey, a, b, c, ln(w) - ln(2 * pi()) - 0.5 * ln(va * vb - cv * cv)
       - 0.5 * (vb * power(a - ma, 2) - 2 * cv * (a - ma) * (b - mb) + va * power(b - mb, 2)) / (va * vb - cv * cv) AS t FROM x, g{k})""",
                 f"d{k} AS (SELECT p_partkey, ln(sum(exp(t))) AS l FROM e{k} GROUP BY 1)"]
        if k < steps:
            ctes.append(f"""g{k + 1} AS (
  WITH r AS (SELECT a, b, c, exp(t - l) AS r FROM e{k} JOIN d{k} USING (p_partkey)),
       m AS (SELECT c, sum(r) AS n, sum(r * a) / sum(r) AS ma, sum(r * b) / sum(r) AS mb FROM r GROUP BY c),
       v AS (SELECT c, sum(r * power(a - ma, 2)) / any_value(n) AS va, sum(r * power(b - mb, 2)) / any_value(n) AS vb,
                    sum(r * (a - ma) * (b - mb)) / any_value(n) AS cv FROM r JOIN m USING (c) GROUP BY c)
  SELECT c, n / (SELECT count(*) FROM x) AS w, ma, mb, va + 1e-9 * (va + vb) AS va, vb + 1e-9 * (va + vb) AS vb, cv FROM m JOIN v USING (c))""")
    return ",\n".join(ctes)


@register("mixture_steps", "R", section="G12", sql=f"""
WITH {_mixture_sql(3)}
SELECT c AS component, round(w, 8) AS weight, round(ma, 6) AS mean_a, round(mb, 8) AS mean_b, round(va, 5) AS var_a, round(vb, 8) AS var_b,
       round(cv, 6) AS cov_ab, round((SELECT avg(l) FROM d2), 8) AS log_likelihood FROM g3
""")
def q_mixture_steps(spark, sf):
    m = fit_mixture(_part(spark, sf), "x", 2, max_steps=3, tol=float("-inf"))
    rows = [(c, float(m.weights[c]), *map(float, m.means[c]), *map(float, (v[0, 0], v[1, 1], v[0, 1])), float(m.gains[-1])) for c, v in enumerate(m.covariances)]
    names = ["weight", "mean_a", "mean_b", "var_a", "var_b", "cov_ab", "log_likelihood"]
    out = spark.createDataFrame(rows, "component int, " + ", ".join(f"{n} double" for n in names))
    return out.select("component", *[F.round(n, p).alias(n) for n, p in zip(names, (8, 6, 8, 5, 8, 6, 8))])


@register("anomaly_mixture", "R", section="G12", sql=f"""
WITH {_mixture_sql(3)},
     r AS (SELECT p_partkey, -l AS score, row_number() OVER (ORDER BY -l) AS k, count(*) OVER () AS n FROM d3)
SELECT p_partkey, round(score, 7) AS score, k > ceil(0.9 * n - 1e-9) AS outlier FROM r
""")
def q_anomaly_mixture(spark, sf):
    p = _part(spark, sf).withColumn("label", F.pmod("p_partkey", F.lit(2)))
    out = G.anomaly_then_classify(p, "x", "label", 1, share=0.1, k=2, method="mixture", max_steps=3, tol=float("-inf"))
    return out.select("p_partkey", F.round("score", 7).alias("score"), "outlier")


@register("top_items", "R", section="I11", sql="""
WITH s AS (SELECT u.vec_id AS user, i.vec_id AS item, list_inner_product(u.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score
           FROM embeddings u, embeddings i),
     r AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank FROM s)
SELECT user, item, round(score, 6) AS score, rank FROM r WHERE rank <= 5
""")
def q_top_items(spark, sf):
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return J.top_items(e, e, 5).withColumn("score", F.round("score", 6))


def _newton_sql(name: str, rows: str, steps: int = 14) -> str:
    """CTEs ending in ``name`` (ca, cb, c0): a logistic model of (a, b) -> y with
    weights w, penalty 0.01 on scaled features, by ``steps`` Newton steps from zero."""
    ctes = [f"""{name}_c AS (SELECT sum(w) AS n, sum(w * w) AS q, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM {rows})""",
            f"""{name}_s AS MATERIALIZED (SELECT any_value(n) AS n, any_value(ma) AS ma, any_value(mb) AS mb,
       sqrt(sum(w * power(a - ma, 2)) / any_value(n - q / n)) AS sa, sqrt(sum(w * power(b - mb, 2)) / any_value(n - q / n)) AS sb FROM {rows}, {name}_c)""",
            f"{name}_z AS MATERIALIZED (SELECT w / n AS w, y, (a - ma) / sa AS a, (b - mb) / sb AS b FROM {rows}, {name}_s)",
            f"{name}_0 AS (SELECT 0::DOUBLE AS w0, 0::DOUBLE AS w1, 0::DOUBLE AS w2)"]
    for k in range(steps):
        ctes.append(f"""{name}_{k + 1} AS MATERIALIZED (
  WITH p AS (SELECT *, 1 / (1 + exp(-(w0 + w1 * a + w2 * b))) AS p FROM {name}_z, {name}_{k}),
       h AS (SELECT any_value(w0) AS v0, any_value(w1) AS v1, any_value(w2) AS v2,
                    sum(w * (p - y)) AS g0, sum(w * (p - y) * a) + 0.01 * any_value(w1) AS g1, sum(w * (p - y) * b) + 0.01 * any_value(w2) AS g2,
                    sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * a) AS h01, sum(w * p * (1 - p) * b) AS h02,
                    sum(w * p * (1 - p) * a * a) + 0.01 AS h11, sum(w * p * (1 - p) * a * b) AS h12, sum(w * p * (1 - p) * b * b) + 0.01 AS h22 FROM p),
       e AS (SELECT *, h11 - h01 * h01 / h00 AS e11, h12 - h01 * h02 / h00 AS e12, h22 - h02 * h02 / h00 AS e22,
                    g1 - g0 * h01 / h00 AS r1, g2 - g0 * h02 / h00 AS r2 FROM h),
       d AS (SELECT *, (e22 * r1 - e12 * r2) / (e11 * e22 - e12 * e12) AS d1, (e11 * r2 - e12 * r1) / (e11 * e22 - e12 * e12) AS d2 FROM e)
  SELECT v0 - (g0 - h01 * d1 - h02 * d2) / h00 AS w0, v1 - d1 AS w1, v2 - d2 AS w2 FROM d)""")
    ctes.append(f"{name} AS MATERIALIZED (SELECT w1 / sa AS ca, w2 / sb AS cb, w0 - w1 * ma / sa - w2 * mb / sb AS c0 FROM {name}_{steps}, {name}_s)")
    return ",\n".join(ctes)


def _call(model: str) -> str:
    return f"({model}.c0 + {model}.ca * x.a + {model}.cb * x.b > 0)::DOUBLE"


_NOISY = "x AS (SELECT p_partkey, p_size::DOUBLE AS a, p_partkey / 1000.0::DOUBLE AS b, (p_size > 30 OR p_partkey % 5 = 0)::DOUBLE AS y, 1::DOUBLE AS w FROM part)"


def _noisy(spark, sf):
    return _part(spark, sf).select("p_partkey", "x", ((F.col("a") > 30) | (F.col("p_partkey") % 5 == 0)).cast("int").alias("y"))


@register("logistic_newton", "R", section="G10, G11, J5", sql=f"""
WITH {_NOISY}, {_newton_sql('m', 'x')}
SELECT 'a' AS term, round(ca, 6) AS coefficient FROM m UNION ALL SELECT 'b', round(cb, 6) FROM m UNION ALL SELECT 'intercept', round(c0, 6) FROM m
""")
def q_logistic_newton(spark, sf):
    model = fit_logistic(_noisy(spark, sf), "x", "y")
    found = zip(("a", "b", "intercept"), (*model.coefficients, model.intercept))
    return spark.createDataFrame([(t, float(c)) for t, c in found], "term string, coefficient double").withColumn(
        "coefficient", F.round("coefficient", 6))


@register("divide_members", "O", section="G10", sql=f"""
WITH {_NOISY}, {', '.join(f"t{i} AS (SELECT * FROM x WHERE y = 1 OR p_partkey % 3 = {i})" for i in range(3))},
{', '.join(_newton_sql(f"m{i}", f"t{i}") for i in range(3))},
v AS (SELECT x.p_partkey, x.y AS target, {' + '.join(_call(f"m{i}") for i in range(3))} AS votes FROM x, m0, m1, m2)
SELECT p_partkey, target, votes, (votes > 1.5)::DOUBLE AS prediction FROM v
""")
def q_divide_members(spark, sf):
    out = G.divide_conquer_ensemble(_noisy(spark, sf), "x", "y", 1, n_models=3, split=F.pmod("p_partkey", F.lit(3)))
    return out.select("p_partkey", "target", "votes", "prediction")


@register("layered_members", "O", section="G11", sql=f"""
WITH {_NOISY}, {_newton_sql('l1', 'x')},
w AS (SELECT x.* FROM x, l1 WHERE {_call('l1')} <> y), {_newton_sql('l2', 'w')},
s AS (SELECT x.* FROM x, l1, l2 WHERE {_call('l1')} <> {_call('l2')}), {_newton_sql('l3', 's')},
v AS (SELECT x.p_partkey, x.y AS target, {_call('l1')} AS p1, {_call('l2')} AS p2, {_call('l3')} AS p3 FROM x, l1, l2, l3)
SELECT *, (p1 + p2 + p3 >= 2)::DOUBLE AS prediction FROM v
""")
def q_layered_members(spark, sf):
    p = _noisy(spark, sf)
    return G.layered_ensemble(p, p, "x", "y", 1).select("p_partkey", "target", "p1", "p2", "p3", "prediction")


# a rule: the distribution function of Poisson(1)
_CDF = [float(x) for x in J._POISSON1_CDF]


def _weight_sql(salt, key="vec_id"):
    u = f"(('0x' || substr(md5('{salt}' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    return " + ".join(f"({u} >= {x!r}::DOUBLE)::INT" for x in _CDF)


@register("bootstrap_weights", "O", section="J5", sql=f"""
SELECT vec_id, ({_weight_sql('17.0.')})::DOUBLE AS w0, ({_weight_sql('17.1.')})::DOUBLE AS w1, ({_weight_sql('17.2.')})::DOUBLE AS w2 FROM embeddings
""")
def q_bootstrap_weights(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", *[J.bootstrap_weight(f"17.{i}.", F.col("vec_id")).alias(f"w{i}") for i in range(3)])


@register("bagged_logistic", "O", section="J5", sql=f"""
WITH {_NOISY}, t AS (SELECT p_partkey, a, b, y, ({_weight_sql('17.0.', 'p_partkey')})::DOUBLE AS w FROM x), {_newton_sql('m', 't')}
SELECT x.p_partkey, x.y AS target, {_call('m')} AS pred_logistic FROM x, m
""")
def q_bagged_logistic(spark, sf):
    out = J.bagging_mixed(_noisy(spark, sf), "x", "y", 1, "p_partkey", models=("logistic",))
    return out.select("p_partkey", "target", "pred_logistic")


@register("ensemble_votes", "O", section="G10, G11, J5", bench=False, sql=f"""
WITH e AS (SELECT (label = {MINORITY})::DOUBLE AS target, ('0x' || substr(md5('split' || CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM embeddings)
SELECT kind, target, count(*) AS n, count(*) AS as_voted FROM e, (VALUES ('bagging'), ('divide'), ('layers')) k(kind)
WHERE kind <> 'layers' OR u < 0.2::DOUBLE GROUP BY 1, 2
""")
def q_ensemble_votes(spark, sf):
    """How many predictions are what the members' votes say: all."""
    e = _emb(spark, sf)
    train, test = split_train_test(e, "vec_id")
    bag = J.bagging_mixed(e, "embedding", "label", MINORITY, "vec_id")
    divide = G.divide_conquer_ensemble(e, "embedding", "label", MINORITY, n_models=3)
    layers = G.layered_ensemble(train, test, "embedding", "label", MINORITY)
    members = F.col("pred_logistic") + F.col("pred_tree") + F.col("pred_svm")
    rules = {"bagging": (bag, (F.col("votes") == members) & ((members >= 2) == (F.col("prediction") == 1))),
             "divide": (divide, (F.col("votes").isin(0, 1, 2, 3)) & ((F.col("votes") >= 2) == (F.col("prediction") == 1))),
             "layers": (layers, ((F.col("p1") + F.col("p2") + F.col("p3")) >= 2) == (F.col("prediction") == 1))}
    parts = [out.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("as_voted")).withColumn("kind", F.lit(kind))
             for kind, (out, ok) in rules.items()]
    return reduce(DataFrame.unionByName, parts).select("kind", "target", "n", "as_voted")

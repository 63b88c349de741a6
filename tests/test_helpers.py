"""Building blocks: global rank, running sums, p-values, JDBC options."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import pvalues
from quarry.functions.joins import bounded_broadcast
from quarry.functions.rank import global_rank, rank_within
from quarry.functions.scan import running_sum
from quarry.sources.jdbc import jdbc_options


def _skewed(spark, n=400):
    # one group holds half of the rows, the rest are small
    rows = [(0 if i % 2 == 0 else i % 17, i, float(i % 7)) for i in range(n)]
    return spark.createDataFrame(rows, "g int, t int, v double").repartition(5)


def test_global_rank_is_dense_and_ordered(spark):
    df = _skewed(spark)
    ranked = global_rank(df, ["g", "t"]).toPandas().sort_values(["g", "t"])
    assert list(ranked["rank"]) == list(range(1, len(ranked) + 1))


def test_rank_within_matches_window(spark):
    df = _skewed(spark)
    ours = rank_within(df, ["g"], ["t"], "r")
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("t")))
    assert sorted(ours.collect()) == sorted(ref.select(*ours.columns).collect())


def test_rank_within_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "g int, t int")
    out = {(r["g"], r["t"], r["r"]) for r in rank_within(df, ["g"], ["t"], "r").collect()}
    assert out == {(None, 1, 1), (None, 2, 2), (1, 3, 1)}


@pytest.mark.parametrize("block_rows", [1, 7, 64, 1 << 20])
def test_running_sum_blocks(spark, block_rows):
    df = _skewed(spark, 300)
    ours = running_sum(df, ["g"], ["t"], ["v"], block_rows=block_rows)
    w = Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("cum_v", F.sum("v").over(w))
    a = sorted((r.g, r.t, round(r.cum_v, 9)) for r in ours.collect())
    b = sorted((r.g, r.t, round(r.cum_v, 9)) for r in ref.collect())
    assert a == b


def test_bounded_broadcast(spark):
    left = spark.range(10)
    side = spark.range(5).withColumnRenamed("id", "k")

    def plan(df):
        return df._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan(left.join(bounded_broadcast(side), left.id == F.col("k")))
    assert "strategy=broadcast" not in plan(left.join(bounded_broadcast(side, 10), left.id == F.col("k")))
    assert left.join(bounded_broadcast(side, 10), left.id == F.col("k")).count() == 5


def test_pvalues_known_values():
    assert math.isclose(pvalues.t_two_sided(2.0, 10), 0.0733880348, rel_tol=1e-7)
    assert math.isclose(pvalues.t_two_sided(0.0, 5), 1.0, rel_tol=1e-12)
    assert math.isclose(pvalues.chi2_upper(3.841458820694124, 1), 0.05, rel_tol=1e-7)
    assert math.isclose(pvalues.chi2_upper(18.307038053275146, 10), 0.05, rel_tol=1e-7)
    assert math.isclose(pvalues.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)


def test_pvalue_columns(spark):
    df = spark.createDataFrame([(2.0, 10.0, 3.841458820694124, 1.0)], "t double, d double, x double, k double")
    row = df.select(pvalues.t_p_value(F.col("t"), F.col("d")).alias("p"),
                    pvalues.chi2_p_value(F.col("x"), F.col("k")).alias("q")).first()
    assert math.isclose(row.p, 0.0733880348, rel_tol=1e-7)
    assert math.isclose(row.q, 0.05, rel_tol=1e-7)


def test_jdbc_options():
    o = jdbc_options("jdbc:x://h/db", "SELECT * FROM t", "id", (0, 100), 4, {"user": "u"})
    assert o["dbtable"] == "(SELECT * FROM t) q" and o["numPartitions"] == "4"
    assert o["partitionColumn"] == "id" and o["lowerBound"] == "0" and o["user"] == "u"
    assert jdbc_options("jdbc:x://h/db", "SELECT 1")["query"] == "SELECT 1"
    assert jdbc_options("jdbc:x://h/db", "nation")["dbtable"] == "nation"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x://h/db", "t", "id")


def test_scale_conf():
    from quarry.session import scale_conf
    c = scale_conf(100 * 2 ** 40, 8000)  # 100 TB on 8,000 cores
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert int(c["spark.sql.files.maxPartitionBytes"]) == 256 << 20
    small = scale_conf(10 << 20, 8, executor_memory_bytes=1 << 30)
    assert int(small["spark.sql.shuffle.partitions"]) == 24
    assert int(small["spark.sql.files.maxPartitionBytes"]) == int((1 << 30) * 0.6 / 4)


def test_hot_group_spreads_over_partitions(spark):
    # one group holds a third of the rows: the global sort splits it
    rows = [(0 if i % 3 == 0 else 1 + i % 500, i) for i in range(30000)]
    df = spark.createDataFrame(rows, "g int, t int").repartition(8)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")  # tiny data would otherwise be coalesced to one task
    try:
        ranked = global_rank(df, ["g", "t"]).withColumn("pid", F.spark_partition_id())
        spread = ranked.filter("g = 0").select("pid").distinct().count()
        n = ranked.filter("g = 0").count()
    finally:
        spark.conf.set(key, old)
    assert n == 10000 and spread >= 2


def test_checkpoint_dir_when_unset(tmp_path):
    """A session whose configuration names no checkpoint folder still works
    (run in a fresh process with an empty Spark configuration folder)."""
    import os
    import subprocess
    import sys
    conf = tmp_path / "conf"
    conf.mkdir()
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "assert s.sparkContext.getCheckpointDir() is None\n"
            "from quarry.session import ensure_checkpoint_dir\n"
            "d = ensure_checkpoint_dir(s)\n"
            "from quarry.functions.rank import global_rank\n"
            "assert [r['rank'] for r in global_rank(s.range(5), ['id']).orderBy('id').collect()] == [1, 2, 3, 4, 5]\n"
            "print('OK', d)\n") % os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, SPARK_CONF_DIR=str(conf))
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "OK" in out.stdout, out.stderr[-2000:]


def test_top_n_per_group_both_paths(spark):
    from quarry.functions.rank import top_n_per_group
    df = _skewed(spark, 500)
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), "t")
    ref = sorted(tuple(r) for r in df.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").collect())
    got = sorted(tuple(r) for r in top_n_per_group(df, ["g"], [F.col("v").desc(), "t"], 3).collect())
    assert got == ref
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "2")  # force the global-sort path
    try:
        got = sorted(tuple(r) for r in top_n_per_group(df, ["g"], [F.col("v").desc(), "t"], 3).collect())
    finally:
        spark.conf.set(key, old)
    assert got == ref

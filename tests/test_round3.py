"""Ties, NULL users, dead writers and workers without the package."""

import os
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarry.operators import business as B
from quarry.operators import stats as H
from quarry.sources import changes as C

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCHEMA = StructType([StructField("k", LongType(), False), StructField("v", StringType())])


def test_bayes_update_counts_repeated_evidence(spark):
    """Rows alike in all columns are each a piece of evidence."""
    priors = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "hypothesis string, prior double")
    likely = spark.createDataFrame([("a", "x", 0.8), ("b", "x", 0.2), ("a", "y", 0.5)], "hypothesis string, obs string, likelihood double")
    rows = [(1, 1, "x"), (1, 1, "x"), (2, 1, "z"), (None, 1, "x"), (3, 1, "y"), (3, 2, "x")]
    evidence = spark.createDataFrame(rows, "who int, at int, obs string")
    got = sorted((str(r["who"]), r["hypothesis"], round(r["posterior"], 3)) for r in H.bayes_update(evidence, "who", ["at"], "obs", priors, likely).collect())
    assert got == sorted([("1", "a", 0.8), ("1", "a", 0.941), ("1", "b", 0.2), ("1", "b", 0.059), ("2", "a", 0.5), ("2", "b", 0.5),
                          ("None", "a", 0.8), ("None", "b", 0.2), ("3", "a", 1.0), ("3", "b", 0.0), ("3", "a", 1.0), ("3", "b", 0.0)])


@pytest.mark.parametrize("wide", [64, 1])
def test_bayes_update_across_blocks(spark, wide):
    """A long entity's sums carry from block to block, by columns and by rows."""
    from quarry.functions.scan import running_array_sum
    df = spark.range(1000).select((F.col("id") % 3 == 0).alias("g"), "id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    got = {r["id"]: list(r["s"]) for r in running_array_sum(df, ["g"], ["id"], "v", "s", block_rows=64, wide=wide).collect()}
    for i in (0, 3, 63, 64, 500, 999):
        mine = [j for j in range(i + 1) if (j % 3 == 0) == (i % 3 == 0)]
        assert got[i] == [len(mine), sum(mine)]


def test_user_sequence_keeps_null_users(spark):
    events = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (None, 2, "d")], "u int, t int, kind string")
    pos, trans = B.user_sequence(events, "u", ["t"], "kind", block_rows=2)
    assert sorted((str(r["u"]), r["pos"], r["kind"]) for r in pos.collect()) == [("1", 1, "a"), ("1", 2, "b"), ("None", 1, "c"), ("None", 2, "d")]
    assert sorted(map(tuple, trans.collect())) == [("a", "b", 1), ("c", "d", 1)]


def row(spark, k):
    return spark.createDataFrame([(k, "x")], SCHEMA)


def keys(spark, path):
    return sorted(r["k"] for r in C.read_table(spark, path).collect())


def test_a_dead_writer_loses_nothing(spark, tmp_path, monkeypatch):
    """Wherever a commit stops, the table reads and takes the next commit."""
    path = f"file:{tmp_path}/t"
    C.create_table(spark, path, SCHEMA, key=["k"])
    assert C.atomic_batch(spark, path, row(spark, 1)).first()["committed"]
    versions = tmp_path / "t" / "_versions"
    (versions / "000000000002").write_text("")  # as earlier writers left it
    assert keys(spark, path) == [1]
    assert C.atomic_batch(spark, path, row(spark, 2)).first()["committed"] and keys(spark, path) == [1, 2]
    (versions / "draft-dead").write_text("{")
    (versions / "claim-000000000004").write_text("")  # claimed, then dead
    assert keys(spark, path) == [1, 2]
    with pytest.raises(C.CommitConflict):
        C.atomic_batch(spark, path, row(spark, 3))
    monkeypatch.setattr(C, "CLAIM_SECONDS", 0.0)
    assert C.atomic_batch(spark, path, row(spark, 3)).first()["committed"] and keys(spark, path) == [1, 2, 3]


def test_one_of_several_writers_commits(spark, tmp_path):
    path = f"file:{tmp_path}/t"
    C.create_table(spark, path, SCHEMA)
    (tmp_path / "t" / "_versions").mkdir(exist_ok=True)
    won, lost = [], []

    def write(i):
        try:
            C._commit(spark, path, 1, {"data": [str(i)], "applied": {}})
            won.append(i)
        except C.CommitConflict:
            lost.append(i)
    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 5 and C._snapshot(spark, path) == (1, {"data": [str(won[0])], "applied": {}})


ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
import os
from quarry.session import get_session
from quarry.operators import business as B, stats as H
spark = get_session("local[2]", 2)
df = spark.createDataFrame([("a", "x", float(i % 7)) for i in range(20)] + [("b", "y" if i % 3 else "x", float(i % 5)) for i in range(20)], "g string, c string, v double")
assert H.hypothesis_test(df, "g", "v", "a", "b").first()["p"] > 0
assert H.chi_square(df, "g", "c").first()["p"] < 1
print("fine")
"""


def test_p_values_on_workers_without_the_package(tmp_path):
    """Started elsewhere, without PYTHONPATH: the workers cannot import the library."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-2000:]


def test_changes_rewrite_the_folders_they_hit(spark, tmp_path):
    """One changed row, one folder anew; NULL predicates hit nothing; a broken rule changes nothing."""
    path = f"file:{tmp_path}/t"
    C.create_table(spark, path, SCHEMA, key=["k"], lengths={"v": "char(3)"})
    for lot in range(4):
        batch = spark.createDataFrame([(lot * 10 + i, "ab" if i else None) for i in range(5)], SCHEMA)
        assert C.atomic_batch(spark, path, batch).first()["committed"]

    def folders():
        return C._snapshot(spark, path)[1]["data"]

    def rows():
        return {r["k"]: r["v"] for r in C.read_table(spark, path).collect()}
    before, was = folders(), rows()
    done = C.update_stored(spark, path, F.col("k") == 21, {"v": F.lit("new")}).collect()
    assert all(r["committed"] for r in done) and not {r["rule"] for r in done} & {"primary_key", "not_null"}
    assert len(set(before) & set(folders())) == 3 and len(folders()) == 4 and rows() == {**was, 21: "new"}
    version = C._snapshot(spark, path)[0]
    assert C.update_stored(spark, path, F.col("k") == 99, {"v": F.lit("x")}).first()["committed"]
    assert C.update_stored(spark, path, F.col("v") == F.lit(None).cast("string"), {"v": F.lit("x")}).first()["committed"]
    for bad in ({"v": F.lit("long")}, {"k": F.lit(1)}, {"k": F.lit(None).cast("long")}):
        assert not C.update_stored(spark, path, F.col("k") == 21, bad).first()["committed"]
    assert C._snapshot(spark, path)[0] == version and rows() == {**was, 21: "new"}
    # keys may move where others make room
    assert C.update_stored(spark, path, F.col("k") < 10, {"k": F.col("k") + 1000}).first()["committed"]
    assert C.delete_stored(spark, path, F.col("v") == "new").first()["committed"]
    want = {(k + 1000 if k < 10 else k): v for k, v in was.items() if k != 21}
    assert rows() == want and len(set(before) & set(folders())) == 2
    with pytest.raises(ValueError):
        C.update_stored(spark, path, F.col("k") == 1, {"nope": F.lit(1)})

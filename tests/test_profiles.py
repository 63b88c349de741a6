"""Key and inclusion searches against brute force (K7, K8)."""

import itertools
import random

from quarry.operators import quality as Q


def brute_keys(rows, cols, width):
    keys = []
    for w in range(1, width + 1):
        for g in itertools.combinations(range(len(cols)), w):
            part = [tuple(r[i] for i in g) for r in rows]
            if len(set(part)) == len(rows) and not any(None in t for t in part) and not any(set(k) <= set(g) for k in keys):
                keys.append(g)
    return sorted(",".join(cols[i] for i in k) for k in keys)


def test_minimal_keys_are_all_found(spark):
    rng = random.Random(5)
    cols = ["a", "b", "c", "d", "e"]
    rows = [(i // 7, i % 7, rng.randrange(40), f"x{rng.randrange(9)}", None if i == 3 else i) for i in range(280)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d string, e int")
    got = sorted(r["columns"] for r in Q.minimal_keys(df, 3).collect())
    assert got == brute_keys(rows, cols, 3) and "a,b" in got and not any("e" in g for g in got)


def test_minimal_keys_one_repeat_is_no_key(spark):
    """A single repeat in many rows is found, whatever the sketches say."""
    df = spark.range(20000).selectExpr("if(id = 17, 18, id) AS almost", "id % 2 AS half", "id AS whole")
    assert [r["columns"] for r in Q.minimal_keys(df, 2).collect()] == ["whole", "almost,half"]


def test_minimal_keys_of_little(spark):
    assert [tuple(r) for r in Q.minimal_keys(spark.createDataFrame([(1, None)], "a int, b int"), 2).collect()] == [("a", 1)]
    empty = Q.minimal_keys(spark.createDataFrame([], "a int, b int"), 2)
    assert sorted(r["columns"] for r in empty.collect()) == ["a", "b"]
    assert Q.minimal_keys(spark.createDataFrame([(1,), (1,)], "a int"), 1).count() == 0


def test_key_profile_with_nulls(spark):
    rows = [(1, None, "x"), (2, None, "x"), (3, 5, None), (4, 5, "x")]
    df = spark.createDataFrame(rows, "k int, a int, b string")
    got = {r["columns"]: tuple(r)[1:] for r in Q.candidate_key_profile(df, 2).collect()}
    assert got == {"k": (4, 4, 0, True), "a": (4, 1, 2, False), "b": (4, 1, 1, False), "k,a": (4, 4, 2, False),
                   "k,b": (4, 4, 1, False), "a,b": (4, 3, 3, False)}
    assert all(r["is_key"] and r["rows"] == 0 for r in Q.candidate_key_profile(df.limit(0), 2).collect())


def test_key_profile_multiplies_no_rows(spark, capsys):
    df = spark.range(10).selectExpr("id", "id % 3 AS a")
    Q._distinct_of(df, ("id", "a")).explain("formatted")
    assert "Expand" not in capsys.readouterr().out


def test_inclusions(spark):
    """Partial, NULL, empty and repeated columns, and text that looks like numbers."""
    parent = spark.range(50000).selectExpr("id AS k", "cast(id AS string) AS name", "id % 10 AS grp")
    child = spark.range(30000).selectExpr("if(id % 5 = 0, NULL, cast(id AS int)) AS inside", "id + 20001 AS one_out",
                                          "cast(NULL AS int) AS none", "cast(id * 2 % 100 AS string) AS text", "'' AS blank", "id / 1.0 AS real")
    got = {tuple(r) for r in Q.inclusion_profile({"p": parent, "c": child}).collect()}
    assert got == {("c", "inside", "p", "k", 24000), ("c", "text", "p", "name", 50), ("p", "grp", "p", "k", 10)}
    exact = child.selectExpr("one_out - 2 AS v")
    assert [tuple(r) for r in Q.inclusion_profile({"p": parent.select("k"), "c": exact}).collect()] == [("c", "v", "p", "k", 30000)]
    assert Q.inclusion_profile({"r": child.select("real")}).count() == 0
    assert Q.inclusion_profile({"e": child.limit(0).select("inside"), "p": parent.select("k")}).count() == 0

"""Registered queries for SURVEY §2.1 (A2-A13).  A1 (JDBC) is not
registered: it needs a database process (see README)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.registry import register
from quarry.session import work_path
from quarry.sources import changes as C
from quarry.sources import layout as L
from quarry.sources import tables as S
from quarry.sources.tables import load


@register("table_scan", "O", section="A2", sql="SELECT * FROM region")
def q_table_scan(spark, sf):
    return S.table_scan(spark, S.table_path(sf, "region"))


@register("fetch_one", "O", section="A3", sql="""
SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'
ORDER BY c_acctbal DESC, c_custkey LIMIT 1
""")
def q_fetch_one(spark, sf):
    c = load(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return S.fetch_one(c, [F.col("c_acctbal").desc(), "c_custkey"])


@register("fetch_all", "O", section="A4", sql="SELECT * FROM nation")
def q_fetch_all(spark, sf):
    return S.fetch_all(load(spark, sf, "nation"))


CUSTOMER_SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType(), False),
    T.StructField("c_name", T.StringType(), True),
    T.StructField("c_nationkey", T.IntegerType(), True),
    T.StructField("c_acctbal", T.DoubleType(), True),
    T.StructField("c_mktsegment", T.StringType(), True),
])


@register("create_table", "O", section="A5", sql="SELECT * FROM customer")
def q_create_table(spark, sf):
    path = work_path(spark, "customer_table")
    C.create_table(spark, path, CUSTOMER_SCHEMA)
    verdict = C.atomic_batch(spark, path, load(spark, sf, "customer"), key=["c_custkey"])
    if not all(r["committed"] for r in verdict.collect()):
        raise RuntimeError("customer batch refused")
    return C.read_table(spark, path)


@register("insert_row", "O", section="A6",
          sql="SELECT * FROM region UNION ALL SELECT CAST(5 AS INTEGER), 'ANTARCTICA'")
def q_insert_row(spark, sf):
    return C.insert_row(load(spark, sf, "region"), (5, "ANTARCTICA"))


@register("insert_partial", "O", section="A7", sql="""
SELECT * FROM supplier
UNION ALL SELECT CAST(1000000007 AS BIGINT), 'Supplier#new', CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE)
""")
def q_insert_partial(spark, sf):
    return C.insert_partial(load(spark, sf, "supplier"), [(1000000007, "Supplier#new")],
                            ["s_suppkey", "s_name"])


@register("insert_batch", "O", section="A8", sql="""
SELECT * FROM customer
UNION ALL
SELECT c_custkey + (SELECT max(c_custkey) + 1 FROM customer), c_name, c_nationkey, c_acctbal, c_mktsegment
FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def q_insert_batch(spark, sf):
    c = load(spark, sf, "customer")
    shift = c.select(F.max("c_custkey") + 1).scalar()
    batch = c.filter(F.col("c_mktsegment") == "BUILDING").withColumn(
        "c_custkey", F.col("c_custkey") + shift)
    return C.insert_batch(c, batch)


PART_SCHEMA = T.StructType([
    T.StructField("p_partkey", T.LongType(), False),
    T.StructField("p_name", T.StringType(), False),
    T.StructField("p_brand", T.StringType(), True),
    T.StructField("p_type", T.StringType(), True),
    T.StructField("p_size", T.IntegerType(), True),
    T.StructField("p_retailprice", T.DoubleType(), True),
])


@register("atomic_batch", "O", section="A9", sql="""
WITH b1 AS (SELECT * FROM part WHERE p_size <= 25),
     b2 AS (SELECT * FROM part WHERE p_size >= 20),
     k1 AS (SELECT p_partkey FROM b1 GROUP BY p_partkey HAVING count(*) > 1 OR p_partkey IS NULL),
     k2 AS (SELECT p_partkey FROM (SELECT p_partkey FROM b1 WHERE p_partkey IN (SELECT p_partkey FROM b2)
                                   UNION ALL SELECT p_partkey FROM b2) u
            GROUP BY p_partkey HAVING count(*) > 1 OR p_partkey IS NULL),
     v1 AS (
       SELECT 'primary_key' AS rule, (SELECT count(*) FROM k1) AS violations
       UNION ALL SELECT 'not_null', (SELECT (count(*) - count(p_partkey)) + (count(*) - count(p_name)) FROM b1)
       UNION ALL SELECT 'length_type', (SELECT count(*) FILTER (WHERE length(p_brand) > 8) FROM b1)),
     v2 AS (
       SELECT 'primary_key' AS rule, (SELECT count(*) FROM k2) AS violations
       UNION ALL SELECT 'not_null', (SELECT (count(*) - count(p_partkey)) + (count(*) - count(p_name)) FROM b2)
       UNION ALL SELECT 'length_type', (SELECT count(*) FILTER (WHERE length(p_name) > 10) FROM b2))
SELECT 1 AS batch, rule, CAST(violations AS BIGINT) AS violations,
       (SELECT sum(violations) FROM v1) = 0 AS committed FROM v1
UNION ALL
SELECT 2, rule, CAST(violations AS BIGINT), (SELECT sum(violations) FROM v2) = 0 FROM v2
""")
def q_atomic_batch(spark, sf):
    part = load(spark, sf, "part")
    path = work_path(spark, "part_table")
    C.create_table(spark, path, PART_SCHEMA)
    v1 = C.atomic_batch(spark, path, part.filter(F.col("p_size") <= 25), key=["p_partkey"],
                        lengths={"p_brand": "char(8)"})
    v2 = C.atomic_batch(spark, path, part.filter(F.col("p_size") >= 20), key=["p_partkey"],
                        lengths={"p_name": "varchar(10)"})
    return (v1.select(F.lit(1).alias("batch"), "*")
            .unionByName(v2.select(F.lit(2).alias("batch"), "*")))


_NULLED_PART_SQL = """(SELECT p_partkey, p_name, nullif(p_brand, 'Brand#1') AS p_brand, p_type,
  nullif(p_size, 30) AS p_size, p_retailprice FROM part) t"""


def _nulled_part(spark, sf):
    return load(spark, sf, "part").withColumns({
        "p_brand": F.nullif(F.col("p_brand"), F.lit("Brand#1")),
        "p_size": F.nullif(F.col("p_size"), F.lit(30))})


def _stored_part(spark, sf):
    """The part table, with NULLs, as a stored table with its key."""
    path = work_path(spark, "part_changes")
    C.create_table(spark, path, PART_SCHEMA, key=["p_partkey"])
    C.atomic_batch(spark, path, _nulled_part(spark, sf))
    return path


@register("update_where", "O", section="A10", sql=f"""
SELECT p_partkey, p_name, p_brand, p_type,
       CASE WHEN p_brand = 'Brand#13' THEN p_size + 1 ELSE p_size END AS p_size, p_retailprice
FROM {_NULLED_PART_SQL}
""")
def q_update_where(spark, sf):
    path = _stored_part(spark, sf)
    done = C.update_stored(spark, path, F.col("p_brand") == "Brand#13", {"p_size": F.col("p_size") + 1})
    if not done.filter("committed").count():
        raise RuntimeError("update refused")
    return C.read_table(spark, path)


@register("delete_where", "O", section="A11", sql=f"""
SELECT * FROM {_NULLED_PART_SQL} WHERE NOT coalesce(p_size > CAST('20' AS INTEGER), false)
""")
def q_delete_where(spark, sf):
    path = _stored_part(spark, sf)
    done = C.delete_stored(spark, path, F.col("p_size") > F.lit("20").cast("int"))
    if not done.filter("committed").count():
        raise RuntimeError("delete refused")
    return C.read_table(spark, path)


@register("clustered_write", "O", section="A12", sql="SELECT * FROM orders")
def q_clustered_write(spark, sf):
    path = work_path(spark, "orders_by_date")
    n = max(1, spark.sparkContext.defaultParallelism)
    L.clustered_write(load(spark, sf, "orders"), path, ["o_orderdate", "o_orderkey"], n)
    return spark.read.parquet(path)


@register("file_sort", "O", section="A13", sql="""
SELECT *, row_number() OVER (ORDER BY o_orderdate NULLS FIRST, o_orderkey NULLS FIRST) AS rank
FROM orders
""")
def q_file_sort(spark, sf):
    orders = load(spark, sf, "orders")
    path = work_path(spark, "orders_csv")
    orders.write.option("header", True).csv(path)
    return L.file_sort(spark, path, "csv", orders.schema,
                       [F.col("o_orderdate").asc_nulls_first(), F.col("o_orderkey").asc_nulls_first()],
                       options={"header": "true"})

"""A1: rows of a table or query over a JDBC connection.

The reference opens one client connection and runs one statement.  Spark
opens one connection per partition on the executors; with a numeric
``partition_column`` and its bounds the read is split into ``n`` range
queries.  No registered query uses it: that would need a database process,
and none is started here (see README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, query: str, partition_column: str | None = None,
                 bounds: tuple | None = None, n: int | None = None,
                 properties: dict | None = None) -> dict:
    """The reader options for ``read_jdbc`` (split out so it can be tested)."""
    opts = dict(properties or {})
    opts["url"] = url
    text = query.strip()
    if partition_column:
        if not bounds or not n:
            raise ValueError("partition_column needs bounds=(low, high) and n")
        # partitioned reads need a table expression, not a bare query
        opts["dbtable"] = text if not text.lower().startswith("select") else f"({text}) q"
        opts.update({"partitionColumn": partition_column, "lowerBound": str(bounds[0]),
                     "upperBound": str(bounds[1]), "numPartitions": str(int(n))})
    elif text.lower().startswith("select"):
        opts["query"] = text
    else:
        opts["dbtable"] = text
    return opts


def read_jdbc(spark: SparkSession, url: str, query: str, partition_column: str | None = None,
              bounds: tuple | None = None, n: int | None = None,
              properties: dict | None = None) -> DataFrame:
    """Read a table name or a SELECT over JDBC; credentials go in
    ``properties`` (``user``, ``password``), never in code."""
    return spark.read.format("jdbc").options(
        **jdbc_options(url, query, partition_column, bounds, n, properties)).load()

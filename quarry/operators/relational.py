"""Projections, predicates, joins, aggregates, subqueries, sort.

String comparison is binary (case-sensitive), unlike the case-insensitive
default collation of the database the reference talks to.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.expr import col_of, compare, scalar_struct
from quarry.functions.rank import global_rank

# ---------------------------------------------------------------- B: select / where


def project_alias(df: DataFrame, exprs: dict) -> DataFrame:
    """B1: choose columns and name expressions (``expr AS name``)."""
    return df.select([col_of(e).alias(n) for n, e in exprs.items()])


def filter_eq_string(df: DataFrame, column: str, value: str) -> DataFrame:
    """B2: ``column = 'text'`` (pushed to the scan as EqualTo)."""
    return df.filter(F.col(column) == F.lit(value))


def filter_eq_int(df: DataFrame, column: str, value: int) -> DataFrame:
    """``column = n``."""
    return df.filter(compare(df, column, "=", value))


def filter_gt(df: DataFrame, column: str, value) -> DataFrame:
    """``column > number``."""
    return df.filter(compare(df, column, ">", value))


def filter_gt_quoted(df: DataFrame, column: str, value: str) -> DataFrame:
    """A number column compared with a quoted number, ``INCOME > '1000'``.

    The text is cast to the column's type, so the comparison is numeric and
    the predicate on the raw column is pushed down.
    """
    return df.filter(compare(df, column, ">", value))


def filter_type_mismatch(df: DataFrame, string_col, number: int) -> DataFrame:
    """A text column tested against a number.

    ``try_cast`` turns text that is not a whole number into NULL (the row
    drops out); unlike MySQL, leading digits of such text are not read.
    """
    return df.filter(col_of(string_col).try_cast("bigint") == F.lit(number).cast("bigint"))


def like_prefix(df: DataFrame, column: str, text: str) -> DataFrame:
    """``LIKE 'text%'`` (pushed as StringStartsWith)."""
    return df.filter(F.col(column).startswith(text))


def like_suffix(df: DataFrame, column: str, text: str) -> DataFrame:
    """``LIKE '%text'`` (pushed as StringEndsWith)."""
    return df.filter(F.col(column).endswith(text))


def like_single_char(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """A LIKE pattern where ``_`` is exactly one character."""
    return df.filter(F.col(column).like(pattern))


def filter_or(df: DataFrame, preds) -> DataFrame:
    """Predicates joined by OR (pushed whole when every side converts)."""
    cond = None
    for p in preds:
        cond = p if cond is None else (cond | p)
    return df.filter(cond)


def filter_and_prefix(df: DataFrame, preds) -> DataFrame:
    """Several restrictions at once (AND).  Unlike a composite index,
    the order of the columns does not matter to the scan."""
    for p in preds:
        df = df.filter(p)
    return df


def filter_neq(df: DataFrame, column: str, value) -> DataFrame:
    """``<>``; rows where the column is NULL drop out."""
    return df.filter(compare(df, column, "<>", value))


def arith_increment(df: DataFrame, column: str, by: int = 1) -> DataFrame:
    """``column + by`` (ANSI mode: overflow raises, never wraps)."""
    return df.withColumn(column, F.col(column) + F.lit(by))


def bound_params(spark: SparkSession, sql: str, args: dict, **frames: DataFrame) -> DataFrame:
    """SQL text with values bound apart from it (``:name`` markers).

    ``frames`` are DataFrames referenced in the text as ``{name}``.  Values
    never get spliced into the text, so they cannot change its meaning.
    """
    return spark.sql(sql, args=args, **frames)


_SPEC = re.compile(r"%(?:(\d+)\$)?[-#+ 0,(]*\d*(?:\.\d+)?([a-zA-Z%])")


def format_row(df: DataFrame, template: str, cols, out_col: str = "line") -> DataFrame:
    """One text line per row, printf style.

    ``%d`` of a fractional number truncates toward zero, as Python's ``%d``
    does.  A NULL value prints ``null``.
    """
    values = [col_of(c) for c in cols]
    types = df.select(*values).schema
    taken = 0
    for place, spec in _SPEC.findall(template):
        if spec in "%n":
            continue
        taken += not place
        i = int(place or taken) - 1
        if spec == "d" and i < len(values) and types[i].dataType.typeName() in ("float", "double", "decimal"):
            values[i] = values[i].cast("bigint")
    return df.select(*df.columns, F.format_string(template, *values).alias(out_col))


# ---------------------------------------------------------------- C: joins


def _join(left: DataFrame, right: DataFrame, on, how: str) -> DataFrame:
    return left.join(right, on=on, how=how)


def inner_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows equal on the join fields."""
    return _join(left, right, on, "inner")


def left_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Every left row, with matches or NULLs."""
    return _join(left, right, on, "left")


def right_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Every right row, with matches or NULLs."""
    return _join(left, right, on, "right")


def full_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """C4: every row of both sides."""
    return _join(left, right, on, "full")


def fk_lookup_join(child: DataFrame, parent: DataFrame, fk: str, pk: str, attrs) -> DataFrame:
    """Child rows with parent attributes through a foreign key.

    A left join, so a child with a NULL or dangling key is kept.  Only the
    key and the wanted attributes of the parent are read; whether they are
    broadcast is Spark's choice, by their bytes.
    """
    p = parent.select(F.col(pk).alias("_q_pk"), *attrs)
    return child.join(p, F.col(fk) == F.col("_q_pk"), "left").drop("_q_pk")


# ---------------------------------------------------------------- D: aggregates


def agg_count(df: DataFrame, name: str = "n") -> DataFrame:
    """Number of rows."""
    return df.agg(F.count(F.lit(1)).alias(name))


def agg_sum(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """Sum of one column."""
    return df.agg(F.sum(column).alias(name))


def agg_avg(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """D3: mean of one column (NULLs ignored)."""
    return df.agg(F.avg(column).alias(name))


def agg_max(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """D4."""
    return df.agg(F.max(column).alias(name))


def agg_min(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """D5."""
    return df.agg(F.min(column).alias(name))


def group_by_avg(df: DataFrame, keys, column: str, name: str = "avg_value") -> DataFrame:
    """``keys, avg(column) GROUP BY keys`` (partial aggregate per task,
    one shuffle on the keys, final aggregate)."""
    return df.groupBy(*keys).agg(F.avg(column).alias(name))


def having_filter(df: DataFrame, keys, aggs: dict, pred: Column) -> DataFrame:
    """Filter groups after aggregating; ``pred`` may use the aggregates'
    names."""
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]).filter(pred)


def where_then_having(df: DataFrame, where: Column, keys, aggs: dict,
                      having: Column) -> DataFrame:
    """WHERE before grouping, HAVING after.  An aggregate inside
    ``where`` is refused by the analyzer, as in SQL."""
    return having_filter(df.filter(where), keys, aggs, having)


# ---------------------------------------------------------------- E: subqueries


def derived_table_filter(df: DataFrame, keys, column: str, min_avg: float,
                         name: str = "avg_value") -> DataFrame:
    """Aggregate in FROM (named S), filtered outside:
    ``SELECT * FROM (SELECT k, avg(c) AS a FROM t GROUP BY k) S WHERE S.a > x``.
    Plans exactly like D7's HAVING."""
    s = df.groupBy(*keys).agg(F.avg(column).alias(name)).alias("S")
    return s.filter(F.col(f"S.{name}") > F.lit(min_avg))


def in_subquery(df: DataFrame, column: str, sub: DataFrame, negate: bool = False) -> DataFrame:
    """``column [NOT] IN (SELECT c FROM sub)``.

    IN is a left semi join.  NOT IN keeps SQL's three-valued logic: when the
    set is not empty, a NULL in it (or a NULL probe) leaves no row.  Rather
    than a null-aware anti join (a nested loop unless the set is broadcast),
    the set's size and NULL count are two scalar subqueries and the rest is
    an equi anti join that can shuffle or broadcast as AQE sees fit.
    """
    v = sub.columns[0]
    values = sub.select(F.col(v).alias("_q_in"))
    # the set is deduplicated first (partial aggregation per task), so a
    # value repeated a billion times is one build row, not a hot key
    distinct = values.filter(F.col("_q_in").isNotNull()).distinct()
    x = F.col(column)
    if not negate:
        return df.join(distinct, x == F.col("_q_in"), "left_semi")
    stats = scalar_struct(values.agg(F.count(F.lit(1)).alias("n"), F.count("_q_in").alias("nn")))
    n, nn = stats["n"], stats["nn"]
    keep = (n == 0) | (x.isNotNull() & (nn == n))
    return df.filter(keep).join(distinct, x == F.col("_q_in"), "left_anti")


def compare_all_any(df: DataFrame, column: str, op: str, sub: DataFrame,
                    quantifier: str) -> DataFrame:
    """``x op ALL (S)`` / ``x op ANY (S)`` for op in > >= < <=.

    Spark SQL has no quantified comparison.  S is reduced to one row
    (rows, NULLs, max, min), read back as one scalar subquery - no join:
      x > ALL S  <=> n = 0 OR (nulls = 0 AND x > max)   [NULL if unknown]
      x > ANY S  <=> x > max over the non-NULL values (NULL when only NULLs
                     could make it true; false when S is empty).
    """
    v = sub.columns[0]
    stats = scalar_struct(sub.agg(F.count(F.lit(1)).alias("n"), F.count(F.col(v)).alias("nn"),
                                  F.max(v).alias("mx"), F.min(v).alias("mn")))
    n, nn, mx, mn = stats["n"], stats["nn"], stats["mx"], stats["mn"]
    x = F.col(column)
    greater = op in (">", ">=")
    cmp = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
           "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[op]
    has_null = nn < n
    if quantifier.lower() == "all":
        bound = mx if greater else mn
        # every non-NULL value satisfies; any NULL makes it unknown
        cond = F.when(n == 0, F.lit(True)).when(x.isNull(), F.lit(None)) \
            .when(~cmp(x, bound), F.lit(False)).when(has_null, F.lit(None)).otherwise(F.lit(True))
    elif quantifier.lower() == "any":
        bound = mn if greater else mx
        cond = F.when(n == 0, F.lit(False)).when(x.isNull(), F.lit(None)) \
            .when(cmp(x, bound), F.lit(True)).when(has_null, F.lit(None)).otherwise(F.lit(False))
    else:
        raise ValueError("quantifier must be 'all' or 'any'")
    return df.filter(cond)


def exists_cardinality(df: DataFrame, on, sub: DataFrame, at_least: int = 1,
                       negate: bool = False) -> DataFrame:
    """Keep rows whose correlated set holds at least ``at_least`` rows
    (``EXISTS`` when 1; ``NOT`` form with ``negate``).

    ``on`` maps outer column -> column of ``sub``.  EXISTS is a semi join,
    NOT EXISTS an anti join; a count bound aggregates ``sub`` by its key
    first (map-side partial counts), then semi/anti joins on the key.
    """
    outer_cols, sub_cols = list(on.keys()), list(on.values())
    keyed = sub.select([F.col(c).alias(f"_q_k{i}") for i, c in enumerate(sub_cols)])
    # one row per key (counted per task first): no hot key on the build side
    keyed = (keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("_q_n"))
             .filter(F.col("_q_n") >= at_least).drop("_q_n"))
    cond = [F.col(o) == F.col(f"_q_k{i}") for i, o in enumerate(outer_cols)]
    return df.join(keyed, cond, "left_anti" if negate else "left_semi")


def scalar_subquery(df: DataFrame, name: str, agg: DataFrame) -> DataFrame:
    """E5: one value computed by a subquery, as a field of every row.

    ``agg`` must return one row and one column; it runs once as a scalar
    subquery and is inlined (no join).
    """
    return df.withColumn(name, agg.select(agg.columns[0]).scalar())


# ---------------------------------------------------------------- F: sort


def global_sort(df: DataFrame, order_cols, rank_col: str = "rank") -> DataFrame:
    """a total order of data larger than memory, with the rank attached.

    A range exchange sorts in parallel (spilling as needed); the rank comes
    from per-partition offsets (see ``functions.rank``), never from a
    one-partition window.
    """
    return global_rank(df, order_cols, rank_col)

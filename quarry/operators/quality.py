"""Keys and constraints as data-quality jobs.

Spark's file tables enforce no key, NOT NULL or length; these jobs find the
rows that break them.  Each is one or two aggregates or anti joins; counts
are partially aggregated per task, so a hot key costs no more than a cold
one.
"""

from __future__ import annotations

import functools
import itertools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.expr import materialize_small
from quarry.functions.rank import global_rank


def pk_check(df: DataFrame, keys) -> DataFrame:
    """K1/K2: key values that repeat or hold a NULL, with their row count.

    Returns (keys..., n).  Empty when ``keys`` is a primary key.
    """
    keys = list(keys)
    any_null = None
    for k in keys:
        any_null = F.col(k).isNull() if any_null is None else (any_null | F.col(k).isNull())
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") > 1) | any_null)


composite_pk_check = pk_check


def fk_check(child: DataFrame, parent: DataFrame, child_cols, parent_cols) -> DataFrame:
    """K3: child rows whose (non-NULL) key has no parent row.

    A NULL in any key column passes, as in SQL's MATCH SIMPLE.  The parent
    side is reduced to its distinct keys before the anti join.
    """
    child_cols, parent_cols = list(child_cols), list(parent_cols)
    keyed = parent.select([F.col(p).alias(f"_q_p{i}") for i, p in enumerate(parent_cols)]).distinct()
    present = None
    for c in child_cols:
        present = F.col(c).isNotNull() if present is None else (present & F.col(c).isNotNull())
    cond = [F.col(c) == F.col(f"_q_p{i}") for i, c in enumerate(child_cols)]
    return child.filter(present).join(keyed, cond, "left_anti")


def not_null_check(df: DataFrame, cols) -> DataFrame:
    """K4: NULL count per declared NOT NULL column, in one pass.

    Returns (column_name, nulls), one row per column.
    """
    cols = list(cols)
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    wide = wide.select([F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "nulls")


_CHAR = re.compile(r"^(?:var)?char\((\d+)\)$", re.I)


def _violation(c: Column, spec: str) -> Column:
    m = _CHAR.match(spec.strip())
    if m:
        return c.isNotNull() & (F.length(c.cast("string")) > int(m.group(1)))
    return c.isNotNull() & c.try_cast(spec).isNull()


def length_type_check(df: DataFrame, spec: dict) -> DataFrame:
    """K5: values that do not fit ``CHAR(n)``/``VARCHAR(n)`` or a type.

    ``spec`` maps column -> 'char(n)' | 'varchar(n)' | a Spark type name.  A
    value breaks a type when ``try_cast`` to it gives NULL (overflow or not a
    number).  Returns (column_name, violations).
    """
    cols = list(spec)
    wide = df.agg(*[F.sum(_violation(F.col(c), spec[c]).cast("long")).alias(c) for c in cols])
    wide = wide.select([F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "violations")


def apply_length_policy(df: DataFrame, spec: dict, policy: str = "reject") -> DataFrame:
    """K5 policy: ``reject`` raises when any value breaks ``spec``;
    ``truncate`` cuts text to ``n`` characters (types still must fit)."""
    if policy == "truncate":
        fixes = {}
        for c, s in spec.items():
            m = _CHAR.match(s.strip())
            if m:
                fixes[c] = F.substring(F.col(c).cast("string"), 1, int(m.group(1)))
        df = df.withColumns(fixes)
        spec = {c: s for c, s in spec.items() if not _CHAR.match(s.strip())}
        if not spec:
            return df
    elif policy != "reject":
        raise ValueError("policy must be 'reject' or 'truncate'")
    bad = length_type_check(df, spec).filter(F.col("violations") > 0).limit(1).collect()
    if bad:
        raise ValueError(f"length/type check failed: {bad[0]['column_name']} "
                         f"({bad[0]['violations']} values)")
    return df


def auto_increment(batch: DataFrame, start, order_cols, id_col: str = "id") -> DataFrame:
    """K6: next whole-number keys for new rows, ``start + 1, start + 2, ...``.

    ``start`` is a number or a one-value Column (e.g. a scalar subquery of
    the table's current maximum).  Order comes from a global rank (range
    sort + partition offsets), not a one-partition window.
    """
    start_col = start if isinstance(start, Column) else F.lit(start)
    ranked = global_rank(batch, order_cols, "_q_r")
    return ranked.withColumn(id_col, (start_col + F.col("_q_r")).cast("long")).drop("_q_r")


#: registers, or kept values, of a sketch: 2 to this power; its relative error
#: (1.04 / sqrt(registers)), and how many errors rule a group out
SKETCH_LOG_VALUES, SKETCH_ERROR, SKETCH_MARGIN = 12, 0.017, 6
#: sketches in one pass, and groups counted in one job
PASS_GROUPS, JOB_GROUPS = 128, 16
#: a group is first searched for repeats in one of this many classes of a column's values
SLICES = 64


def _in_parts(things: list, n: int):
    return (things[i:i + n] for i in range(0, len(things), n))


def _union(parts: list) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _any_null(group) -> Column:
    return functools.reduce(lambda x, y: x | y, [F.col(c).isNull() for c in group])


def _sketched(group) -> Column:
    """About how many combinations without NULL there are (one small binary
    buffer a group)."""
    hashed = F.when(~_any_null(group), F.xxhash64(*group))
    return F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(SKETCH_LOG_VALUES)))


def _column_facts(df: DataFrame, cols) -> tuple[int, dict, dict]:
    """Row count, and per column its NULLs and a sketched number of values: one
    pass, one row."""
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(cols)],
                 *[_sketched((c,)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    return (row["n"], {c: row["n"] - row[f"c{i}"] for i, c in enumerate(cols)},
            {c: row[f"d{i}"] for i, c in enumerate(cols)})


def _distinct_of(df: DataFrame, group) -> DataFrame:
    """One row (distinct_rows): the exact number of distinct combinations, of
    one column without NULL.  Reads the group's columns only; tasks drop their
    own repeats before the shuffle."""
    part = df.select(*[F.col(c).alias(f"_q_g{i}") for i, c in enumerate(group)])
    if len(group) == 1:
        part = part.filter(F.col("_q_g0").isNotNull())
    return part.distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))


def _repeats_in_slice(df: DataFrame, groups: list, values: dict) -> DataFrame:
    """The numbers (g) of the groups with a combination that repeats in their
    slice: the rows whose value of the group's most varied column has its
    hash in one of ``SLICES`` classes.  All rows of a combination are in
    its slice or none, so a repeat there is a repeat; only the slices' rows
    are hashed by group and shuffled, as 128-bit hashes."""
    by_column: dict[str, list] = {}
    for i, g in enumerate(groups):
        by_column.setdefault(max(g, key=lambda c: values[c]), []).append(
            F.struct(F.lit(i).alias("g"), F.xxhash64(*g).alias("h"), F.xxhash64(F.lit("second"), *g).alias("h2")))
    parts = [df.filter(F.pmod(F.xxhash64(c), F.lit(SLICES)) == 0).select(
        F.explode(F.array(*marks)).alias("m")).select("m.*") for c, marks in by_column.items()]
    return _union(parts).groupBy("g", "h", "h2").count().filter("count > 1").select("g").distinct()


def candidate_key_profile(df: DataFrame, max_width: int = 2, cols=None) -> DataFrame:
    """K7: which columns, or column groups up to ``max_width``, identify a row.

    Exact figures for every group, level by level: a group that holds a key
    of the level before has as many distinct combinations as rows and is not
    counted; every other one is counted from its own columns, so no row is
    multiplied by the number of groups.  NULL rows come from one pass, and
    for columns without NULL from none.  Returns (columns, rows,
    distinct_rows, null_rows, is_key); an empty table's groups are all keys.
    ``minimal_keys`` answers only which groups are keys, for far less.
    """
    spark = df.sparkSession
    cols = list(cols or df.columns)
    n, nulls, _ = _column_facts(df, cols)
    groups = [g for w in range(1, max_width + 1) for g in itertools.combinations(cols, w)]
    mixed = [g for g in groups if sum(nulls[c] > 0 for c in g) > 1]
    null_rows = {g: max(nulls[c] for c in g) for g in groups}
    for part in _in_parts(mixed, PASS_GROUPS):
        row = df.agg(*[F.count(F.when(_any_null(g), 1)).alias(f"n{i}") for i, g in enumerate(part)]).first()
        null_rows.update({g: row[f"n{i}"] for i, g in enumerate(part)})
    distinct: dict[tuple, int] = {}
    for w in range(1, max_width + 1):
        level = list(itertools.combinations(cols, w))
        whole = {g for g, d in distinct.items() if d == n}
        distinct.update({g: n for g in level if n == 0 or any(s in whole for s in itertools.combinations(g, w - 1))})
        open_ = [g for g in level if g not in distinct]
        for part in _in_parts(open_, JOB_GROUPS):
            counted = _union([_distinct_of(df, g).withColumn("g", F.lit(i)) for i, g in enumerate(part)])
            distinct.update({part[r["g"]]: r["distinct_rows"] for r in counted.collect()})  # one row a group
    out = [(",".join(g), n, distinct[g], null_rows[g], distinct[g] == n and not null_rows[g]) for g in groups]
    return spark.createDataFrame(out, "columns string, rows long, distinct_rows long, null_rows long, is_key boolean")


def minimal_keys(df: DataFrame, max_width: int = 3, cols=None) -> DataFrame:
    """K7: the smallest column groups, of up to ``max_width`` columns, that
    identify a row.  Returns (columns, width), a row for each.

    A lattice search.  A column with a NULL is in no key.  Going up a width
    at a time, a group is left out when it holds a key (not minimal), when
    its columns' numbers of values multiply to less than the row count, when
    a combination repeats in a slice of about a 64th of the rows, or when a
    sketch of its combinations stays six standard errors below the row
    count.  Only what is left is counted exactly, from its own columns.  A
    group is a key only by its exact count.
    """
    spark = df.sparkSession
    cols = list(cols or df.columns)
    n, nulls, values = _column_facts(df, cols)
    reach = n * (1 - SKETCH_MARGIN * SKETCH_ERROR)
    keys: list[tuple] = []
    usable = [c for c in cols if not nulls[c]]
    for w in range(1, max_width + 1):
        level = [g for g in itertools.combinations(usable, w) if not any(set(k) <= set(g) for k in keys)]
        level = [g for g in level
                 if math.prod(max(values[c], 1) for c in g) * (1 + SKETCH_MARGIN * SKETCH_ERROR) ** w >= n]
        seen = set()
        for part in _in_parts(level, PASS_GROUPS):
            seen |= {part[r["g"]] for r in _repeats_in_slice(df, part, values).collect()}  # at most one row a group
        level = [g for g in level if g not in seen]
        for part in _in_parts(level, PASS_GROUPS):
            row = df.agg(*[_sketched(g).alias(f"d{i}") for i, g in enumerate(part)]).first()
            seen |= {g for i, g in enumerate(part) if row[f"d{i}"] < reach}
        level = [g for g in level if g not in seen]
        for part in _in_parts(level, JOB_GROUPS):
            counted = _union([_distinct_of(df, g).withColumn("g", F.lit(i)) for i, g in enumerate(part)])
            keys += [part[r["g"]] for r in counted.collect() if r["distinct_rows"] == n]  # one row a group
    return spark.createDataFrame([(",".join(k), len(k)) for k in keys], "columns string, width int")


def candidate_fk_profile(df: DataFrame, cols, parent: DataFrame, pk: str) -> DataFrame:
    """K8: for each column of ``df``, the share of its distinct values found
    in ``parent[pk]`` (a column that is another table's key may be a
    foreign key).

    The candidate columns are unpivoted into (column, value), made distinct,
    and left-joined once to the parent's distinct keys.  Returns
    (column_name, distinct_values, found, ratio).
    """
    cols = list(cols)
    key_type = parent.schema[pk].dataType
    # values are compared as text next to their value in the key's type; a value
    # that the type cannot hold matches no key
    long = df.select([F.struct(F.col(c).cast("string").alias("text"), F.col(c).try_cast(key_type).alias("value")).alias(c) for c in cols]).unpivot(
        [], cols, "column_name", "_q_v").select("column_name", "_q_v.*").filter(F.col("text").isNotNull())
    long = long.select("column_name", F.when(F.col("value").isNull(), F.col("text")).alias("text"), "value").distinct()
    keys = parent.select(F.col(pk).alias("_q_pk")).distinct()
    hit = long.join(keys, F.col("value") == F.col("_q_pk"), "left")
    return hit.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.count("_q_pk").alias("found")).withColumn(
        "ratio", F.round(F.col("found") / F.col("distinct_values"), 6))


def _value_class(kind) -> str | None:
    """Columns are compared within one of these classes."""
    name = kind.typeName()
    if name in ("byte", "short", "integer", "long"):
        return "bigint"
    return name if name in ("string", "date", "timestamp", "timestamp_ntz") else None


def inclusion_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """K8 over all column pairs of all ``tables``: where may a foreign key be?

    Returns (child_table, child_column, parent_table, parent_column,
    distinct_values): every non-empty whole-number, text, date or timestamp
    column, all of whose values (NULL aside) are in another column of the same
    class that is a key of its table (no NULL, no repeat).

    One pass a table keeps, of each column, the values with the smallest
    hashes.  If a column's values all lie in another, no kept hash below
    both sketches' bounds is missing there, so a pair whose sketches differ
    is ruled out without error.  Only the pairs left are joined, on
    distinct values.  The driver holds names and numbers of columns, no
    values; sketches (at most 32 KB a column) go through a join of columns.
    """
    spark = next(iter(tables.values())).sparkSession
    facts, sketches = [], []
    for name, df in tables.items():
        kinds = {f.name: _value_class(f.dataType) for f in df.schema.fields}
        cols = [c for c, k in kinds.items() if k]
        if not cols:
            continue
        hashed = [F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c).cast(kinds[c]))) for c in cols]
        wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(cols)],
                      *[F.theta_sketch_agg(h, F.lit(SKETCH_LOG_VALUES)).alias(f"s{i}") for i, h in enumerate(hashed)])
        sketches.append(wide.select(F.col("n"), F.explode(F.array(*[
            F.struct(F.lit(name).alias("t"), F.lit(c).alias("c"), F.lit(kinds[c]).alias("k"), F.col(f"c{i}").alias("filled"),
                     F.col(f"s{i}").alias("s")) for i, c in enumerate(cols)])).alias("x")).select("n", "x.*"))
    schema = "child_table string, child_column string, parent_table string, parent_column string, distinct_values long"
    if not sketches:
        return spark.createDataFrame([], schema)
    every = materialize_small(_union(sketches))  # a row for each column
    child, parent = every.filter("filled > 0").alias("a"), every.filter("filled = n").alias("b")
    apart = F.theta_sketch_estimate(F.theta_difference(F.col("a.s"), F.col("b.s")))
    size = F.theta_sketch_estimate(F.col("b.s"))
    # a key has as many values as rows, give or take the sketch's error
    near_key = size >= F.col("b.n") * (1 - SKETCH_MARGIN / 2 ** (SKETCH_LOG_VALUES / 2))
    same = (F.col("a.k") == F.col("b.k")) & ((F.col("a.t") != F.col("b.t")) | (F.col("a.c") != F.col("b.c")))
    pairs = child.join(parent, same & (apart == 0) & near_key).select("a.t", "a.c", "b.t", "b.c", "a.k").collect()
    values = {}
    for t, c, k in {(p[0], p[1], p[4]) for p in pairs} | {(p[2], p[3], p[4]) for p in pairs}:
        values[t, c] = tables[t].select(F.col(c).cast(k).alias("_q_v")).filter(F.col("_q_v").isNotNull())
    repeats = {}
    for part in _in_parts(sorted({(p[2], p[3]) for p in pairs}), JOB_GROUPS):
        counted = _union([values[x].groupBy("_q_v").count().agg(F.max("count").alias("most")).withColumn("g", F.lit(i))
                          for i, x in enumerate(part)])
        repeats.update({part[r["g"]]: r["most"] for r in counted.collect()})
    found = []
    for part in _in_parts([p for p in pairs if repeats[p[2], p[3]] == 1], JOB_GROUPS):
        checks = []
        for t, c, pt, pc, _ in part:
            hit = values[t, c].distinct().join(values[pt, pc].select(F.col("_q_v").alias("_q_p")), F.col("_q_v") == F.col("_q_p"), "left")
            checks.append(hit.agg(F.count(F.lit(1)).alias("distinct_values"), F.count("_q_p").alias("_q_found")).filter(
                F.col("distinct_values") == F.col("_q_found")).select(
                F.lit(t).alias("child_table"), F.lit(c).alias("child_column"), F.lit(pt).alias("parent_table"),
                F.lit(pc).alias("parent_column"), "distinct_values"))
        found.append(materialize_small(_union(checks)))
    return _union(found) if found else spark.createDataFrame([], schema)

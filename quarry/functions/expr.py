"""Column expressions shared by the operators (all JVM-side, codegen'd)."""

from __future__ import annotations

from decimal import ROUND_FLOOR, Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def stable_hash(salt: str, *cols) -> Column:
    """A 32-bit whole number from ``md5(salt || c1 || c2 ...)``.

    The first eight hex digits of the digest, read as base 16.  DuckDB gives
    the same value with ``('0x' || substr(md5(salt || ...), 1, 8))::BIGINT``,
    so samples and splits made with it can be checked there.
    """
    parts = [F.lit(salt)] + [col_of(c).cast("string") for c in cols]
    digest = F.md5(F.concat(*parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def unit_hash(salt: str, *cols) -> Column:
    """``stable_hash`` scaled to [0, 1)."""
    return stable_hash(salt, *cols) / F.lit(float(2 ** 32))


_WHOLE = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def typed_literal(df: DataFrame, column: str, value) -> Column:
    """A literal cast to the type of ``df[column]``.

    ``INCOME > '1000'`` compares numbers: casting the literal (not the
    column) keeps the predicate on the raw column, so it reaches the scan.
    """
    return F.lit(value).cast(df.schema[column].dataType)


def compare(df: DataFrame, column: str, op: str, value) -> Column:
    """``column op value`` for op ``=``, ``<>`` or ``>``, with the meaning of
    the value as it is, on the raw column so that it is pushed down.

    A number column may meet any number, or text that holds one.  Where the
    column's type cannot hold the value, the bound is moved to the next value
    it can hold (``x > -20.5`` on INT is ``x > -21``), or the test is settled
    for all values (``x = 18.5`` is false, ``x <> 18.5`` true unless NULL).
    Text that is no number compares as NULL: no rows.
    """
    c, kind = F.col(column), df.schema[column].dataType.simpleString()
    apply = {"=": lambda v: c == v, "<>": lambda v: c != v, ">": lambda v: c > v}[op]
    if kind not in _WHOLE and kind != "float":
        if kind == "double" and isinstance(value, str):
            return apply(F.lit(value).try_cast("double"))
        return apply(typed_literal(df, column, value) if isinstance(value, str) else F.lit(value))
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        return F.lit(None).cast("boolean")
    if not number.is_finite():
        return apply(F.lit(float(number)))
    never, always = c.isNull() & c.isNotNull(), c.isNotNull()
    if kind == "float":
        import numpy as np
        held = np.float32(number)
        if Decimal(float(held)) != number:
            if op != ">":
                return never if op == "=" else always
            if Decimal(float(held)) > number:  # x > number is x > the next float below
                held = np.nextafter(held, np.float32("-inf"))
        return apply(F.lit(float(held)).cast("float"))
    bits = _WHOLE[kind]
    low, high = -(1 << bits - 1), (1 << bits - 1) - 1
    down = int(number.to_integral_value(ROUND_FLOOR))
    if op == ">":
        return never if down >= high else always if down < low else apply(F.lit(down).cast(kind))
    if down != number or not low <= down <= high:
        return never if op == "=" else always
    return apply(F.lit(down).cast(kind))


def round_cols(df: DataFrame, digits: int, cols=None) -> DataFrame:
    """Round the given (default: all floating) columns to ``digits``."""
    names = cols if cols is not None else [
        f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


def scalar_struct(agg: DataFrame) -> Column:
    """All columns of a one-row DataFrame as ONE scalar subquery (a struct).

    Read fields with ``s[name]``; every field shares the same subquery, so
    the input of ``agg`` is scanned once however many fields are used.
    """
    return agg.select(F.struct(*agg.columns).alias("_q_s")).scalar()


def materialize_small(df: DataFrame) -> DataFrame:
    """Cut the lineage of an aggregated table that several branches of a plan
    read, so the large input behind it is scanned once.

    It is written as parquet in the shared folder (it survives a lost
    executor, and its size is known to the planner).
    """
    from quarry.session import work_path
    path = work_path(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out

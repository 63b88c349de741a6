"""Table changes.

Inserts, updates and deletes are DataFrame functions: they return the new
table and never mutate the input.  A table kept on storage is a folder::

    <table>/_meta/           the declared schema, keys and rules (JSON)
    <table>/data/<uuid>/     the rows of one commit, written by Spark
    <table>/_versions/<n>    one small file per commit: the live data folders

A commit writes its rows into a fresh folder, claims the next version, which
only one writer can do, and renames a finished file to its number.  Readers use the latest version,
so they see all of a commit or none of it, also if a writer dies on the way.  Appends never rewrite earlier
rows.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quarry.operators import quality as Q

# ------------------------------------------------------------------ storage helpers


#: how long a claim to a version holds without its version file
CLAIM_SECONDS = 60.0


class CommitConflict(RuntimeError):
    """Another writer committed first, or is about to."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _snapshot(spark: SparkSession, table: str) -> tuple[int, dict]:
    """The latest version and what it holds: data folders, and for each
    named writer the last batch it applied."""
    fs, p = _fs(spark, f"{table}/_versions")
    names = sorted((s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().isdigit()), reverse=True) if fs.exists(p) else []
    for name in names:  # a file that cannot be read is what a dead writer left: the version before holds
        try:
            return int(names[0]), json.loads(_read_text(spark, f"{table}/_versions/{name}"))
        except ValueError:
            continue
    return int(names[0]) if names else 0, {"data": [], "applied": {}}


def _commit(spark: SparkSession, table: str, version: int, state: dict) -> None:
    """Create version ``version``, whole or not at all; only one writer can.

    The state is written under a name that no reader looks at, and gets its
    number by a rename that never replaces a file, so a writer may die at any
    point.  A store whose rename would replace files is refused by the check
    before it unless two writers come in the same moment.
    """
    fs, p = _fs(spark, f"{table}/_versions/{version:012d}")
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/_versions/draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(state).encode()))
    stream.close()
    if fs.exists(p) or not _claimed(spark, table, version) or not fs.rename(draft, p):
        fs.delete(draft, False)
        raise CommitConflict(f"version {version} of {table} exists")


def _claimed(spark: SparkSession, table: str, version: int) -> bool:
    """Take the right to write a version: a file that only one can create.  A
    claim whose writer died is taken over after ``CLAIM_SECONDS``, by deleting
    it and claiming again."""
    fs, claim = _fs(spark, f"{table}/_versions/claim-{version:012d}")
    if fs.createNewFile(claim):
        return True
    age = time.time() - fs.getFileStatus(claim).getModificationTime() / 1000
    if age < CLAIM_SECONDS:
        return False
    fs.delete(claim, False)
    return bool(fs.createNewFile(claim))


def create_table(spark: SparkSession, path: str, schema: StructType, drop_existing: bool = True,
                 key=None, foreign=(), lengths: dict | None = None) -> None:
    """A5: drop the table if it exists, then create it with a declared schema.

    Spark file tables store ``NOT NULL`` but do not enforce it (an insert
    without the column succeeds with NULL), so the schema, the primary
    ``key``, the ``foreign`` keys (columns, parent table's path, parent's
    columns) and the ``lengths`` (K5) are kept for the checks of every
    commit.  A folder that is no such table is never dropped.
    """
    if _exists(spark, path):
        if not drop_existing:
            raise FileExistsError(path)
        if not _exists(spark, f"{path}/_meta"):
            raise ValueError(f"{path} is no table of this library")
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    rules = {"schema": schema.jsonValue(), "key": list(key or []), "lengths": lengths or {},
             "foreign": [[list(c), p, list(pc)] for c, p, pc in foreign]}
    meta = spark.createDataFrame([(json.dumps(rules),)], "rules string")
    meta.coalesce(1).write.text(f"{path}/_meta")


def table_rules(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/_meta").first()[0])


def table_schema(spark: SparkSession, path: str) -> StructType:
    return StructType.fromJson(table_rules(spark, path)["schema"])


def _rows_of(spark: SparkSession, path: str, schema: StructType, state: dict) -> DataFrame:
    if not state["data"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{b}" for b in state["data"]])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the latest commit's data folders."""
    return _rows_of(spark, path, table_schema(spark, path), _snapshot(spark, path)[1])


def _conform(df: DataFrame, schema: StructType, lenient: bool = False) -> DataFrame:
    """Columns in table order and type; missing ones become NULL, unknown
    ones are refused.  ``lenient``: values that do not fit become NULL."""
    if unknown := [c for c in df.columns if c not in schema.names]:
        raise ValueError(f"no such columns: {unknown}")
    have = {f.name: f.dataType for f in df.schema.fields}

    def column(f):
        c = F.col(f.name) if f.name in have else F.lit(None)
        cast = c.try_cast if lenient and have.get(f.name, f.dataType) != f.dataType else c.cast
        return cast(f.dataType).alias(f.name)
    return df.select([column(f) for f in schema.fields])


# ------------------------------------------------------------------ A6-A8 inserts


def insert_row(df: DataFrame, row: tuple) -> DataFrame:
    """Append one full literal row (values in table column order)."""
    new = df.sparkSession.createDataFrame([tuple(row)], df.schema)
    return df.unionByName(new)


def insert_partial(df: DataFrame, rows, cols) -> DataFrame:
    """Insert naming a subset of columns; the others become NULL.

    The literal rows are typed by the named columns of the table, then
    aligned by name (``allowMissingColumns``) and cast to the table schema.
    """
    sub = StructType([df.schema[c] for c in cols])
    new = df.sparkSession.createDataFrame([tuple(r) for r in rows], sub)
    return df.unionByName(new, allowMissingColumns=True).select(
        [F.col(f.name).cast(f.dataType) for f in df.schema.fields])


def insert_batch(df: DataFrame, batch: DataFrame) -> DataFrame:
    """Append many rows at once; the batch is matched to the table by
    column name and cast to the table's types (the reference binds every
    value as text, ``%s``)."""
    return df.unionByName(_conform(batch, df.schema))


# ------------------------------------------------------------------ A10, A11


def update_where(df: DataFrame, pred: Column, assignments: dict) -> DataFrame:
    """A10: ``UPDATE t SET col = expr WHERE pred``, copy-on-write.

    A row whose predicate is NULL is left alone, as in SQL.
    """
    hit = F.coalesce(pred, F.lit(False))
    return df.withColumns({c: F.when(hit, e).otherwise(F.col(c)).cast(df.schema[c].dataType)
                           for c, e in assignments.items()})


def delete_where(df: DataFrame, pred: Column) -> DataFrame:
    """``DELETE FROM t WHERE pred``.

    Only rows where ``pred`` is TRUE go; a NULL predicate keeps the row
    (plain ``NOT pred`` would drop it too).
    """
    return df.filter(~F.coalesce(pred, F.lit(False)))


# ------------------------------------------------------------------ A9 atomic batch

VERDICT = "rule string, violations long, committed boolean"


def batch_checks(table: DataFrame, batch: DataFrame, schema: StructType, key=None,
                 lengths: dict | None = None, foreign=()) -> DataFrame:
    """Rule violations the batch would cause; (rule, violations).

    * ``type``: values that their column's type cannot hold, for columns that
      come in another type.
    * ``primary_key``: distinct batch keys that repeat inside the batch,
      meet an existing key, or are NULL.  Only existing rows whose key is in the
      batch are read past the scan (semi join), not the whole table.
    * ``foreign_key``: batch rows whose key no parent row has (K3); ``foreign``
      holds (columns, parent rows, parent columns).
    * ``not_null``: NULLs in the schema's non-nullable columns.
    * ``length_type``: values that do not fit ``lengths`` (K5).
    """
    raw, batch = batch, _conform(batch, schema, lenient=True)
    parts = []

    def add(rule: str, checked: DataFrame, count: Column) -> None:
        parts.append(checked.agg(F.coalesce(count, F.lit(0)).cast("long").alias("violations")).select(F.lit(rule).alias("rule"), "violations"))

    other = [f for f in schema.fields if f.name in raw.columns and raw.schema[f.name].dataType != f.dataType]
    if other:
        add("type", raw, sum((F.sum((F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).cast("long")) for f in other), F.lit(0)))
    if key:
        key = list(key)
        bkeys = batch.select(*key)
        existing = table.select(*key).join(bkeys.distinct(), key, "left_semi")
        add("primary_key", Q.pk_check(existing.unionByName(bkeys), key), F.count(F.lit(1)))
    for columns, parent, parent_columns in foreign:
        add("foreign_key", Q.fk_check(batch, parent, list(columns), list(parent_columns)), F.count(F.lit(1)))
    required = [f.name for f in schema.fields if not f.nullable]
    if required:
        add("not_null", Q.not_null_check(batch, required), F.sum("nulls"))
    if lengths:
        add("length_type", Q.length_type_check(batch, lengths), F.sum("violations"))
    if not parts:
        return table.sparkSession.createDataFrame([("none", 0)], "rule string, violations long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _apply(spark: SparkSession, path: str, make, key, lengths, replace: bool, writer=None, number=None, retries: int = 5) -> DataFrame:
    """Check and commit what ``make`` gives for the current rows."""
    rules = table_rules(spark, path)
    schema = StructType.fromJson(rules["schema"])
    key = list(key) if key else rules["key"]
    lengths = {**rules["lengths"], **(lengths or {})}
    foreign = [(c, read_table(spark, p), pc) for c, p, pc in rules["foreign"]]
    for attempt in range(retries):
        version, state = _snapshot(spark, path)
        if writer is not None and state["applied"].get(writer, -1) >= number:
            return spark.createDataFrame([("replay", 0, True)], VERDICT)
        table = _rows_of(spark, path, schema, state)
        rows = make(table)
        against = spark.createDataFrame([], schema) if replace else table
        verdict = batch_checks(against, rows, schema, key, lengths, foreign).collect()  # a row for each rule
        ok = all(r["violations"] == 0 for r in verdict)
        if ok:
            folder = uuid.uuid4().hex
            _conform(rows, schema).write.parquet(f"{path}/data/{folder}")
            applied = {**state["applied"], **({writer: number} if writer is not None else {})}
            try:
                _commit(spark, path, version + 1, {"data": [folder] if replace else [*state["data"], folder], "applied": applied})
            except CommitConflict:  # someone else was first: check again against what is there now
                fs, p = _fs(spark, f"{path}/data/{folder}")
                fs.delete(p, True)
                if attempt + 1 == retries:
                    raise
                continue
        return spark.createDataFrame([(r["rule"], int(r["violations"]), ok) for r in verdict], VERDICT)
    raise CommitConflict(path)


def _holding(spark: SparkSession, path: str, table: DataFrame, hit: Column, folders: list[str]) -> list[str]:
    """The data folders that hold a row for which ``hit`` is true: one scan of
    the predicate's columns, one row a folder."""
    if not folders:
        return []
    folder = F.regexp_extract(F.input_file_name(), "/data/([0-9a-f]+)/", 1)
    found = {r[0] for r in table.filter(hit).select(folder.alias("_q_folder")).distinct().collect()}
    return [f for f in folders if f in found]


def _change_where(spark: SparkSession, path: str, pred: Column, assignments: dict | None, retries: int = 5) -> DataFrame:
    rules = table_rules(spark, path)
    schema = StructType.fromJson(rules["schema"])
    hit = F.coalesce(pred, F.lit(False))
    touched = set(assignments or ())
    if unknown := touched - set(schema.names):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    key = rules["key"] if touched & set(rules["key"]) else None
    lengths = {c: v for c, v in rules["lengths"].items() if c in touched}
    loose = StructType([f if f.name in touched else StructField(f.name, f.dataType) for f in schema.fields])  # what is not assigned is not checked again
    for attempt in range(retries):
        version, state = _snapshot(spark, path)
        table = _rows_of(spark, path, schema, state)
        folders = _holding(spark, path, table, hit, state["data"])
        if not folders:
            return spark.createDataFrame([("none", 0, True)], VERDICT)
        old = _rows_of(spark, path, schema, {"data": folders})
        verdict, ok, new = [{"rule": "none", "violations": 0}], True, None
        if assignments is None:
            new = delete_where(old, pred)
        else:
            new = update_where(old, pred, assignments)
            foreign = [(c, read_table(spark, p), pc) for c, p, pc in rules["foreign"] if touched & set(c)]
            changed = update_where(old.filter(hit), F.lit(True), assignments)
            verdict = batch_checks(table.filter(~hit), changed, loose, key, lengths, foreign).collect()  # a row for each rule
            ok = all(r["violations"] == 0 for r in verdict)
        if ok:
            folder = uuid.uuid4().hex
            _conform(new, schema).write.parquet(f"{path}/data/{folder}")
            stay = [f for f in state["data"] if f not in folders]
            try:
                _commit(spark, path, version + 1, {"data": [*stay, folder], "applied": state["applied"]})
            except CommitConflict:
                fs, p = _fs(spark, f"{path}/data/{folder}")
                fs.delete(p, True)
                if attempt + 1 == retries:
                    raise
                continue
        return spark.createDataFrame([(r["rule"], int(r["violations"]), ok) for r in verdict], VERDICT)
    raise CommitConflict(path)


def update_stored(spark: SparkSession, table_path: str, pred: Column, assignments: dict) -> DataFrame:
    """A10 on a stored table, as its next version; returns the verdict.

    Copy-on-write by data folder: only folders that hold a row with a true
    ``pred`` are written anew, all others stay as they are, and without such a
    row there is no new version.  Only the changed rows are checked, against
    the rules of the assigned columns; the key is compared with the rest of the
    table only if a key column is assigned.  A broken rule changes nothing.
    """
    return _change_where(spark, table_path, pred, assignments)


def delete_stored(spark: SparkSession, table_path: str, pred: Column) -> DataFrame:
    """A11 on a stored table, by data folder as ``update_stored``: what stays
    breaks no rule that it kept before, so nothing is checked."""
    return _change_where(spark, table_path, pred, None)


def atomic_batch(spark: SparkSession, table_path: str, batch: DataFrame, key=None, lengths: dict | None = None,
                 writer: str | None = None, batch_number: int | None = None) -> DataFrame:
    """All-or-nothing append.

    The rules declared with the table, and any given here, are checked on
    the executors; the driver reads one small verdict row per rule.  If any
    is broken nothing is written and the table is unchanged; otherwise the
    batch becomes part of the next version.  If another writer commits in
    between, the checks are made again.  A ``writer`` with a
    ``batch_number`` makes the call repeatable: a number it has already
    applied is a replay and is not written again.  Returns (rule,
    violations, committed).
    """
    if (writer is None) != (batch_number is None):
        raise ValueError("a batch number belongs to a named writer")
    _conform(batch, table_schema(spark, table_path), lenient=True)  # unknown columns are refused at once
    return _apply(spark, table_path, lambda rows: batch, key, lengths, False, writer, batch_number)


def change_table(spark: SparkSession, table_path: str, change) -> DataFrame:
    """A9 for ``change: DataFrame -> DataFrame`` (A10, A11): the changed rows
    are checked as a whole and become the table's next version, or, if a
    rule is broken, the table stays as it is.  Returns the verdict."""
    return _apply(spark, table_path, change, None, None, True)

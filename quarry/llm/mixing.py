"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key.  Within a source the keys are ordered
in key ranges (blocks) of a few hundred documents, so a source with a third
of all rows is sorted by many tasks.  Prefix sums of the sizes come from
block totals, summed at two levels, plus a running sum inside each block.  A
source's budget is met by whole epochs and a cut of the key order at the
budget that is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.joins import bounded_broadcast
from quarry.functions.rank import global_rank
from quarry.llm.common import row_key, text_of, whole_row, written

WORD = r"[^\x20\x09-\x0D]+"
#: documents of a block, and blocks of a block group, on average
BLOCK_DOCS, GROUP_BLOCKS = 256, 1024


def words(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """(source, size, target) of a (source, size) table, one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn.  They
    split ``share`` of all sizes by weight; a target stops at ``most`` times
    its source's size and the excess goes to the others by weight, until none
    is above.  Each round is one aggregate of the table.
    """
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "_rank")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = ranked.select("source", "size", turn.alias("weight"), (F.col("size") * F.lit(most)).alias("cap")).checkpoint()
    total = share * (table.agg(F.sum("size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        row = table.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))),
                        F.count(F.when(full, 1))).first()
        caps, weight, now = row[0] or 0.0, row[1] or 0.0, row[2]
        if not weight or now == capped:
            break
        capped, level = now, (total - caps) / weight
    return table.select("source", "size", F.when(full, F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7,
        keep: tuple[str, ...] = (), **plan) -> DataFrame:
    """(id, size, source_size, target, taken), one row per row of ``docs``,
    and the columns of ``keep``.

    The size is the number of words (null text: 0); documents without words
    are taken 0 times.  The document at the cut is taken if at least half of
    it fits.  The key is a hash of seed, id and text, so reruns agree;
    identical rows have equal keys and sizes and are interchangeable.  A null
    source is a source of its own.  No documents: no rows.
    """
    text = text_of(text_col)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.md5(text)))
    rows = written(docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), words(text).alias("size"),
                               key.alias("_key"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]), "mix-sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("_n")).checkpoint()
    targets = source_targets(by_source.select("source", "size"), **plan)
    epochs = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    budgets = bounded_broadcast(
        by_source.select(F.col("source").alias("_s"), "_n").join(targets, F.col("_s").eqNullSafe(F.col("source"))).select(
            "_s", F.col("size").alias("source_size"), "target", epochs.alias("_epochs"),
            (F.col("target") - epochs * F.col("size")).alias("_rest"), F.ceil(F.col("_n") / BLOCK_DOCS).alias("_blocks")), 100_000)
    at = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    dealt = (rows.join(budgets, rows["source"].eqNullSafe(budgets["_s"])).drop("_s")
             .withColumn("_src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
             .withColumn("_block", F.floor(at * F.col("_blocks"))))
    group = F.floor(F.col("_block") / GROUP_BLOCKS)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy("_src", "_block").agg(F.sum("size").alias("_sum")).withColumn("_group", group)
    groups = blocks.groupBy("_src", "_group").agg(F.sum("_sum").alias("_gsum"))
    groups = groups.select("_src", "_group", F.coalesce(F.sum("_gsum").over(before("_src").orderBy("_group")), F.lit(0)).alias("_goff"))
    offsets = (blocks.withColumn("_boff", F.coalesce(F.sum("_sum").over(before("_src", "_group").orderBy("_block")), F.lit(0)))
               .join(groups, ["_src", "_group"]).select("_src", "_block", (F.col("_goff") + F.col("_boff")).alias("_off")))
    inside = before("_src", "_block").orderBy("_key", "_id", "size")
    summed = dealt.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["_src", "_block"])
    first = F.col("_off") + F.col("_in")
    taken = F.col("size") * (F.col("_epochs") + F.when(first + F.col("size") / 2 <= F.col("_rest"), 1).otherwise(0))
    return summed.select(F.col("_id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"),
                         *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **plan) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: left out, once or repeated.
    Documents without words are not taken."""
    row = F.col("_row")
    keyed = docs.select(whole_row(docs).alias("_row")).withColumn("_key", row_key())
    flat = keyed.select("_key", row.getField(id_col).alias("_i"), row.getField(text_col).alias("_t"), row.getField(source_col).alias("_s"))
    taken = mix(flat, "_i", "_t", "_s", keep=("_key",), **plan)
    copies = (taken.filter(F.col("taken") > 0).groupBy("_key").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("_copies")))
    rows = keyed.dropDuplicates(["_key"]).join(copies, "_key")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


#: the same result of the registered query, by one window over each source
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (SELECT *, cap / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
             sum(weight) OVER (ORDER BY ratio DESC ROWS UNBOUNDED PRECEDING) AS rest_weight FROM r),
l AS (SELECT min_by((total - caps) / rest_weight, ratio) FILTER (ratio > (total - caps) / rest_weight) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN cap <= weight * level OR level IS NULL THEN cap ELSE weight * level END AS target FROM r, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * (b.epochs + CASE WHEN coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0::DOUBLE
                 <= b.target - b.epochs * b.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""

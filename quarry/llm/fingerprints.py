"""Order MinHash fingerprints of documents, with DataFrame functions only.

A text's words (cut to pieces of at most 16 characters) give k-mers, each
numbered by its occurrence, so that repeats count.  A hash deals the
numbered k-mers to slots; each slot selects its ``tuple_size`` = 2 minimal
ones, puts them back in text order and hashes them as a pair.  A text that
is reordered keeps its k-mers but not the pairs, so likeness follows edit
distance rather than shared vocabulary.  A slot that holds a single k-mer
hashes it alone; one without any has no signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import shuffle_partitions, text_of

PIECE = r"\S{1,16}"
SLOT_BITS = 6
#: a packed number: 33 bits of hash (the first the slot), 30 of place in the text
PLACE_BITS, HASH_BITS = 30, 33
PLACE, HASH, SIGNATURE = (1 << PLACE_BITS) - 1, (1 << HASH_BITS) - 1, (1 << 24) - 1
#: search levels of block bounds
FAN = 64


def _hash(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE_BITS)


def _slot(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE_BITS + HASH_BITS - SLOT_BITS)


def _pack(h: Column, place: Column) -> Column:
    return F.shiftleft(h.bitwiseAND(F.lit(HASH)), PLACE_BITS).bitwiseOR(place.cast("long"))


def _range(n: Column) -> Column:
    """0 to n - 1; none for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_signatures(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with ``out``: array<int>, (slot << 24 | hash) by slot.

    Each step is a column of its own, which later ones use more than once, so
    that the optimizer does not put its expression in their place.
    """
    at = lambda i: F.get(F.col("_c"), i)
    # sorted by hash, then place: a k-mer's occurrences lie side by side in text order
    rows = rows.withColumn("_tok", F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0)))
    count = F.greatest(F.size("_tok") - 1, F.least(F.size("_tok"), F.lit(1)))
    rows = rows.withColumn("_c", F.sort_array(F.transform(_range(count), lambda i: _pack(
        F.xxhash64(F.get(F.col("_tok"), i), F.get(F.col("_tok"), i + 1)), i)))).drop("_tok")
    rows = rows.withColumn("_runs", F.filter(_range(F.size("_c")), lambda j: ~_hash(at(j)).eqNullSafe(_hash(at(j - 1)))))
    ends = lambda r: F.coalesce(F.get(F.col("_runs"), r + 1), F.size("_c"))
    numbered = F.transform(_range(F.size("_runs")), lambda r: F.transform(
        F.sequence(F.get(F.col("_runs"), r), ends(r) - 1),
        lambda j: _pack(F.xxhash64(_hash(at(j)), j - F.get(F.col("_runs"), r)), at(j).bitwiseAND(F.lit(PLACE)))))
    rows = rows.withColumn("_o", F.sort_array(F.flatten(numbered))).drop("_c", "_runs")
    rows = rows.withColumn("_s", F.filter("_o", lambda x, j: ~_slot(x).eqNullSafe(_slot(F.get(F.col("_o"), j - 2))))).drop("_o")
    sel = lambda i: F.get(F.col("_s"), i)
    rows = rows.withColumn("_f", F.filter(_range(F.size("_s")), lambda j: ~_slot(sel(j)).eqNullSafe(_slot(sel(j - 1)))))
    place = lambda x: x.bitwiseAND(F.lit(PLACE))

    def signature(j: Column) -> Column:
        x, y = sel(j), sel(j + 1)
        pair = (F.when(~_slot(x).eqNullSafe(_slot(y)), F.xxhash64(_hash(x)))
                .when(place(x) < place(y), F.xxhash64(_hash(x), _hash(y))).otherwise(F.xxhash64(_hash(y), _hash(x))))
        return F.shiftleft(_slot(x), 24).bitwiseOR(pair.bitwiseAND(F.lit(SIGNATURE))).cast("int")

    return rows.withColumn(out, F.transform("_f", signature)).drop("_s", "_f")


def shown(signatures: Column) -> Column:
    """Eight hex digits for each slot that has a signature."""
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Equal signatures by slots that have one in either; 1 if none has."""
    slots = lambda c: F.transform(c, lambda x: F.shiftright(x, 24))
    either = F.size(F.array_union(slots(a), slots(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _bounds(docs: DataFrame, id_col: str, blocks: int) -> list[int]:
    """Ids that part the documents in about equal blocks (a fixed number)."""
    cuts = [i / blocks for i in range(1, blocks)]
    found = docs.agg(F.percentile_approx(id_col, F.array(*map(F.lit, cuts)), 10 * blocks)).first()[0] if cuts else None
    return sorted(set(found or []))


def _block(column: Column, bounds: list[int]) -> Column:
    """How many bounds are below: a search by fans of ``FAN``; -1 for null."""
    def below(values: list[int]) -> Column:
        return F.size(F.filter(F.lit(values), lambda b: b < column)) if values else F.lit(0)
    if len(bounds) <= FAN:
        n = below(bounds)
    else:
        step = -(-len(bounds) // FAN)
        tops = bounds[step - 1::step]
        every = F.lit(bounds)
        first = below(tops)
        n = first * step + F.size(F.filter(F.slice(every, first * step + 1, F.lit(step)), lambda b: b < column))
    return F.when(column.isNull(), F.lit(-1)).otherwise(n)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next), one row per row of ``docs``.

    The next document is the one after in descending id, ids that are null
    last, rows of one id by their text's hash; the last one's is the first.  A
    document alone is its own next.  A null text is empty; a text without
    words has an empty fingerprint, and two of those are alike (1.0).  Other
    columns are not read.  No documents: no rows.

    Documents meet the next one in blocks of ids; each block also gets the
    first document of the block after it.
    """
    n = blocks or min(FAN * FAN, 4 * shuffle_partitions(docs.sparkSession))
    bounds = _bounds(docs, id_col, n)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    rows = rows.withColumn("_block", _block(F.col("_id"), bounds))
    # the first document of each block, found on ids alone; at most one per block
    tops = (docs.select(F.col(id_col).cast("long").alias("_top")).withColumn("_b", _block(F.col("_top"), bounds))
            .groupBy("_b").agg(F.max("_top").alias("_top")))
    places = [r["_b"] for r in tops.select("_b").orderBy(F.desc("_b")).collect()]  # numbers of blocks
    after = dict(zip(places[1:] + places[:1], places))
    heads = (rows.join(F.broadcast(tops), rows["_id"].eqNullSafe(F.col("_top")) & (F.col("_block") == F.col("_b")))
             .groupBy("_block").agg(F.max(F.struct("_h", "_text", "_id")).alias("x")).select("_block", "x.*"))
    target = F.element_at(F.create_map(*[F.lit(x) for pair in after.items() for x in pair]) if after else F.create_map(F.lit(0), F.lit(0)), F.col("_block"))
    heads = heads.withColumn("_block", target)
    columns = ["_id", "_text", "_h", "_block"]
    both = rows.select(*columns, F.lit(False).alias("_tail")).unionByName(heads.select(*columns, F.lit(True).alias("_tail")))
    signed = with_signatures(both, "_text", "_sig")
    order = Window.partitionBy("_block").orderBy("_tail", F.col("_id").desc_nulls_last(), F.col("_h").desc(), F.col("_text").desc())
    met = (signed.withColumn("_next", F.lead(F.struct("_text", "_sig")).over(order)).filter(~F.col("_tail"))
           .withColumn("n_chars", F.length("_text").cast("long")))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("_next._text"), F.lit(1), third))
    met = met.select("_id", "n_chars", edited.alias("_edited"), F.col("_sig"), F.col("_next._sig").alias("_nsig"))
    done = with_signatures(met.withColumn("edited_sha256", F.sha2("_edited", 256)), "_edited", "_esig")
    return done.select(F.col("_id").alias(id_col), "n_chars", "edited_sha256", shown(F.col("_sig")).alias("fingerprint"),
                       shown(F.col("_esig")).alias("edited_fingerprint"), likeness("_sig", "_esig").alias("near_edited"),
                       likeness("_sig", "_nsig").alias("near_next"))

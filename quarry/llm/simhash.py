"""Near-duplicates by SimHash fingerprints and deletion-variant signatures.

A 64-bit fingerprint is cut into two halves.  Of two fingerprints at most
three bits apart, one half differs by at most one bit.  So each half is
indexed as it is and with each of its bits as a wildcard: equal halves meet
under the plain key, halves one bit apart under the key without that bit,
and only there (both values of the wildcard bit must be present).  Keys are
equality-joined and the pairs' whole distance is verified.  What leaves a
task is a star for each component of the links it has seen, never all pairs.
A key with many fingerprints is split into blocks, and each pair of blocks
is a task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import in_slices, row_key, ship, shuffle_partitions, text_of, tidy, whole_row, written
from quarry.llm.components import stars

SHINGLE, MOST_BITS, SEED = 3, 3, 42
#: fingerprints of a key that one task compares; a larger key goes in blocks
BLOCK = 4096
#: groups of up to so many are compared as one array
SMALL = 32


def _fingerprinter(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest
        ones, shifts = np.uint64(0x0101010101010101), [np.uint64(b) for b in range(8)]

        def fingerprint(text: bytes) -> int:
            words = text.lower().split()
            if not words:
                return 0
            line = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts, last = (ends - sizes).tolist(), ends[shingle - 1:].tolist()
            if not last:
                starts, last = [0], [len(line)]
            counts, n = np.zeros((8, 8), np.int64), len(last)
            for k in range(0, n, 51_000):  # a block of a long text at a time
                h = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[k:k + 51_000], last[k:k + 51_000])], np.uint64)
                parts = np.arange(0, len(h), 255)
                for b, shift in enumerate(shifts):  # sums of at most 255 fit the bytes
                    counts[:, b] += np.add.reduceat((h >> shift) & ones, parts).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
            bits = np.packbits(2 * counts.reshape(-1) > n, bitorder="little")
            return int(bits.view(np.int64)[0])

        for batch in in_slices(batches):
            found = [fingerprint(t) for t in batch.column("_text").cast(pa.large_binary()).to_pylist()]
            keep = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.int64())], [*keep, "_fp"])
    return tidy(run)


def fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``rows`` (any columns and ``_text``, not null) with ``_fp`` for the text."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(_fingerprinter(shingle), f"{schema}, _fp long")


def _star_edges(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as stars: each node but the least of its component, and that one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _links(fp: np.ndarray, side: np.ndarray, sizes: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups: ``sizes`` of runs of ``fp``; ``side`` -1 for
    groups compared within, 0 and 1 for the two sides of others."""
    left, right = [], []
    ends = np.cumsum(sizes)
    starts = ends - sizes

    def check(i: np.ndarray, j: np.ndarray) -> None:
        good = (side[i] < 0) | (side[i] != side[j])
        good &= np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= most_bits
        left.append(fp[i[good]])
        right.append(fp[j[good]])

    for size in range(2, SMALL + 1):
        first = starts[sizes == size]
        if len(first):
            i, j = np.triu_indices(size, 1)
            per = max(1, 4_000_000 // len(i))
            for k in range(0, len(first), per):
                base = first[k:k + per, None]
                check((base + i).ravel(), (base + j).ravel())
    for g in np.flatnonzero(sizes > SMALL):
        members = np.arange(starts[g], ends[g])
        per = max(1, 4_000_000 // len(members))
        for k in range(0, len(members), per):
            i, j = np.meshgrid(members[k:k + per], members, indexing="ij")
            upper = i < j
            check(i[upper], j[upper])
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))


def _matcher(most_bits: int, most: int):
    """For rows (key, side, fp) sorted by key: stars (u, v) with key -1;
    the rows of keys with over ``most`` as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "_side", "u", "v"]

        def edges(key, side, fp):
            cut = np.flatnonzero(np.diff(key)) + 1
            sizes = np.diff(np.concatenate([[0], cut, [len(key)]]))
            group = np.repeat(np.arange(len(sizes)), sizes)
            # a group of one, or with one value of its wildcard bit, has no pair
            ends = np.cumsum(sizes)
            lowest, highest = (f.reduceat(side, ends - sizes) for f in (np.minimum, np.maximum))
            good = (sizes > 1) & ((lowest < 0) | (lowest != highest))
            keep = good[group]
            u, v = _links(fp[keep], side[keep], sizes[good], most_bits)
            u, v = _star_edges(u, v)
            none = np.full(len(u), -1)
            return pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.int32()), pa.array(u), pa.array(v)], names)

        def hot(key, side, fp):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(fp), pa.array(fp)], names)

        carry, carry_hot = None, None
        for batch in batches:
            got = [batch.column(c).to_numpy() for c in ("_key", "_side", "fp")]
            if not len(got[0]):
                continue
            if carry_hot is not None:  # the rest of a key that is already too large
                n = int(np.searchsorted(got[0], carry_hot, "right"))
                if n:
                    yield hot(*(x[:n] for x in got))
                    got = [x[n:] for x in got]
                if not len(got[0]):
                    continue
                carry_hot = None
            if carry is not None:
                got = [np.concatenate(x) for x in zip(carry, got)]
            first, n = np.unique(got[0], return_index=True)[1], len(got[0])
            sizes = np.diff(np.append(first, n))
            large = np.repeat(sizes > most, sizes)
            if large.any():
                yield hot(*(x[large] for x in got))
            last = np.arange(n) >= first[-1]
            carry_hot = got[0][-1] if large[-1] else None
            carry = None if large[-1] else [x[last] for x in got]
            rest = ~large & ~last
            if rest.any():
                yield edges(*(x[rest] for x in got))
        if carry is not None:
            yield edges(*carry)
    return tidy(run)


MATCHED = "_key long, _side int, u long, v long"


def links(distinct: DataFrame, most_bits: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect the fingerprints (column ``fp``, distinct) at
    most ``most_bits`` (up to 3) apart just as the links themselves do."""
    if not 0 <= most_bits <= 3:
        raise ValueError("two halves with one wildcard find at most 3 bits")
    variants = F.explode(F.expr("sequence(0, 65)"))  # half * 33 + bit, bit 32 for none
    rows = distinct.select("fp", variants.alias("_v"))
    half = F.when(F.col("_v") < 33, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.expr("shiftrightunsigned(fp, 32)"))
    bit = F.pmod(F.col("_v"), F.lit(33))
    mask = F.when(bit == 32, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, pmod(_v, 33))"))
    rows = rows.select("fp", (F.col("_v").cast("long") * F.lit(1 << 32) + half.bitwiseAND(F.bitwise_not(mask))).alias("_key"),
                       F.when(bit == 32, F.lit(-1)).when(half.bitwiseAND(mask) != 0, F.lit(1)).otherwise(F.lit(0)).alias("_side"))
    n = shuffle_partitions(distinct.sparkSession)
    sort = lambda df, *by: df.repartition(n, *by).sortWithinPartitions("_key")
    found = written(sort(rows, "_key").mapInArrow(_matcher(most_bits, block), MATCHED), "simhash-links")
    edges = found.filter("_key < 0").select("u", "v")
    large = found.filter("_key >= 0").select("_key", "_side", F.col("u").alias("fp"))
    if large.limit(1).count():
        sizes = large.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
        blocks = F.ceil(F.col("n") / F.lit(block / 2)).cast("int")
        mine = F.pmod(F.xxhash64("fp"), blocks.cast("long")).cast("int")
        # each row meets every block once: (its block, another) in order; both halves of a pair of blocks have the same key
        paired = (large.join(sizes, "_key").withColumn("_n", blocks).withColumn("_b", mine)
                  .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
                  .select(F.xxhash64("_key", F.least("_b", "_o"), F.greatest("_b", "_o")).alias("_pair"), "_side", "fp"))
        again = paired.repartition(n * 4, "_pair").withColumnRenamed("_pair", "_key").sortWithinPartitions("_key")
        more = written(again.mapInArrow(_matcher(most_bits, 1 << 40), MATCHED), "simhash-blocks")
        edges = edges.unionByName(more.select("u", "v"))
    return edges


def _classes(rows: DataFrame, most_bits: int) -> DataFrame:
    """(_fp, _root) for every fingerprint of ``rows`` with a link."""
    distinct = rows.select(F.col("_fp").alias("fp")).distinct()
    return stars(links(distinct, most_bits)).select(F.col("u").alias("_fp"), F.col("v").alias("_root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    most_bits: int = MOST_BITS) -> DataFrame:
    """(id, fingerprint, component_id), one row per row of ``docs``.

    Null and empty texts, and texts of white space, have fingerprint zero and
    link like any other.  The component's id is its smallest id that is not
    null; null only if all are.  Repeated rows keep their rows.  Other columns
    are not read.
    """
    rows = written(fingerprints(docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")), shingle), "simhash")
    per = rows.groupBy("_fp").agg(F.min("_id").alias("_least")).join(_classes(rows, most_bits), "_fp", "left")
    per = per.withColumn("_root", F.coalesce("_root", "_fp"))
    ids = per.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = per.join(ids, "_root").select("_fp", "component_id")
    return rows.join(named, "_fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                most_bits: int = MOST_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null
    after all others), of rows with that id the one with the least hash."""
    keyed = docs.select(whole_row(docs).alias("_row")).withColumn("_key", row_key())
    ident = F.col("_row").getField(id_col)
    ordered = keyed.select(F.struct(ident.isNull().alias("null_id"), ident.alias("id"), F.col("_key").alias("key")).alias("_order"),
                           F.coalesce(F.col("_row").getField(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = written(fingerprints(ordered, shingle), "simhash")
    first = rows.groupBy("_fp").agg(F.min("_order").alias("_order")).join(_classes(rows, most_bits), "_fp", "left")
    stay = first.groupBy(F.coalesce("_root", "_fp")).agg(F.min("_order").alias("_order")).select(F.col("_order").getField("key").alias("_key"))
    return keyed.join(stay, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")


ship(__name__)

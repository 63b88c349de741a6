"""Best-fit packing of tokenised documents into sequences.

Only the counts of pieces by length (at most ``capacity`` numbers, whatever
the corpus) are read by the driver.  On them it applies Martello and Toth's
dominance reduction: the longest piece left, together with the set of
pieces that provably dominates every other set with it, is fixed as a
sequence for good, as often as the counts allow.  What no dominance fixes is
packed by best fit, longest first, again on counts.  The outcome is a list
of patterns (lengths of a sequence, times used), whose size depends on the
capacity alone: each step of a length opens at most a few patterns and
splits at most one, and a pattern holds fewer than sqrt(2 * capacity)
different lengths.  Pieces are then ranked within their length by
distributed prefix sums and each looks up its place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import in_slices, ship, shuffle_partitions, text_of, tidy, written
from quarry.llm.tokens import WordEncoder

CAPACITY, END_ID = 4096, 1


# --- the plan, on counts by length ------------------------------------------

class _Lengths:
    """Multiset of lengths with the searches that the reduction needs."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.n[length] = count

    def take(self, length: int, times: int) -> None:
        self.n[length] -= times

    def longest(self, most: int, without: tuple[int, ...] = ()) -> int:
        """The longest length of at most ``most`` that is left, 0 if none."""
        if most < 1:
            return 0
        n = self.n
        if without:
            n = n.copy()
            for w in without:
                n[w] -= 1
        at = np.flatnonzero(n[1:most + 1] > 0)
        return int(at[-1]) + 1 if len(at) else 0

    def best_pair(self, room: int) -> tuple[int, int]:
        """Two lengths left with the largest sum of at most ``room``."""
        left = np.flatnonzero(self.n > 0)
        left = left[left < room]
        if not len(left):
            return 0, 0
        partner = np.searchsorted(left, np.minimum(room - left, left), "right") - 1
        same = (partner >= 0) & (left[partner] == left) & (self.n[left] < 2)
        partner = np.where(same, partner - 1, partner)
        sums = np.where(partner >= 0, left + left[np.maximum(partner, 0)], 0)
        k = int(np.argmax(sums))
        return (int(left[k]), int(left[partner[k]])) if sums[k] else (0, 0)

    def shortest_three(self) -> float:
        """The sum of the three shortest lengths left (infinite if fewer)."""
        left = np.flatnonzero(self.n > 0)[:3]
        three = np.repeat(left, np.minimum(self.n[left], 3))[:3]
        return float(three.sum()) if len(three) == 3 else float("inf")


def reduce_by_dominance(lengths: _Lengths, capacity: int) -> list[tuple[int, list[int]]]:
    """Sets fixed for good, as (times, lengths).  For the longest piece j and
    the longest partner k that fits beside it: {j} if nothing fits; {j, k} if
    k fills the room exactly, or no two pieces fit beside j, or no three do
    and k is at least as long as the best two.  Counts are taken in bulk: with
    fewer pieces left the other sets only get shorter, so the choice stays
    dominant.  A length for which none holds is left for the best fit."""
    fixed, top = [], capacity
    while j := lengths.longest(top):
        have = int(lengths.n[j])
        room = capacity - j
        lengths.take(j, 1)
        k = lengths.longest(room)
        pair = lengths.best_pair(room) if k else (0, 0)
        three = lengths.shortest_three() <= room
        lengths.take(j, -1)
        if not k:
            fixed.append((have, [j]))
            lengths.take(j, have)
        elif k == room or not pair[0] or k >= sum(pair) and not three:
            times = have // 2 if k == j else min(have, int(lengths.n[k]))
            fixed.append((times, [j, k]))
            lengths.take(j, times)
            lengths.take(k, times)
        else:
            top = j - 1
    return fixed


def best_fit(lengths: _Lengths, capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing on counts: open patterns by the room they have."""
    open_by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    closed: list[tuple[int, list[int]]] = []
    for w in np.flatnonzero(lengths.n)[::-1]:
        w, left = int(w), int(lengths.n[w])
        while left:
            room = min((r for r, found in open_by_room.items() if found and r >= w), default=0)
            if not room:
                each = min(capacity // w, left)
                times = left // each
                open_by_room[capacity - each * w].append((times, [w] * each))
                left -= times * each
                continue
            times, pattern = open_by_room[room].pop()
            used = min(times, left)
            if used < times:
                open_by_room[room].append((times - used, pattern))
            open_by_room[room - w].append((used, pattern + [w]))
            left -= used
        lengths.n[w] = 0
    for found in open_by_room.values():
        closed += found
    return closed


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) patterns that use every piece exactly once."""
    lengths = _Lengths(counts, capacity)
    fixed = reduce_by_dominance(lengths, capacity)
    return [p for p in fixed + best_fit(lengths, capacity) if p[0]]


def slots_of(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: ranks [rank, next rank) of a length
    lie ``step`` to a sequence from ``sequence`` on, at ``offset``."""
    rows, used, sequence = [], defaultdict(int), 0
    for times, pattern in patterns:
        at = 0
        for w in dict.fromkeys(pattern):
            same = pattern.count(w)
            rows.append((w, used[w], sequence, same, at))
            used[w] += same * times
            at += same * w
        sequence += times
    rows.sort()
    return {k: np.array(v, np.int64) for k, v in zip(("length", "rank", "sequence", "step", "offset"), zip(*rows) if rows else [[]] * 5)}


# --- the pieces --------------------------------------------------------------

def _cutter(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib
        encoder = WordEncoder.of_worker(path)
        end, width = np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for batch in in_slices(batches):
            rows, piece, start, length, crc = [], [], [], [], []
            texts = batch.column("_text").cast(pa.large_binary()).to_pylist()
            for r, ids in enumerate(encoder.ids_of(texts)):
                ids += end
                for k in range(0, len(ids), width):
                    part = ids[k:k + width]
                    rows.append(r)
                    piece.append(k // width)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            keep = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(rows, pa.int64())) for c in keep), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                [*keep, "piece", "start", "length", "ids_crc32"])
    return tidy(run)


def _placer(slots: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = np.int64(1) << 40
        key = slots["length"] * big + slots["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(key, length * big + rank, "right") - 1
            within = rank - slots["rank"][at]
            sequence = slots["sequence"][at] + within // slots["step"][at]
            offset = slots["offset"][at] + within % slots["step"][at] * length
            keep = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)],
                                             [*keep, "sequence_id", "offset"])
    return tidy(run)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
         capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone.  Null and repeated ids keep
    their rows; the pieces of rows with one id are told apart by their place
    only.  Other columns are not read.  No documents: no rows.
    """
    blocks = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    cut = rows.mapInArrow(_cutter(path, capacity), f"_id {id_type}, piece int, start long, length long, ids_crc32 long")
    pieces = written(cut.withColumn("_block", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(4 * blocks)).cast("int")),
                     "pieces")
    by_block = pieces.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    # at most `capacity` rows, whatever the corpus
    counts = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = slots_of(pack_counts(counts, capacity))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_block.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    order = Window.partitionBy("length", "_block").orderBy("_id", "piece", "ids_crc32", "start")
    ranked = (pieces.withColumn("_at", F.row_number().over(order)).join(offsets, ["length", "_block"])
              .select("_id", "piece", "start", "length", "ids_crc32", (F.col("_off") + F.col("_at") - 1).alias("_rank")))
    placed = ranked.mapInArrow(_placer(slots), f"_id {id_type}, piece int, start long, length long, ids_crc32 long, "
                                               "sequence_id long, offset long")
    return placed.withColumnRenamed("_id", id_col)


ship(__name__)

"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns.  Its key is the XOR of 128-bit
hashes of (depth, turn), which prefix sums over blocks of turns can make, so
that a conversation of any length is no one task's.  The key of a node's parent
follows from its own.

Subtree totals are passed from children to parents in reverse level order.
The trie is cut into shards that a task holds: a node's weight (the turns that
its members have from there on) bounds the nodes below it, so the highest
nodes of a weight up to ``SHARD`` are shard roots with whole subtrees.  Spark
sorts each shard's nodes by falling depth; a task takes one after the other,
gives a node the totals waiting for it and sends its own on through a priority
queue, whose far end spills to disk.  What the shard roots send their parents
is summed by parent, and the nodes above, which are few for each level, are
processed alike in bands of levels: first each band alone, then the roots of the
bands (as a trie of its own, with bands of bands), then each band again with
what came from below.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.rank import rank_within
from quarry.llm.common import ship, text_of, tidy, written

#: a shard's turns at most, levels of a band, and messages that a queue holds in memory
SHARD, BAND, QUEUE = 100_000, 1000, 200_000


# --- rebuilt conversations -------------------------------------------------------------

def _hash(*columns) -> Column:
    """128 bits as two longs."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(7), *columns).alias("b"))


def _xor(x: str, y: str) -> Column:
    return F.struct(F.col(f"{x}.a").bitwiseXOR(F.col(f"{y}.a")).alias("a"), F.col(f"{x}.b").bitwiseXOR(F.col(f"{y}.b")).alias("b"))


def group_start(conv: Column) -> Column:
    """The conversation that gives the first turns: c - c % 100."""
    return conv - conv % 100


def head_turns(conv: Column) -> Column:
    """How many turns it gives: crc32 of the decimal id, modulo 6."""
    return F.crc32(conv.cast("string").cast("binary")) % 6


HEAD_MOST = 5


def rebuilt(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(c, d, x, n) of every rebuilt turn (its place from 1, its hash, its code
    points), and (c, len) of every conversation."""
    turns = (conversations.filter(F.col(conv_col).isNotNull())
             .select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
             .select("c", "turn", _hash("role", "text").alias("x"), F.length("text").cast("long").alias("n")))
    placed = written(rank_within(turns, ["c"], [F.col("turn").asc_nulls_first(), "x.a", "x.b"], "pos").select("c", "pos", "x", "n"), "turns")
    each = placed.groupBy("c").agg(F.max("pos").alias("own")).withColumn("h", head_turns(F.col("c")))
    each = each.withColumn("base", group_start(F.col("c")))
    starts = each.select(F.col("c").alias("base"), F.col("own").alias("has"))
    each = written(each.join(starts, "base", "left").select(
        "c", "own", "h", "base", F.least("h", F.coalesce("has", F.lit(0))).alias("lent")), "conversations")
    # at most HEAD_MOST turns of a start meet at most 100 conversations
    lent = (each.filter("lent > 0").select("c", "base", "lent")
            .join(placed.filter(F.col("pos") <= HEAD_MOST).select(F.col("c").alias("base"), "pos", "x", "n"), "base")
            .filter("pos <= lent").select("c", F.col("pos").alias("d"), "x", "n"))
    # what the own turns move by is 0 unless the start is shorter than h
    moved = each.filter("lent < h").select("c", (F.col("lent") - F.col("h")).alias("by"))
    own = placed.filter(F.col("pos") > head_turns(F.col("c"))).join(moved, "c", "left").select(
        "c", (F.col("pos") + F.coalesce("by", F.lit(0))).alias("d"), "x", "n")
    lengths = each.select("c", (F.col("lent") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("len"))
    return lent.unionByName(own), lengths


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, d, key, parent, n): the keys of all prefixes, by blocks of 4096 turns."""
    t = turns.select("c", "d", "n", _hash("d", "x").alias("t")).withColumn("block", F.shiftright("d", 12))

    def running(column: str, window) -> Column:
        return F.struct(*[F.coalesce(F.bit_xor(f"{column}.{k}").over(window), F.lit(0)).cast("long").alias(k) for k in ("a", "b")])

    inside = t.withColumn("k", running("t", Window.partitionBy("c", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)))
    whole = t.groupBy("c", "block").agg(F.struct(F.bit_xor("t.a").alias("a"), F.bit_xor("t.b").alias("b")).alias("t"))
    carry = whole.withColumn("carry", running("t", Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    out = inside.join(carry.filter("block > 0").select("c", "block", "carry"), ["c", "block"], "left")
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    out = out.withColumn("carry", F.coalesce("carry", zero)).withColumn("key", _xor("k", "carry"))
    return out.select("c", "d", "key", _xor("key", "t").alias("parent"), "n")


# --- time-forward processing -----------------------------------------------------------

class SpillingQueue:
    """Messages (order, values) by order, those of one order added up.  Beyond
    ``most`` in memory the later half goes to disk as a sorted run, in the
    folder that Spark gives its workers for spilling."""

    def __init__(self, most: int = QUEUE):
        self.most, self.near, self.values, self.runs = most, [], {}, []

    def push(self, order: tuple, values: tuple) -> None:
        have = self.values.get(order)
        if have is None:
            heapq.heappush(self.near, order)
            self.values[order] = values
            if len(self.near) > self.most:
                self._spill()
        else:
            self.values[order] = tuple(a + b for a, b in zip(have, values))

    def _spill(self) -> None:
        import os
        import pickle
        import tempfile
        self.near.sort()  # a sorted list is a heap
        far = self.near[len(self.near) // 2:]
        del self.near[len(self.near) // 2:]
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        run = tempfile.TemporaryFile(dir=folder)  # has no name and goes with the task
        for order in far:
            pickle.dump((order, self.values.pop(order)), run)
        run.seek(0)
        self.runs.append([pickle.load(run), run])

    def pop(self, order: tuple) -> tuple | None:
        """The sum of the messages to ``order``; none that is earlier is left."""
        import pickle
        out = None
        if self.near and self.near[0] == order:
            heapq.heappop(self.near)
            out = self.values.pop(order)
        for run in self.runs:
            if run[0] and run[0][0] == order:
                out = run[0][1] if out is None else tuple(a + b for a, b in zip(out, run[0][1]))
                try:
                    run[0] = pickle.load(run[1])
                except EOFError:
                    run[0] = None
                    run[1].close()
        self.runs = [run for run in self.runs if run[0]]
        return out


TOTALS = "key struct<a:bigint,b:bigint>, parent struct<a:bigint,b:bigint>, d long, leaves long, saved long, top boolean"


def _forward(most: int):
    """Nodes (shard, d, key, parent, leaves, saved), by shard, falling depth and
    key, with the totals of their subtrees inside the shard.  ``top``: the
    parent is in another shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, None
        for batch in batches:
            where = batch.column("shard").to_pylist()
            depth, floor = batch.column("d").to_pylist(), batch.column("floor").to_pylist()
            own = list(zip(batch.column("leaves").to_pylist(), batch.column("saved").to_pylist()))
            keys, parents = ([x and (x["a"], x["b"]) for x in batch.column(k).to_pylist()] for k in ("key", "parent"))
            totals, top = [], []
            for s, d, low, values, key, parent in zip(where, depth, floor, own, keys, parents):
                if s != shard:
                    shard, queue = s, SpillingQueue(most)
                below = queue.pop((-d, *key))
                if below:
                    values = tuple(a + b for a, b in zip(values, below))
                totals.append(values)
                top.append(d <= low)
                if d > low:
                    queue.push((1 - d, *parent), values)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("parent"), batch.column("d"), *(
                pa.array([t[k] for t in totals], pa.int64()) for k in range(2)), pa.array(top, pa.bool_())], ["key", "parent", "d", "leaves", "saved", "top"])
    return tidy(run)


def _in_shards(nodes: DataFrame, queue: int) -> DataFrame:
    """Subtree totals inside shards, of nodes (shard, floor, d, key, parent, leaves,
    saved); ``floor`` is the depth of the shard's roots."""
    dealt = nodes.select("shard", "floor", "d", "key", "parent", "leaves", "saved").repartition("shard").sortWithinPartitions(
        "shard", F.col("d").desc(), "key.a", "key.b")
    return dealt.mapInArrow(_forward(queue), TOTALS)


def _received(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes with the messages (parent, leaves, saved) to them added."""
    sums = messages.groupBy(F.col("parent").alias("key")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
    more = nodes.join(sums, "key", "left")
    return more.withColumns({k: F.col(k) + F.coalesce(s, F.lit(0)) for k, s in (("leaves", "_l"), ("saved", "_s"))}).drop("_l", "_s")


def _by_bands(nodes: DataFrame, ancestor, band: int, queue: int, level: int = 1) -> DataFrame:
    """Subtree totals (key, leaves, saved) of a whole trie (d, key, parent, leaves,
    saved) by bands of levels.  ``ancestor`` gives, for nodes at the top of a band,
    the key of the node a band higher."""
    floor = F.floor(F.col("d") / band) * band
    nodes = nodes.withColumn("floor", floor.cast("long")).withColumn("shard", F.struct(F.col("floor").alias("a"), F.lit(0).cast("long").alias("b")))
    alone = written(_in_shards(nodes, queue), f"band-totals-{level}")
    tops = alone.filter("top and d > 0")
    if tops.limit(1).count():
        # the tops of the bands are a trie, too, one level of which is a band
        roots = alone.filter("top").join(ancestor(band).withColumnRenamed("up", "_up"), "key", "left").select(
            (F.col("d") / band).cast("long").alias("d"), "key", F.coalesce("_up", "parent").alias("parent"), "leaves", "saved")

        def higher(more: int) -> DataFrame:
            return ancestor(band * more)

        whole = _by_bands(written(roots, f"band-roots-{level}"), higher, band, queue, level + 1)
        sent = tops.select("key", "parent").join(whole, "key").select("parent", "leaves", "saved")
        alone = _in_shards(_received(nodes, sent), queue)
    return alone.select("key", "leaves", "saved")


def subtree_totals(nodes: DataFrame, rows: DataFrame, shard: int = SHARD, band: int = BAND, queue: int = QUEUE) -> DataFrame:
    """(key, leaves, saved) summed over the subtrees of nodes (key, parent, d,
    weight, above, leaves, saved), ``above`` being the parent's weight.
    ``rows`` (c, d, key) has every member of every node."""
    small = F.col("weight") <= shard
    roots = nodes.filter(small & (F.coalesce("above", F.lit(shard + 1)) > shard))
    # each conversation meets one shard root at most
    of = rows.join(roots.select("key"), "key").select("c", F.col("key").alias("shard"), F.col("d").alias("floor"))
    low = nodes.filter(small).join(of, "c")
    inside = written(_in_shards(low, queue), "shard-totals")
    high = written(_received(nodes.filter(~small).select("d", "c", "key", "parent", "leaves", "saved"), inside.filter("top and parent is not null")), "upper-nodes")

    def ancestor(levels: int) -> DataFrame:
        """(key, up) for upper nodes at depths that ``levels`` divides: the member's own prefix so much shorter."""
        at = rows.filter((F.col("d") % levels == 0))
        return (high.filter((F.col("d") % levels == 0) & (F.col("d") > 0)).select("key", "c", (F.col("d") - levels).alias("d"))
                .join(at.select("c", "d", F.col("key").alias("up")), ["c", "d"]).select("key", "up"))

    return inside.select("key", "leaves", "saved").unionByName(_by_bands(high.drop("c"), ancestor, band, queue))


# --- the digest of ends ------------------------------------------------------------------

def _digests():
    """SHA-256 of each key's lists, joined in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        key, digest = None, None
        for batch in batches:
            keys, out = [], []
            for a, b, ids in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ids")):
                if (a, b) != key:
                    if digest:
                        keys.append(key)
                        out.append(digest.hexdigest())
                    key, digest = (a, b), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in keys], pa.int64()) for j in range(2)] + [pa.array(out, pa.string())], ["a", "b", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()) for k in key] + [pa.array([digest.hexdigest()], pa.string())], ["a", "b", "ends_sha256"])
    return tidy(run)


def ends(last: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, c): ids are listed by blocks of 4096 values
    first, so a node where very many conversations end reads a row a block."""
    blocks = last.groupBy(F.col("key.a").alias("a"), F.col("key.b").alias("b"), F.shiftright("c", 12).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))
    done = blocks.repartition("a", "b").sortWithinPartitions("a", "b", "block").select("a", "b", "ids").mapInArrow(_digests(), "a long, b long, ends_sha256 string")
    return done.select(F.struct("a", "b").alias("key"), "ends_sha256")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                shard: int = SHARD, band: int = BAND, queue: int = QUEUE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), one row per node of the rebuilt conversations' trie.

    Turns are in the order of ``turn``, null first; turns of one number in the
    order of a hash of role and text.  A null role or text is empty; rows
    without a conversation id belong to none and are left out.  Repeated rows
    are turns of their own.  An empty table has no conversation and so no node,
    not even the root.  Other columns are not read.
    """
    turns, lengths = rebuilt(conversations, conv_col, turn_col, role_col, text_col)
    lengths = written(lengths, "lengths")
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    root = lengths.select("c", F.lit(0).cast("long").alias("d"), zero.alias("key"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), F.lit(0).cast("long").alias("n"))
    rows = written(prefixes(turns).select("c", F.col("d").cast("long").alias("d"), "key", "parent", "n").unionByName(root).join(lengths, "c"), "prefixes")
    nodes = rows.groupBy("key").agg(
        F.min("c").alias("c"), F.max("d").alias("d"), F.max("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("n"),
        F.sum(F.col("len") - F.col("d") + 1).alias("weight"))
    nodes = written(nodes, "nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("key").alias("parent"), F.col("c").alias("parent_conv_id"), F.col("weight").alias("above"))
    nodes = nodes.join(children, "key", "left").join(above, "parent", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)).cast("long"),
        "leaves": F.col("n_children").isNull().cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n")})
    nodes = written(nodes, "linked-nodes")
    totals = subtree_totals(nodes, rows.select("c", "d", "key"), shard, band, queue)
    digests = ends(rows.filter("d = len").select("key", "c"))
    out = nodes.drop("leaves", "saved").join(totals, "key").join(digests, "key", "left")
    return out.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


ship(__name__)

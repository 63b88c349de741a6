"""Phrase collocations by stripes.

A stripe is a prefix of words with a counter of the words that come next; the
empty prefix has all words, and one more entry counts the places where no
word that could make a frequent phrase comes next.  So the sum of a stripe is
its prefix's total, its entries are the prefix's extensions, and the largest
of them tells whether the prefix is subsumed.

Texts are read once for each length.  A task makes the stripes of some MB of
text at once; stripes of a prefix meet in one shuffle and are added
elementwise.  A phrase can only be frequent if the one without its last and
the one without its first word are, so a Bloom filter of the frequent phrases
of one length (of at most ``FILTER_BITS``, whatever the corpus; where it is
too full it holds back less and nothing is lost) decides which places are
counted at the next.  Stripes travel in buckets dealt by the prefix; prefixes that
are frequent enough to make large stripes (at most ``HOT`` a length) are dealt
by their next word too, as the empty prefix always is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import ship, shuffle_partitions, text_of, tidy, written

LONGEST, LEAST, FIRST = 5, 100, 2000
#: bytes of text counted at once, and for each bucket; hot prefixes of a length at most, and the least count of one
SLICE, BUCKET, HOT, HOT_LEAST = 16 << 20, 16 << 20, 1 << 16, 1 << 20
#: bits of the filter at most (16 MB), bits for each phrase below that, and bits set by a phrase
FILTER_BITS, BITS_EACH, PROBES = 1 << 27, 16, 4

# bytes that no UTF-8 text holds: a break between pieces, and the start of words that only follow others
BREAK, AHEAD = b"\xff", b"\xfe"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10)
_CUT = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")

STRIPES = "bucket long, lang string, blob binary"
MERGED = "lang string, prefix string, bucket long, total long, stripe array<struct<next:string,c:bigint>>"


def _parts(text: bytes, most: int, longest: int) -> Iterator[bytes]:
    """The text folded, one of more than ``most`` bytes in parts that end
    between words, each with the words ahead that phrases begun in it need."""
    ahead = re.compile(rb"(?:[\x20\x09]+[^\x20\x09.,;:!?\x0a-\x0d]+){0,%d}" % (longest - 1))
    at = 0
    while len(text) - at > most and (cut := _CUT.search(text, at + most)):
        more = ahead.match(text, cut.start())[0]
        yield text[at:cut.start()].translate(_FOLD) + (b" " + AHEAD + more.translate(_FOLD) if more else b"")
        at = cut.start()
    yield text[at:].translate(_FOLD)


class _Words:
    """The words of texts: ``ids`` into ``names``, ``room`` (words from a place
    to the end of its piece) and ``own`` (places where phrases begin)."""

    def __init__(self, texts: list[bytes]):
        data = BREAK.join(texts).replace(BREAK, b" " + BREAK + b" ")
        whole = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data))
        coded = pc.ascii_split_whitespace(whole).flatten().dictionary_encode()
        ids = coded.indices.to_numpy()
        names = coded.dictionary.cast(pa.large_binary()).to_pylist()
        number = {special: names.index(special) for special in (BREAK, AHEAD, b"") if special in names}
        end, later = ids == number.get(BREAK, -1), ids == number.get(AHEAD, -1)
        own = np.ones(len(ids), bool)
        if AHEAD in number:
            last = np.maximum.accumulate(np.where(end | later, np.arange(len(ids)), -1))
            own = (last < 0) | ~later[last]
        stay = ~later & (ids != number.get(b"", -1))
        self.ids, end, own = ids[stay], end[stay], own[stay]
        places = np.arange(len(self.ids))
        stop = np.minimum.accumulate(np.where(end, places, len(places))[::-1])[::-1]
        self.room = stop - places
        self.own = own & ~end
        self.bytes = names

    def hashes(self) -> np.ndarray:
        from xxhash import xxh64_intdigest
        return np.fromiter(map(xxh64_intdigest, self.bytes), np.uint64, len(self.bytes))


def _chained(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one word more."""
    h = (h * np.uint64(0x9E3779B97F4A7C15) + word) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _seed(lang: str) -> np.uint64:
    from xxhash import xxh64_intdigest
    return np.uint64(xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 11))


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which phrases the filter may hold."""
    size, out = np.uint64(len(bits) * 8 - 1), np.ones(len(h), bool)
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        at = (low + np.uint64(k) * step) & size
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


class _Stripes:
    """Some stripes of one language: ``prefix`` (bytes) and ``size`` (entries) of
    each, and of all entries ``next`` (bytes, one after the other) and ``c``."""

    REST = b"\n"  # stands for whatever makes no phrase; no word holds it

    @staticmethod
    def pack(prefix: list[bytes], size: np.ndarray, following: list[bytes], c: np.ndarray, codec) -> bytes:
        words, names = b" ".join(following), b"\n".join(prefix)
        head = np.array([len(size), len(c), len(names)], np.int64)
        return codec.compress(b"".join([head.tobytes(), size.astype(np.uint32).tobytes(), c.astype(np.uint32).tobytes(), names, words]))

    @staticmethod
    def unpack(blob: bytes, codec) -> tuple[list[bytes], np.ndarray, list[bytes], np.ndarray]:
        data = codec.decompress(blob)
        n, m, names = np.frombuffer(data, np.int64, 3).tolist()
        at = 24 + 4 * (n + m)
        return (data[at:at + names].split(b"\n"), np.frombuffer(data, np.uint32, n, 24).astype(np.int64), data[at + names:].split(b" "),
                np.frombuffer(data, np.uint32, m, 24 + 4 * n).astype(np.int64))


def _slice_stripes(lang: str, texts: list[bytes], length: int, bits, hot, buckets: int, codec) -> pa.RecordBatch:
    """The stripes of prefixes of ``length`` - 1 words in some texts, by buckets."""
    words = _Words(texts)
    h, ids, before = words.hashes(), words.ids, length - 1
    if not before:
        count = np.bincount(ids[words.own], minlength=len(h))
        following = np.flatnonzero(count)
        count, prefix, first = count[following], np.zeros(len(following), np.int64), np.zeros(1, np.int64)
        bucket = h[following] % np.uint64(buckets)
    else:
        at = np.flatnonzero(words.room >= before)
        key = np.full(len(at), _seed(lang))
        for j in range(before):
            key = _chained(key, h[ids[at + j]])
        known = np.zeros(len(ids) + 1, bool)
        known[at] = ok = _passes(bits, key)
        ok &= words.own[at]
        at, key = at[ok], key[ok]
        follows = (words.room[at] >= length) & known[at + 1]
        following = np.where(follows, ids[np.minimum(at + before, len(ids) - 1)].astype(np.int64), len(h))
        if before == 1:
            prefix = ids[at].astype(np.int64)
            _, first = np.unique(prefix, return_index=True)
            place = np.zeros(len(h), np.int64)
            place[prefix[first]] = np.arange(len(first))
            prefix = place[prefix]
        else:
            _, first, prefix = np.unique(key, return_index=True, return_inverse=True)
            if any((ids[at + j] != ids[at[first[prefix]] + j]).any() for j in range(before)):  # two phrases of one hash
                _, first, prefix = np.unique(np.stack([ids[at + j] for j in range(before)], 1), axis=0, return_index=True, return_inverse=True)
        pairs, count = np.unique(prefix.astype(np.int64) * (len(h) + 1) + following, return_counts=True)
        prefix, following = np.divmod(pairs, len(h) + 1)
        spread = np.where(np.isin(key[first], hot)[prefix] & (following < len(h)), np.append(h, np.uint64(0))[following], np.uint64(0))
        bucket = _chained(key[first][prefix], spread) % np.uint64(buckets)
        first = at[first]
    by = np.lexsort((prefix, bucket))
    prefix, bucket, following, count = prefix[by], bucket[by].astype(np.int64), following[by], count[by]
    new = np.ones(len(by), bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (bucket[1:] != bucket[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(by)))
    names = [b" ".join([words.bytes[i] for i in ids[p:p + before]]) for p in first[prefix[begin]].tolist()]
    nexts = [*words.bytes, _Stripes.REST]
    each, of = np.unique(bucket, return_index=True)
    blobs = []
    for a, b in zip(of.tolist(), [*of[1:].tolist(), len(by)]):
        i, j = np.searchsorted(begin, [a, b])
        blobs.append(_Stripes.pack(names[i:j], size[i:j], [nexts[k] for k in following[a:b].tolist()], count[a:b], codec))
    return pa.RecordBatch.from_arrays([pa.array(each, pa.int64()), pa.array([lang] * len(each), pa.string()), pa.array(blobs, pa.binary())], ["bucket", "lang", "blob"])


def _striper(length: int, longest: int, bits, hot, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        codec = zstandard.ZstdCompressor(level=1)
        held: dict[str, list[bytes]] = {}
        size = 0

        def done():
            for lang, texts in held.items():
                yield _slice_stripes(lang, texts, length, bits and bits.value, hot, buckets, codec)

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("_text").cast(pa.large_binary())):
                for part in _parts(text.as_py(), most, longest):
                    held.setdefault(lang.as_py(), []).append(part)
                    size += len(part) + 100
                    if size >= most:
                        yield from done()
                        held.clear()
                        size = 0
        yield from done()
    return tidy(run)


class _Merge:
    """Stripes added elementwise."""

    MOST = 4_000_000  # entries held before equal ones are added up

    def __init__(self):
        self.prefixes: dict[bytes, int] = {}
        self.words: dict[bytes, int] = {_Stripes.REST: 0}
        self.keys, self.counts, self.held = [], [], 0

    def add(self, prefix: list[bytes], size: np.ndarray, following: list[bytes], c: np.ndarray) -> None:
        rows = np.array([self.prefixes.setdefault(p, len(self.prefixes)) for p in prefix], np.int64)
        words = np.array([self.words.setdefault(w, len(self.words)) for w in following], np.int64)
        self.keys.append(np.repeat(rows, size) << 32 | words)
        self.counts.append(c)
        self.held += len(c)
        if self.held > self.MOST:
            self.keys, self.counts = [[x] for x in self.sums()]
            self.held = len(self.counts[0])
            self.MOST = max(self.MOST, 2 * self.held)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[begin], np.add.reduceat(counts, begin)

    def result(self, lang: str, bucket: int, least: int) -> pa.RecordBatch:
        keys, c = self.sums()
        row, word = keys >> 32, keys & 0xFFFFFFFF
        first = np.searchsorted(row, np.arange(len(self.prefixes)))
        total = np.add.reduceat(c, first)
        keep = np.flatnonzero((c >= least) & (word > 0))
        offsets = np.append(np.searchsorted(row[keep], np.arange(len(self.prefixes))), len(keep))
        names = list(self.words)
        stripe = pa.StructArray.from_arrays([pa.array([names[k].decode("utf-8", "replace") for k in word[keep].tolist()], pa.string()), pa.array(c[keep], pa.int64())], ["next", "c"])
        n = len(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * n, pa.string()), pa.array([p.decode("utf-8", "replace") for p in self.prefixes], pa.string()), pa.array([bucket] * n, pa.int64()),
             pa.array(total, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), stripe)], ["lang", "prefix", "bucket", "total", "stripe"])


def _merger(least: int):
    """Rows (bucket, lang, blob), sorted by both, as merged stripes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        codec = zstandard.ZstdDecompressor()
        group, merge = None, None
        for batch in batches:
            for bucket, lang, blob in zip(*(batch.column(k) for k in ("bucket", "lang", "blob"))):
                here = bucket.as_py(), lang.as_py()
                if here != group:
                    if merge:
                        yield merge.result(group[1], group[0], least)
                    group, merge = here, _Merge()
                merge.add(*_Stripes.unpack(blob.as_py(), codec))
        if merge:
            yield merge.result(group[1], group[0], least)
    return tidy(run)


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, bucket, total, stripe): stripes (bucket, lang, blob) added
    elementwise, with the entries of at least ``least``; one shuffle.  A hot
    prefix has a row in each bucket that holds some of its words."""
    dealt = stripes.repartition(shuffle_partitions(stripes.sparkSession), "bucket").sortWithinPartitions("bucket", "lang")
    return dealt.mapInArrow(_merger(least), MERGED)


def _keys():
    """The hashes of phrases, as the tasks that count compute them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest
        for batch in batches:
            out = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                h = np.full(1, _seed(lang))
                for word in phrase.split(" "):
                    h = _chained(h, np.full(1, xxh64_intdigest(word.encode("utf-8", "surrogatepass")), np.uint64))
                out.append(h[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(out, np.uint64).view(np.int64)), batch.column("a")], ["h", "a"])
    return tidy(run)


def _filter_of(phrases: DataFrame, hot_least: int, most_bits: int):
    """The filter over (lang, phrase, a) as a broadcast, and the hashes of the
    hot ones.  Its bits are set by an aggregate over pages of 4 KB."""
    spark = phrases.sparkSession
    keys = written(phrases.mapInArrow(_keys(), "h long, a long"), "phrase-keys")
    size = min(most_bits, 1 << max(15, (keys.count() * BITS_EACH - 1).bit_length()))
    low, step = F.col("h").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("h", 32).bitwiseOR(1)
    at = F.explode(F.array(*[(low + step * k).bitwiseAND(size - 1) + 1 for k in range(PROBES)]))
    pages = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in pages.toLocalIterator():  # at most size / 32768 pages
        bits[(r["page"] - 1) * 4096:r["page"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    hot = [r["h"] for r in keys.filter(F.col("a") >= hot_least).select("h").collect()]  # at most HOT, see mine()
    return spark.sparkContext.broadcast(bits), np.array(hot, np.int64).view(np.uint64)


def _rest() -> Column:
    return F.expr("substring(phrase, instr(phrase, ' ') + 1)")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, first: int = FIRST,
         absorb: int = 100, slice_bytes: int = SLICE, filter_bits: int = FILTER_BITS, hot_least: int = HOT_LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases
    of 2 to ``longest`` words that occur ``least`` times or more.

    ``a`` is a phrase's count, ``n`` the language's words, and ``score`` the least over
    the phrase's cuts of floor(1000 a n / (l r)), ``l`` and ``r`` being the counts of
    the parts (ties: the earliest cut).  A phrase goes if one with a word more
    on a side has ``absorb`` percent of its count; counts only fall as phrases
    grow, so no longer ones need be asked.  Ranks follow score, count and the
    phrase's bytes.

    A null language is ``und``, a null text is empty; texts without a frequent
    phrase, and empty tables, give no rows.  Repeated rows count each time;
    other columns are not read.  All counts are exact.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("_text"))

    size = rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    buckets = max(64, size // BUCKET)

    def counted(length: int, bits, hot) -> DataFrame:
        return written(merged(rows.mapInArrow(_striper(length, longest, bits, hot, buckets, slice_bytes), STRIPES), least), f"stripes-{length}")

    stripes = counted(1, None, np.zeros(0, np.uint64))
    totals = written(stripes.groupBy("lang").agg(F.sum("total").alias("n")), "phrase-totals")
    words = totals.agg(F.sum("n")).first()[0] or 0
    hot_least = max(hot_least, words // HOT + 1)  # counts of one length add up to the words at most, so at most HOT reach this
    none = F.array().cast("array<long>")
    phrases = [written(stripes.select("lang", F.explode("stripe").alias("x")).select(
        "lang", F.col("x.next").alias("phrase"), F.col("x.c").alias("a"), none.alias("heads"), none.alias("tails")), "phrases-1")]
    longer = []  # (lang, phrase, most): the largest extension to the right and to the left
    for length in range(2, longest + 1):
        shorter = phrases[-1]
        bits, hot = _filter_of(shorter.select("lang", "phrase", "a"), hot_least, filter_bits)
        stripes = counted(length, bits, hot)
        bits.destroy()
        # a stripe meets its prefix as one row, before its entries are phrases
        total = stripes.groupBy("lang", "prefix").agg(F.sum("total").alias("total"), F.max(F.array_max("stripe.c")).alias("most"))
        top = total.join(shorter.select("lang", F.col("phrase").alias("prefix"), "heads"), ["lang", "prefix"]).select(
            "lang", "prefix", F.concat("heads", F.array("total")).alias("heads"))
        found = stripes.join(top, ["lang", "prefix"]).select("lang", "prefix", "heads", F.explode("stripe").alias("x")).select(
            "lang", F.concat_ws(" ", "prefix", "x.next").alias("phrase"), F.col("x.c").alias("a"), "heads").withColumn("rest", _rest())
        found = found.join(shorter.select("lang", F.col("phrase").alias("rest"), F.concat(F.array("a"), "tails").alias("tails")), ["lang", "rest"])
        phrases.append(written(found.select("lang", "phrase", "a", "heads", "tails"), f"phrases-{length}"))
        if length > 2:
            longer += [total.filter("most is not null").select("lang", F.col("prefix").alias("phrase"), "most"),
                       phrases[-1].groupBy("lang", _rest().alias("phrase")).agg(F.max("a").alias("most"))]
    found = phrases[1]
    for more in phrases[2:]:
        found = found.unionByName(more)
    if longer:
        best = longer[0]
        for more in longer[1:]:
            best = best.unionByName(more)
        found = found.join(best.groupBy("lang", "phrase").agg(F.max("most").alias("most")), ["lang", "phrase"], "left")
        found = found.filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * absorb))

    def wide(column) -> Column:
        return column.cast("decimal(19,0)")

    # 128-bit arithmetic: 1000 a n and l r stay under 38 digits
    cut = F.arrays_zip(F.col("heads").alias("l"), F.col("tails").alias("r"))
    scored = found.join(totals, "lang").withColumn("cut", F.transform(cut, lambda x, k: F.struct(
        F.call_function("div", wide(F.col("a") * 1000) * wide(F.col("n")), wide(x["l"]) * wide(x["r"])).alias("score"), k.alias("k"), x["l"].alias("l"), x["r"].alias("r"))))
    scored = scored.withColumn("cut", F.array_min("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each of 64 shares of a language, then the first of those: bounded rows in a task
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    near = scored.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= first).drop("rank")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM documents),
grams AS (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces) p, (SELECT unnest(range(1, 6)) AS m) s
    WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY ALL),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND a >= 100),
cuts AS (
    SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
    JOIN totals t ON t.lang = c.lang
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT DISTINCT s.lang, s.phrase
    FROM (SELECT lang, a AS longer, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT *, unnest(range(1, m)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM candidates))
          WHERE i + k - 1 <= m
          UNION ALL
          SELECT lang, a, array_to_string(w[m - k + 1:], ' ') FROM (SELECT *, unnest(range(2, m)) AS k FROM candidates)) s
    JOIN candidates c ON c.lang = s.lang AND c.phrase = s.phrase AND 100 * s.longer >= 100 * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM lowest ANTI JOIN inside USING (lang, phrase)
QUALIFY rank <= 2000
"""

ship(__name__)

"""Removal of repeated byte strings by blockwise suffix sorting.

Only suffixes' first ``length`` (100) bytes matter here.  The suffix space is
cut into buckets by content: the bucket of a suffix is given by the least
k-mer hash among its first ``length`` bytes, so equal strings share it, and
neighbouring suffixes mostly do.  Runs of neighbours (stretches) travel as one
piece of text.  A task holds one dealt bucket at a time and cuts it again by hash
into buckets of about ``SORT`` bytes, which are sorted one by one (in up to 100
bytes of memory for each byte, of which there are ``SORT_MOST`` at most):

* a difference cover of the places modulo 31 is sampled, and the sample's
  strings of 100 - 31 + 1 = 70 bytes are ranked;
* suffixes are sorted by their first 32 bytes;
* long ties are resolved by the sample: any two places have an offset under
  31 at which both are sampled, so the ranks there decide, and only then the
  last 32 bytes.

Equal neighbours in the sorted order are repeats; all but the earliest are
removed.  A bucket that outgrows its bound is split by the hash of the whole
string, and its parts are done in another pass, and again until every part
keeps to the bound.  Of equal strings that meet on the way only the earliest
goes on, so a string repeated without end is no part that cannot be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ship, shuffle_partitions, small_batches, text_of, tidy, written

LENGTH, KMER = 100, 20
#: fixed values: a difference cover, every difference modulo 31 occurs in it
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
SAMPLE_LENGTH = LENGTH - PERIOD + 1
#: bytes of text that the mapper cuts at once; of a dealt bucket on average, and as held at most
PIECE, BUCKET, BUCKET_MOST = 2 << 20, 12 << 20, 48 << 20
#: bytes of text that are sorted at once on average, and at most
SORT, SORT_MOST = 2 << 20, 4 << 20
#: parts of a bucket that is too large, each time
PARTS = 64

#: columns of a stretch: least hash, document (id, whether null, hash of its text), start, number of suffixes
FIELDS = (("h", np.uint64), ("id", np.int64), ("none", np.uint8), ("th", np.int32), ("start", np.int64), ("run", np.uint8))
#: columns of an interval to remove
SPANS = (("id", np.int64), ("none", np.uint8), ("th", np.int32), ("start", np.int64), ("end", np.int64))
SPAN_SCHEMA = "id long, none boolean, th int, start long, end long"
ROWS = "bucket long, blob binary"


def _offsets() -> np.ndarray:
    """For each two residues the least offset at which both are sampled."""
    sampled = np.zeros(PERIOD, bool)
    sampled[list(COVER)] = True
    both = np.array([[[sampled[(a + d) % PERIOD] and sampled[(b + d) % PERIOD] for d in range(PERIOD)] for b in range(PERIOD)] for a in range(PERIOD)])
    assert both.any(2).all(), "not a difference cover"
    return both.argmax(2)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Blob:
    """Stretches, their texts, and intervals that are known to go."""

    def __init__(self, stretches: dict, text: np.ndarray, spans: dict):
        self.stretches, self.text, self.spans = stretches, text, spans

    def pack(self, codec) -> bytes:
        n, m = len(self.stretches["h"]), len(self.spans["id"])
        parts = [np.array([n, m], np.int64).tobytes(), *(self.stretches[k].astype(t).tobytes() for k, t in FIELDS),
                 *(self.spans[k].astype(t).tobytes() for k, t in SPANS), self.text.tobytes()]
        return codec.compress(b"".join(parts))

    @classmethod
    def unpack(cls, blob: bytes, codec) -> _Blob:
        data = codec.decompress(blob)
        n, m = np.frombuffer(data, np.int64, 2)
        at, out = 16, []
        for fields, count in ((FIELDS, n), (SPANS, m)):
            columns = {}
            for k, t in fields:
                columns[k] = np.frombuffer(data, t, count, at)
                at += count * np.dtype(t).itemsize
            out.append(columns)
        return cls(out[0], np.frombuffer(data, np.uint8, offset=at), out[1])

    @classmethod
    def joined(cls, blobs: list[_Blob]) -> _Blob:
        put = lambda name, fields: {k: np.concatenate([getattr(b, name)[k] for b in blobs]) for k, _ in fields}
        return cls(put("stretches", FIELDS), np.concatenate([b.text for b in blobs]), put("spans", SPANS))

    def taken(self, which: np.ndarray) -> _Blob:
        sizes = self.stretches["run"].astype(np.int64) + LENGTH - 1
        begins = np.cumsum(sizes) - sizes
        return _Blob({k: v[which] for k, v in self.stretches.items()}, self.text[_ranges(begins[which], sizes[which])], self.spans)


def _no_spans() -> dict:
    return {k: np.zeros(0, t) for k, t in SPANS}


class _Hasher:
    """Hashes of all strings of a length, and of any string, by prefix sums."""

    def __init__(self):
        rng = np.random.default_rng(100)
        self.of_byte = rng.integers(0, 1 << 64, 256, np.uint64)
        self.base = int(rng.integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1
        self.powers = self.inverses = np.ones(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        while len(self.powers) <= len(data):
            m = len(self.powers)
            self.powers, self.inverses = (np.concatenate([x, x * np.uint64(pow(b, m, 1 << 64))])
                                          for x, b in ((self.powers, self.base), (self.inverses, pow(self.base, -1, 1 << 64))))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.powers[:len(data)], out=self.sums[1:])

    def strings(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverses[start])

    def all_of(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return _mixed((self.sums[length:length + n] - self.sums[:n]) * self.inverses[:n])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _first_of_equals(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each element the one of its key that is first by ``order``."""
    by = np.lexsort((order, key))
    new = np.ones(len(key), bool)
    new[1:] = key[by][1:] != key[by][:-1]
    first = by[new]
    out = np.empty(len(key), np.int64)
    out[by] = first[np.cumsum(new) - 1]
    return out


# --- cutting texts into stretches ---------------------------------------------

def _cut(hasher: _Hasher, data: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: dict) -> _Blob:
    """Stretches of the documents (or parts) at ``begin`` in ``data``; ``ids``
    has the id, none, th and first place of each."""
    hasher.load(data)
    # least hash of the KMER-strings in each LENGTH-string, leftmost place among equals
    h = hasher.all_of(KMER) >> np.uint64(24) << np.uint64(24) | np.arange(max(0, len(data) - KMER + 1), dtype=np.uint64)
    width, have = LENGTH - KMER + 1, 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    count = np.maximum(0, size - LENGTH + 1)
    doc = np.repeat(np.arange(len(size)), count)
    at = _ranges(begin, count)
    least = h[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(at)))
    d, place = doc[first], at[first]
    stretches = {"h": least[first] >> np.uint64(24), "id": ids["id"][d], "none": ids["none"][d], "th": ids["th"][d],
                 "start": ids["start"][d] + place - begin[d], "run": run}
    again = _repeated_whole(hasher, data, stretches, place)
    spans = _whole_spans(stretches, again)
    spans["h"] = stretches["h"][again]
    stay = np.ones(len(first), bool)
    stay[again] = False
    stretches = {k: v[stay] for k, v in stretches.items()}
    return _Blob(stretches, data[_ranges(place[stay], stretches["run"] + LENGTH - 1)], spans)


def _repeated_whole(hasher: _Hasher, data: np.ndarray, stretches: dict, place: np.ndarray) -> np.ndarray:
    """Which stretches, at ``place`` in ``data``, an earlier one equals byte by
    byte.  All their suffixes are repeats; only the earliest is sorted."""
    size = stretches["run"].astype(np.int64) + LENGTH - 1
    order = _order(stretches)
    leader = _first_of_equals(hasher.strings(place, place + size), order)
    again = np.flatnonzero(order[leader] < order)
    raw, first = memoryview(data), leader[again]
    same = [n == m and raw[i:i + n] == raw[j:j + n] for i, n, j, m in zip(place[again].tolist(), size[again].tolist(), place[first].tolist(), size[first].tolist())]
    return again[np.array(same, bool)]


def _order(columns: dict) -> np.ndarray:
    """Numbers in the order of (id, null last; start), equal for equal ones."""
    by = np.lexsort((columns["start"], columns["id"], columns["none"]))
    new = np.zeros(len(by), np.int64)
    for k in ("start", "id", "none"):
        new[1:] |= columns[k][by][1:] != columns[k][by][:-1]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(h + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _blobs_by(blob: _Blob, bucket: np.ndarray, span_bucket: np.ndarray, codec):
    """(bucket, blob) for each bucket that has something."""
    sizes = blob.stretches["run"].astype(np.int64) + LENGTH - 1
    begins = np.cumsum(sizes) - sizes
    order, span_order = np.argsort(bucket, kind="stable"), np.argsort(span_bucket, kind="stable")
    b, s = bucket[order], span_bucket[span_order]
    for k in np.union1d(b, s):
        mine = order[np.searchsorted(b, k):np.searchsorted(b, k, "right")]
        gone = span_order[np.searchsorted(s, k):np.searchsorted(s, k, "right")]
        part = _Blob({n: v[mine] for n, v in blob.stretches.items()}, blob.text[_ranges(begins[mine], sizes[mine])], {n: v[gone] for n, v in blob.spans.items()})
        yield int(k), part.pack(codec)


def _mapper(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        codec, hasher = zstandard.ZstdCompressor(level=1), _Hasher()

        def rows(parts):
            """Of (id, none, th, first place, bytes)."""
            data = np.frombuffer(b"".join(p[4] for p in parts), np.uint8)
            size = np.array([len(p[4]) for p in parts])
            ids = {k: np.array([p[i] for p in parts], t) for i, (k, t) in enumerate(zip(("id", "none", "th", "start"), (np.int64, np.uint8, np.int32, np.int64)))}
            blob = _cut(hasher, data, np.cumsum(size) - size, size, ids)
            found = list(_blobs_by(blob, _bucket_of(blob.stretches["h"], buckets), _bucket_of(blob.spans["h"], buckets), codec))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["bucket", "blob"])

        held, size = [], 0
        for batch in batches:
            texts = batch.column("_text").cast(pa.large_binary())
            for i, th, text in zip(batch.column("_id"), batch.column("_th"), texts):
                text, i = text.as_py(), i.as_py()
                if len(text) < LENGTH:
                    continue
                for a in range(0, len(text) - LENGTH + 1, PIECE):  # a long text in parts that share LENGTH - 1 bytes
                    part = text[a:a + PIECE + LENGTH - 1]
                    held.append((i or 0, i is None, th.as_py(), a, part))
                    size += len(part)
                    if size >= PIECE:
                        yield rows(held)
                        held, size = [], 0
        if held:
            yield rows(held)
    return tidy(run)


def _whole_spans(stretches: dict, which: np.ndarray) -> dict:
    end = stretches["start"][which] + stretches["run"][which].astype(np.int64) + LENGTH - 1
    return {**{k: stretches[k][which] for k in ("id", "none", "th", "start")}, "end": end}


# --- sorting a bucket ------------------------------------------------------------

def _refined(words, offsets: tuple[int, ...], at: np.ndarray) -> np.ndarray:
    """Ranks of the strings at ``at``, compared by 8-byte words at ``offsets``;
    equal strings have equal ranks."""
    rank = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    for k, off in enumerate(offsets):
        word = words[at[open_] + off].astype(np.uint64)
        if k:
            by = np.argsort(word)
            step = np.zeros(len(by), np.int64)
            step[1:] = word[by][1:] != word[by][:-1]
            place = np.empty(len(by), np.int64)
            place[by] = np.cumsum(step)
            key = (rank[open_].astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)
        else:
            key = word
        by = np.argsort(key)
        ordered = key[by]
        new = np.ones(len(by), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if k:
            # ranks leave room for as many as share one: the first of a key has the rank of its old group plus those before it
            group = ordered >> np.uint64(32)
            start = np.ones(len(by), bool)
            start[1:] = group[1:] != group[:-1]
            begin = np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))
            first = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
            rank[open_[by]] = rank[open_[by]] + first - begin
        else:
            rank[open_[by]] = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        size = np.diff(np.append(np.flatnonzero(new), len(by)))
        open_ = open_[by][np.repeat(size > 1, size)]
        if not len(open_):
            break
    return rank


def repeated(text: np.ndarray, begin: np.ndarray, run: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which suffixes have an earlier equal LENGTH-string.  Stretches of
    ``run`` suffixes begin at ``begin`` in ``text``; ``order`` has a number for
    each suffix, smaller for earlier."""
    offset = _offsets()
    words = np.ndarray(shape=(max(0, len(text) - 7),), dtype=">u8", buffer=np.ascontiguousarray(text), strides=(1,))
    # ranks of the cover sample
    sampled = np.zeros(PERIOD, bool)
    sampled[list(COVER)] = True
    place = _ranges(begin, run + LENGTH - SAMPLE_LENGTH)
    place = place[sampled[place % PERIOD]]
    rank = np.full(len(text), -1, np.int32)
    rank[place] = _refined(words, (*range(0, SAMPLE_LENGTH - 7, 8), SAMPLE_LENGTH - 8), place)
    # suffixes by their first 32 bytes
    suffix = _ranges(begin, run)
    head = _refined(words, (0, 8, 16, 24), suffix)
    by = np.argsort(head)
    ordered = head[by]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(first, len(by)))
    tied = np.repeat(size > 1, size)
    by, size = by[tied], size[size > 1]
    out = np.zeros(len(suffix), bool)
    if not len(by):
        return out
    at = suffix[by]
    tail = _refined(words, (68, 76, 84, 92), at)

    def compare(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the order of suffixes that agree in their first 32 bytes."""
        d = offset[at[i] % PERIOD, at[j] % PERIOD]
        middle = np.sign(rank[at[i] + d] - rank[at[j] + d])
        return np.where(middle != 0, middle, np.sign(tail[i] - tail[j]))

    begins = np.cumsum(size) - size
    group = np.repeat(np.arange(len(size)), size)
    line = np.arange(len(at))
    mixed = np.zeros(len(size), bool)
    np.logical_or.at(mixed, group, compare(line, begins[group]) != 0)
    # ties that are not all equal are sorted, groups of like size together
    for power in range(1, 64):
        wide = 1 << power
        some = np.flatnonzero(mixed & (size > wide // 2) & (size <= wide))
        if not len(some):
            if (size <= wide).all():
                break
            continue
        per = max(1, 2_000_000 // wide)
        for k in range(0, len(some), per):
            g = some[k:k + per]
            cells = np.where(np.arange(wide) < size[g][:, None], begins[g][:, None] + np.arange(wide), -1)
            cells = _network(cells, compare)
            line[_ranges(begins[g], size[g])] = cells[cells >= 0]
    same = np.zeros(len(at), bool)
    same[1:] = (group[1:] == group[:-1])
    check = np.flatnonzero(same)
    same[check] = compare(line[check - 1], line[check]) == 0
    starts = np.flatnonzero(~same)
    mine = order[by[line]]
    least = np.repeat(np.minimum.reduceat(mine, starts), np.diff(np.append(starts, len(mine))))
    out[by[line[mine > least]]] = True
    return out


def _network(cells: np.ndarray, compare) -> np.ndarray:
    """Rows sorted by ``compare``, -1 last, by Batcher's odd-even merges: the
    same steps for every row, so all rows take a step at once."""
    n = cells.shape[1]
    p = 1
    while p < n:
        k = p
        while k:
            low = np.concatenate([np.arange(s, min(s + k, n - k)) for s in range(k % p, n - k, 2 * k)])
            low = low[(low // (2 * p)) == ((low + k) // (2 * p))]
            a, b = cells[:, low], cells[:, low + k]
            both = (a >= 0) & (b >= 0)
            swap = (a < 0) & (b >= 0)
            swap[both] = compare(a[both], b[both]) > 0
            cells[:, low], cells[:, low + k] = np.where(swap, b, a), np.where(swap, a, b)
            k //= 2
        p *= 2
    return cells


def _met_again(h: np.ndarray) -> np.ndarray:
    """The places of values that occur more than once, in order."""
    by = np.argsort(h)
    new = np.concatenate([[True], h[by][1:] != h[by][:-1]])[:len(h)]
    size = np.diff(np.append(np.flatnonzero(new), len(by)))
    return np.sort(by[np.repeat(size > 1, size)])


def _spans_of(blob: _Blob, hasher: _Hasher) -> dict:
    """Intervals that go, of all documents of a bucket."""
    gone = [blob.spans]
    several = _met_again(blob.stretches["h"])  # a hash met once has no equal
    blob = blob.taken(several)
    if len(several):  # equal stretches of different pieces
        size = blob.stretches["run"].astype(np.int64) + LENGTH - 1
        hasher.load(blob.text)
        again = _repeated_whole(hasher, blob.text, blob.stretches, np.cumsum(size) - size)
        gone.append(_whole_spans(blob.stretches, again))
        stay = np.ones(len(size), bool)
        stay[again] = False
        stay = np.flatnonzero(stay)
        blob = blob.taken(stay[_met_again(blob.stretches["h"][stay])])
    if len(blob.stretches["h"]):
        gone.append(_sorted_spans(blob))
    return {k: np.concatenate([x[k] for x in gone]) for k, _ in SPANS}


def _sorted_spans(blob: _Blob) -> dict:
    s = blob.stretches
    run = s["run"].astype(np.int64)
    begin = np.cumsum(run + LENGTH - 1) - (run + LENGTH - 1)
    owner = np.repeat(np.arange(len(run)), run)
    start = _ranges(s["start"], run)
    order = _order({"start": start, "id": s["id"][owner], "none": s["none"][owner]})
    gone = np.flatnonzero(repeated(blob.text, begin, run, order))
    # neighbours in one stretch are one interval
    new = np.ones(len(gone), bool)
    new[1:] = (np.diff(gone) != 1) | (owner[gone][1:] != owner[gone][:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(gone)) - 1 if len(gone) else first
    o = owner[gone[first]]
    return {"id": s["id"][o], "none": s["none"][o], "th": s["th"][o], "start": start[gone[first]], "end": start[gone[last]] + LENGTH}


def _singles(blob: _Blob, hasher: _Hasher) -> _Blob:
    """Each suffix for itself with the hash of its string; of equal ones the
    earliest, the others are intervals that go."""
    s, run = blob.stretches, blob.stretches["run"].astype(np.int64)
    begin = np.cumsum(run + LENGTH - 1) - (run + LENGTH - 1)
    at, owner = _ranges(begin, run), np.repeat(np.arange(len(run)), run)
    hasher.load(blob.text)
    h = hasher.strings(at, at + LENGTH)
    single = {"h": h, "id": s["id"][owner], "none": s["none"][owner], "th": s["th"][owner], "start": _ranges(s["start"], run), "run": np.ones(len(at), np.uint8)}
    order = _order(single)
    leader = _first_of_equals(h, order)
    raw = memoryview(blob.text)
    again = np.flatnonzero(order[leader] < order)
    again = again[np.array([raw[i:i + LENGTH] == raw[j:j + LENGTH] for i, j in zip(at[again].tolist(), at[leader[again]].tolist())], bool)]
    gone = {**{k: single[k][again] for k in ("id", "none", "th", "start")}, "end": single["start"][again] + LENGTH}
    stay = np.ones(len(h), bool)
    stay[again] = False
    stay = np.flatnonzero(stay)
    return _Blob({k: v[stay] for k, v in single.items()}, blob.text[_ranges(at[stay], np.full(len(stay), LENGTH))], {k: np.concatenate([gone[k], blob.spans[k]]) for k, _ in SPANS})


def _slices(blob: _Blob, most: int) -> Iterator[_Blob]:
    """The blob in parts whose suffixes take about ``most`` bytes as singles."""
    which = np.cumsum(blob.stretches["run"].astype(np.int64) * LENGTH) // most
    for k in np.unique(which):
        part = blob.taken(np.flatnonzero(which == k))
        yield _Blob(part.stretches, part.text, _no_spans())
    yield _Blob({k: np.zeros(0, t) for k, t in FIELDS}, np.zeros(0, np.uint8), blob.spans)


def _sorter(most: int, level: int, sort: int = SORT, sort_most: int = SORT_MOST):
    """Rows (bucket, blob), sorted by bucket: intervals (bucket -1), or the
    parts of a bucket as rows for the next pass, if it has more than ``most``
    bytes or some to sort at once are more than ``sort_most``.  From the second
    pass (``level``) on suffixes come as singles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        reader, codec, hasher = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1), _Hasher()
        names = ["bucket", "blob", "id", "none", "th", "start", "end"]
        kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())

        def spans(found: dict):
            n = len(found["id"])
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, -1)), pa.nulls(n, pa.binary()), *(
                pa.array(found[k].astype(bool) if k == "none" else found[k], t) for (k, _), t in zip(SPANS, kinds))], names)

        def parted(blob: _Blob):
            """Singles, dealt out by the hash of their strings with the pass."""
            part = _bucket_of(_mixed(blob.stretches["h"] + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))), PARTS)
            rows = list(_blobs_by(_Blob(blob.stretches, blob.text, _no_spans()), part, np.zeros(0, np.int64), codec))
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([bucket * PARTS + k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary()),
                                              *(pa.nulls(n, t) for t in kinds)], names)
            yield spans(blob.spans)

        held, size, bucket, split = [], 0, None, False

        def singles(blobs: list[_Blob]) -> Iterator[_Blob]:
            """What is left of repeats among the suffixes of some blobs."""
            if level > 1:
                yield _singles(_Blob.joined(blobs), hasher)
            else:
                yield from (_singles(part, hasher) for b in blobs for part in _slices(b, sort_most))

        def overfull():
            """What is held moves on, but for mostly equal strings, of which little is left."""
            nonlocal held, size, split
            blobs, held, size = list(singles(held)) if level > 1 else singles(held), [], 0
            if level > 1 and not split and len(blobs[0].text) <= most // 2:
                yield spans(blobs[0].spans)
                held, size = [_Blob(blobs[0].stretches, blobs[0].text, _no_spans())], len(blobs[0].text)
                return
            split = True
            for b in blobs:
                yield from parted(b)

        def done():
            if held and split:
                yield from overfull()
                return
            several = size // sort + 1
            turn = [(_mixed(b.stretches["h"] ^ np.uint64(level)) >> np.uint64(20)) % np.uint64(several) for b in held]
            for b in held:
                yield spans(b.spans)
            for k in range(several if held else 0):
                blob = _Blob.joined([b.taken(np.flatnonzero(t == k)) for b, t in zip(held, turn)])
                blob = _Blob(blob.stretches, blob.text, _no_spans())
                if len(blob.text) <= sort_most:
                    yield spans(_spans_of(blob, hasher))
                    continue
                for b in singles([blob]):
                    if level > 1 and len(b.text) <= sort_most:
                        yield spans(_spans_of(b, hasher))
                    else:
                        yield from parted(b)

        for batch in batches:
            for k, x in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                if k != bucket:
                    yield from done()
                    held, size, bucket, split = [], 0, k, False
                blob = _Blob.unpack(x.as_py(), reader)
                held.append(blob)
                size += len(blob.text)
                if size > most:
                    yield from overfull()
        yield from done()
    return tidy(run)


def _remover():
    """What the intervals leave of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        for batch in batches:
            cuts = batch.column("_cuts")
            many = pc.fill_null(pc.list_value_length(cuts), 0).to_numpy(zero_copy_only=False)
            flat = cuts.flatten()
            row = np.repeat(np.arange(len(many)), many) << 40
            a, b = (row + flat.field(k).to_numpy() for k in range(2))
            order = np.argsort(a)
            a, b = a[order], np.maximum.accumulate(b[order]) if len(order) else b
            new = np.ones(len(a), bool)
            new[1:] = a[1:] > b[:-1]
            first = np.flatnonzero(new)
            a, b = a[first], b[np.append(first[1:], len(b)) - 1 if len(first) else first]
            each = np.searchsorted(a, np.arange(len(many) + 1) << 40)
            mask = (1 << 40) - 1
            a, b = (a & mask).tolist(), (b & mask).tolist()
            n_bytes, removed, spans, sha, kept = [], [], [], [], []
            for i, text in enumerate(batch.column("_text").cast(pa.large_binary())):
                raw, digest, at, left, out = memoryview(text.as_py()), hashlib.sha256(), 0, [], 0
                for c in range(each[i], each[i + 1]):
                    digest.update(raw[at:a[c]])
                    if at < a[c]:
                        left.append([at, a[c]])
                    out += b[c] - a[c]
                    at = b[c]
                digest.update(raw[at:])
                if at < len(raw):
                    left.append([at, len(raw)])
                n_bytes.append(len(raw))
                removed.append(out)
                spans.append(int(each[i + 1] - each[i]))
                sha.append(digest.hexdigest())
                kept.append(left)
            keep = [c for c in batch.schema.names if c not in ("_text", "_cuts")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(sha, pa.string()), pa.array(kept, pa.list_(pa.list_(pa.int64())))],
                [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return tidy(run)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None,
                   bucket_most: int = BUCKET_MOST, sort: int = SORT, sort_most: int = SORT_MOST) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per row of
    ``docs``; ``kept`` has the byte ranges that stay.

    A byte goes if a string of 100 bytes over it also starts earlier: in a
    smaller id (null after all others), or earlier in the same one.  Rows of
    one id are one document in this: of strings at the same place none is
    earlier.  A null text is empty; texts under 100 bytes stay whole.  Other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.withColumn("_th", F.hash("_text"))
    if buckets is None:
        total = rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
        buckets = max(4 * shuffle_partitions(spark), 4 * total // BUCKET + 1)
    out = f"{ROWS}, {SPAN_SCHEMA}"
    by_bucket = lambda df: df.select("bucket", "blob").repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket")
    dealt, gone, level = rows.mapInArrow(_mapper(buckets), ROWS), None, 1
    while True:  # a pass splits a bucket in PARTS
        with small_batches(spark):
            found = written(by_bucket(dealt).mapInArrow(_sorter(bucket_most, level, sort, sort_most), out), f"suffix-spans-{level}")
        here = found.filter("bucket < 0")
        gone = here if gone is None else gone.unionByName(here)
        dealt, level = found.filter("bucket >= 0"), level + 1
        if not dealt.limit(1).count():
            break
    cuts = (gone.withColumn("id", F.when(~F.col("none"), F.col("id"))).groupBy("id", "th")
            .agg(F.collect_set(F.struct("start", "end")).alias("_cuts")))
    joined = rows.join(cuts, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")), "left")
    kept = joined.select("_id", "_text", "_cuts").mapInArrow(
        _remover(), "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept array<array<long>>")
    return kept.withColumnRenamed("_id", id_col)


ship(__name__)

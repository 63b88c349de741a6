"""Token counts of whole texts with a fixed public tokenizer.

Words between ASCII white space are encoded apart: the tokenizer's
normaliser works on single characters and on composition, which never
crosses white space; its pre-tokenizer drops white space; and its special
strings hold none.  So a text's ids are its words' ids one after the other
(tests hold this against the library on whole texts), and a word's ids can
be kept in a bounded memo.

Documents of more than ``chunk`` characters are cut into overlapping chunks
that different tasks encode with offsets.  Neighbours are spliced at a token
that starts after white space, at the same place and with the same id in
both encodings; where the overlap holds none, it is widened fourfold and the
document done again, at last as one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import in_slices, ship, text_of, tidy, written

MODEL_FILE = "word_bpe_49k.json"
#: characters of a chunk of a huge document, and of the first overlap
CHUNK, OVERLAP = 48 * 1024, 1024
#: words that a task's memo keeps
MEMO_WORDS = 1_000_000


def tokenizer_path(name: str = MODEL_FILE) -> str:
    """Where the vocabulary file lies (the same on every machine)."""
    import public_tokenizers
    return public_tokenizers.path(name)


class _Memo:
    """Where the ids of known words lie: hashes in order, place and number of
    ids.  New words gather in a small part before they join the large one."""

    def __init__(self):
        self.parts = [[np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in range(2)]

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, place, size = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for have, at, n in self.parts:
            if len(have):
                i = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[i] == keys
                known |= hit
                place[hit], size[hit] = at[i[hit]], n[i[hit]]
        return known, place, size

    def add(self, *columns: np.ndarray) -> None:
        self.parts[1] = self._joined(self.parts[1], columns)
        if len(self.parts[1][0]) > 50_000:
            self.parts = [self._joined(*self.parts), [c[:0] for c in columns]]

    @staticmethod
    def _joined(a, b) -> list[np.ndarray]:
        columns = [np.concatenate(x) for x in zip(a, b)]
        order = np.argsort(columns[0])
        return [c[order] for c in columns]


class WordEncoder:
    """Token ids of texts.

    Words of a block of text are found, hashed (64 bits, by prefix sums) and
    made distinct as arrays; the library encodes those that the memo lacks.
    The memo keeps the first ``memo_words`` words met and stays as it is
    then; other words live as long as their block.  Words of over 255 bytes
    are encoded each time they occur.
    """

    BLOCK, LONG = 1 << 20, 255
    #: a word between words while learning; its ids mark where one ends
    MARK = "\u2603"

    def __init__(self, path: str | None, memo_words: int = MEMO_WORDS):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo_words, self.memo = memo_words, _Memo()
        self.pool = np.zeros(0, np.uint32)
        self.mark = np.array(self.tokenizer.encode(self.MARK, add_special_tokens=False).ids, np.uint32)
        rng = np.random.default_rng(64)
        self.of_byte = rng.integers(0, 1 << 64, 256, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.base = int(rng.integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1
        self.powers = self.inverses = np.ones(1, np.uint64)

    @classmethod
    def of_worker(cls, path: str | None) -> WordEncoder:
        """The encoder that this Python worker keeps from task to task."""
        import sys
        import types
        kept = sys.modules.setdefault("_quarry_worker", types.ModuleType("_quarry_worker")).__dict__
        key = f"encoder {path}"
        if key not in kept:
            kept[key] = cls(path)
        return kept[key]

    def _grow(self, n: int) -> None:
        while len(self.powers) < n:
            m = len(self.powers)
            self.powers, self.inverses = (
                np.concatenate([x, x * np.uint64(pow(b, m, 1 << 64))]) for x, b in ((self.powers, self.base), (self.inverses, pow(self.base, -1, 1 << 64))))

    def _encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; many words make one call."""
        found: list[np.ndarray] = []
        for k in range(0, len(words), 2000):
            part = [w.decode() for w in words[k:k + 2000]]
            if any(self.MARK in w or "<|" in w for w in part):
                found += [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) for w in part]
                continue
            line = f" {self.MARK} ".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(np.all([ids[i:len(ids) - len(self.mark) + 1 + i] == m for i, m in enumerate(self.mark)], axis=0))
            starts, ends = [0, *(at + len(self.mark)).tolist()], [*at.tolist(), len(ids)]
            if len(starts) != len(part):  # a word's own ids look like the mark
                found += [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) for w in part]
            else:
                found += [ids[a:b] for a, b in zip(starts, ends)]
        return found

    def _learn(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of new words.  A plain ASCII word that ends in punctuation after
        a letter or digit is its lower-cased body and that punctuation: the
        pre-tokenizer always parts the two.  ("<|" may begin a special
        string, which is case-sensitive and never parted.)"""
        parted, plain = [], {}
        for w in words:
            low, tail = w, b""
            if w.isascii() and b"<|" not in w:
                low = w.lower()
                body = low.rstrip(b".,;:!?*$%&#)\"]}|")
                if body and body[-1:].isalnum():
                    low, tail = body, low[len(body):]
            parted.append((plain.setdefault(low, len(plain)), plain.setdefault(tail, len(plain)) if tail else -1))
        ids = self._encode(list(plain))
        return [ids[a] if b < 0 else np.concatenate([ids[a], ids[b]]) for a, b in parted]

    def _block(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start of each word, its place in the pool, its number of ids, the pool)."""
        raw = np.frombuffer(data, np.uint8)
        self._grow(len(raw) + 1)
        blank = self.space[raw]
        inside = np.concatenate([[False], ~blank, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.of_byte[raw] * self.powers[:len(raw)], out=sums[1:])
        key = (sums[end] - sums[start]) * self.inverses[start]
        long = end - start > self.LONG
        key[long] = np.arange(np.count_nonzero(long), dtype=np.uint64)  # no word is taken for another
        order = np.argsort(key)
        first = np.ones(len(key), bool)
        first[1:] = key[order][1:] != key[order][:-1]
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(first) - 1
        example = order[first]
        keys = key[example]
        known, place, size = self.memo.find(keys)
        known &= ~long[example]
        new = np.flatnonzero(~known)
        pool = self.pool
        if len(new):
            ids = self._learn([data[a:b] for a, b in zip(start[example[new]].tolist(), end[example[new]].tolist())])
            size[new] = [len(x) for x in ids]
            place[new] = len(pool) + np.cumsum(size[new]) - size[new]
            pool = np.concatenate([pool, *ids])
            keep = new[~long[example[new]]]
            if len(self.memo) + len(keep) <= self.memo_words:
                self.memo.add(keys[keep], place[keep], size[keep])
                self.pool = pool
        return start, place[which], size[which], pool

    def _blocks(self, texts: list[bytes]):
        """(first text, number of texts, data) of about BLOCK bytes each; a longer
        text comes in parts that end at white space."""
        at = 0
        while at < len(texts):
            if len(texts[at]) > self.BLOCK:
                text, a = texts[at], 0
                while a < len(text):
                    b = a + self.BLOCK
                    while b < len(text) and not self.space[text[b]]:
                        b += 1
                    yield at, 1, text[a:b]
                    a = b
                at += 1
                continue
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= self.BLOCK):
                size += len(texts[to]) + 1
                to += 1
            yield at, to - at, b"\n".join(texts[at:to])
            at = to

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """How many ids each text has."""
        out = np.zeros(len(texts), np.int64)
        for at, n, data in self._blocks(texts):
            start, _, size, _ = self._block(data)
            begins = np.cumsum([0, *(len(t) + 1 for t in texts[at:at + n])])[:n] if n > 1 else np.zeros(1, np.int64)
            total = np.concatenate([[0], np.cumsum(size)])[np.append(np.searchsorted(start, begins), len(start))]
            out[at:at + n] += np.diff(total)
        return out

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        out: list[bytes] = []
        for at, n, data in self._blocks(texts):
            start, place, size, pool = self._block(data)
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            ids = pool[np.repeat(place - (ends - size), size) + np.arange(total)].astype("<u4").tobytes()
            begins = np.cumsum([0, *(len(t) + 1 for t in texts[at:at + n])])[:n] if n > 1 else np.zeros(1, np.int64)
            cuts = 4 * np.concatenate([[0], ends])[np.append(np.searchsorted(start, begins), len(start))]
            found = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
            if len(out) > at:  # a further part of one text
                out[at] += found[0]
            else:
                out += found
        return out

    def ids(self, text: bytes) -> bytes:
        return self.ids_of([text])[0]

    def offsets(self, text: str) -> tuple[list[int], list[int]]:
        """Ids and the characters at which they start, of one chunk."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return e.ids, [a for a, _ in e.offsets]


def _counter(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_worker(path)
        for batch in in_slices(batches):
            texts = batch.column("_text").cast(pa.large_binary()).to_pylist()
            n = encoder.counts(texts)
            keep = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64())],
                                             [*keep, "n_tokens"])
    return tidy(run)


def _chunk_encoder(path: str | None, chunk: int, overlap: int):
    """For each chunk its token count (seam -1), and the stable token starts
    near both ends: seam c joins chunk c (left) and chunk c + 1 (right)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_worker(path)
        for batch in batches:
            for sha, c, text in zip(*(batch.column(k).to_pylist() for k in ("sha", "c", "part"))):
                ids, starts = encoder.offsets(text)
                rows = [(sha, -1, False, -1, -1, len(ids))]
                for i, (token, at) in enumerate(zip(ids, starts)):
                    if at and text[at - 1] in " \t\n\v\f\r":
                        if c and at < overlap:
                            rows.append((sha, c - 1, True, c * chunk + at, token, i))
                        if at >= chunk:
                            rows.append((sha, c, False, c * chunk + at, token, len(ids) - i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()))],
                    ["sha", "seam", "right", "pos", "token", "n"])
    return tidy(run)


def _huge_counts(texts: DataFrame, path: str | None, chunk: int, overlap: int) -> DataFrame:
    """(sha, n_tokens) of the distinct huge texts (sha, _text, n_chars)."""
    done, longest = None, None
    while True:
        last = F.ceil(F.col("n_chars") / F.lit(chunk)).cast("int") - 1
        parts = (texts.select("sha", "_text", F.explode(F.sequence(F.lit(0), last)).alias("c"))
                 .select("sha", "c", F.substring("_text", F.col("c") * chunk + 1, F.lit(chunk + overlap)).alias("part"))
                 .dropDuplicates(["sha", "c"]))
        found = written(parts.mapInArrow(_chunk_encoder(path, chunk, overlap),
                                         "sha string, seam long, right boolean, pos long, token long, n long"), "token-seams")
        sizes = found.filter("seam < 0").groupBy("sha").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("chunks"))
        ends = found.filter("seam >= 0")
        seams = (ends.filter("not right").join(ends.filter("right").withColumnRenamed("n", "m"), ["sha", "seam", "pos", "token"])
                 .groupBy("sha", "seam").agg(F.min(F.struct("pos", "n", "m")).alias("at"))
                 .groupBy("sha").agg(F.sum(F.col("at.n") + F.col("at.m")).alias("twice"), F.count(F.lit(1)).alias("seams")))
        both = (sizes.join(seams, "sha", "left").na.fill(0, ["twice", "seams"]))
        spliced = written(both.select("sha", (F.col("n") - F.col("twice")).alias("n_tokens"),
                                      (F.col("seams") == F.col("chunks") - 1).alias("whole")), "token-spliced")
        good = spliced.filter("whole").select("sha", "n_tokens")
        done = good if done is None else done.unionByName(good)
        if not spliced.filter("not whole").limit(1).count():
            return done
        texts = texts.join(spliced.filter("not whole").select("sha"), "sha", "left_semi")
        overlap *= 4
        longest = longest or texts.agg(F.max("n_chars")).first()[0]
        if overlap >= longest:
            chunk = longest


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per row of ``docs``.

    A null or empty text has no tokens.  Rows are kept as they are: null and
    repeated ids give a row each, equal texts equal counts.  Other columns of
    ``docs`` are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.withColumn("n_chars", F.length("_text"))
    sized = rows.withColumn("n_bytes", F.octet_length("_text").cast("long"))
    id_type = docs.schema[id_col].dataType.simpleString()
    small = (sized.filter(F.col("n_chars") <= chunk).select("_id", "n_bytes", "_text")
             .mapInArrow(_counter(path), f"_id {id_type}, n_bytes long, n_tokens long"))
    huge = sized.filter(F.col("n_chars") > chunk).withColumn("sha", F.sha2("_text", 256))
    if huge.limit(1).count():
        counts = _huge_counts(huge.select("sha", "_text", "n_chars"), path, chunk, overlap)
        small = small.unionByName(huge.select("_id", "n_bytes", "sha").join(counts, "sha").drop("sha"))
    return small.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


ship(__name__)

"""Language identification by character language models.

Each language has an interpolated Kneser-Ney model of the ``ORDER`` - 1
characters before a character.  Counts of character strings cover every
training text whole: tasks count their batches, one shuffle adds the counts
up.  All lower orders follow from the distinct strings of the highest (what
counts there is before how many characters a string occurs), so the estimates
need nothing else of the corpus.

Estimates lie in arrays sorted by the strings' hashes, one row a string and
one column a language, with what unseen strings cost worked out beforehand.  A
task counts the distinct strings of each of its documents, looks them up, and
takes the language of the lowest cross-entropy a character.

If all strings of all languages are more than a task should hold, the same
estimates are worked out by joins, order by order, and kept as tables.  Tasks
then hold the costs of the most frequent strings; the other strings of each
document, seen or not, meet theirs in a join.

One fifth of the training documents is not counted but calibrates: it gives the
temperature that turns cross-entropies into the score, and each
language's limit of cross-entropy and score beyond which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import in_slices, ship, text_of, tidy, written

ORDER = 5
#: what the arrays of the highest order may hold (strings times languages); beyond, the rarest strings are joined
MOST_CELLS = 8_000_000
#: calibration: the share of a language's own texts that may be rejected, and the temperatures tried
REJECT, GRID = 0.005, np.geomspace(0.005, 2, 40)
#: characters counted at once
SLICE = 4 << 20


# --- characters ----------------------------------------------------------------------

def _folded(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with 32 for what is neither a letter nor a
    mark on one; and which are letters."""
    import unicodedata
    seen = np.unique(text)
    small, letter = np.full(len(seen), 32, np.uint32), np.zeros(len(seen), bool)
    for i, code in enumerate(seen.tolist()):
        kind = unicodedata.category(chr(code))[0]
        letter[i] = kind == "L"
        if kind in "LM":
            low = chr(code).lower()
            small[i] = ord(low) if len(low) == 1 else code
    at = np.searchsorted(seen, text)
    return small[at], letter[at]


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, document, letters of each document): every document with
    ORDER - 1 spaces before it and one after it, runs of other characters as
    one space."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    size = np.array([len(r) // 4 for r in raw], np.int64)
    codes, letter = _folded(np.frombuffer(b"".join(raw), np.uint32))
    doc = np.repeat(np.arange(len(texts)), size)
    letters = np.bincount(doc[letter], minlength=len(texts))
    new = np.ones(len(codes), bool)
    new[1:] = doc[1:] != doc[:-1]
    before = np.ones(len(codes), bool)
    before[1:] = (codes[:-1] == 32) | new[1:]
    stay = (codes != 32) | ~before  # no space after a space or at the start
    codes, doc = codes[stay], doc[stay]
    size = np.bincount(doc, minlength=len(texts))
    last = np.cumsum(size) - 1
    open_ = (size > 0) & (codes[last] != 32) if len(codes) else np.zeros(len(texts), bool)
    ahead = ORDER - 1
    total = np.where(size > 0, size + open_ + ahead, 0)
    ends = np.cumsum(total)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint32)
    begin = ends - total + ahead
    out[np.repeat(begin - (last - size + 1), size) + np.arange(len(codes))] = codes
    return out, np.repeat(np.arange(len(texts)), total), letters


def _strings(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where strings of ORDER characters of one document begin."""
    if len(codes) < ORDER:
        return np.zeros(0, np.int64)
    return np.flatnonzero(doc[ORDER - 1:] == doc[:len(doc) - ORDER + 1])


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """48 bits of hash over a string's characters."""
    h = np.full(len(columns[0]) if columns else 1, len(columns), np.uint64)
    for c in columns:
        h = (h + c.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(16)


# --- counting -------------------------------------------------------------------------

def _counter():
    """(lang, gram, c) of the texts of each slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                codes, doc, _ = _characters(texts)
                at = _strings(codes, doc)
                key, first, c = np.unique(_hash([codes[at + j] for j in range(ORDER)]), return_index=True, return_counts=True)
                chars = np.stack([codes[at[first] + j] for j in range(ORDER)], 1) if len(at) else np.zeros((0, ORDER), np.uint32)
                joined = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                grams = [joined[k:k + ORDER] for k in range(0, len(joined), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(grams, pa.string()), pa.array(c, pa.int64())], ["lang", "gram", "c"])

        held: dict[str, list[str]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("_text")):
                whole = text.as_py()
                for k in range(0, max(1, len(whole)), SLICE):  # a very long text by parts, each as a text
                    part = whole[k:k + SLICE]
                    held.setdefault(lang.as_py(), []).append(part)
                    size += len(part) + 20
                    if size >= SLICE:
                        yield from counted(held)
                        held, size = {}, 0
        yield from counted(held)
    return tidy(run)


def counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, c) of rows (lang, _text): how often strings of ORDER
    characters occur in a language's texts."""
    return rows.mapInArrow(_counter(), "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


# --- the model ------------------------------------------------------------------------

class Model:
    """For each order the hashes of its strings, sorted, with their log
    probabilities in each language; and those of contexts with the weight
    that shorter strings have after them."""

    whole = True  # costs what it does not hold, too

    def __init__(self, langs: list[str], grams: list, contexts: list, unseen: np.ndarray):
        self.langs, self.grams, self.contexts, self.unseen = langs, grams, contexts, unseen
        self.temperature, self.limits, self.least_score = 0.1, np.full(len(langs), np.inf), 0.0

    @staticmethod
    def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        return at, keys[at] == h if len(keys) else np.zeros(len(h), bool)

    def costs(self, chars: np.ndarray, order: int, known: np.ndarray | None = None) -> np.ndarray:
        """-log probability of the last character of each string after the
        others, in each language (columns)."""
        if not order:
            return np.broadcast_to(-self.unseen, (len(chars), len(self.langs)))
        h = _hash([chars[:, j] for j in range(chars.shape[1] - order, chars.shape[1])]) if known is None else known
        keys, logs = self.grams[order]
        at, hit = self._find(keys, h)
        out = -logs[at] if len(keys) else np.zeros((len(h), len(self.langs)), np.float32)
        miss = np.flatnonzero(~hit)
        if len(miss):
            out[miss] = self.backed_off(chars[miss], order)
        return out

    def backed_off(self, chars: np.ndarray, order: int) -> np.ndarray:
        """What a string costs that the order does not hold."""
        out = np.array(self.costs(chars, order - 1))
        keys, weight = self.contexts[order]
        n = chars.shape[1]
        at, hit = self._find(keys, _hash([chars[:, j] for j in range(n - order, n - 1)]) if order > 1 else np.zeros(len(chars), np.uint64))
        out[hit] -= weight[at[hit]]
        return out


def estimate(langs: list[str], lang: np.ndarray, chars: np.ndarray, c: np.ndarray, order: int = ORDER) -> Model:
    """The model from distinct (language number, string) and their counts."""
    alphabet = max(2, len(np.unique(chars)) + 1)
    grams, contexts = [None] * (order + 1), [None] * (order + 1)
    model = Model(langs, grams, contexts, np.full(len(langs), -np.log(alphabet), np.float32))
    levels = {order: (lang, chars, c.astype(np.float64))}
    for n in range(order - 1, 0, -1):
        l, x, _ = levels[n + 1]
        key = _pair(l, _hash([x[:, j] for j in range(1, n + 1)]))
        _, first, count = np.unique(key, return_index=True, return_counts=True)  # how many characters it comes after
        levels[n] = l[first], x[first, 1:], count.astype(np.float64)
    for n in range(1, order + 1):
        l, x, count = levels[n]
        h = _hash([x[:, j] for j in range(n)])
        ctx = _hash([x[:, j] for j in range(n - 1)]) if n > 1 else np.zeros(len(x), np.uint64)
        # absolute discounts from the numbers of strings met once and twice
        once, twice = (np.bincount(l[count == k], minlength=len(langs)) for k in (1, 2))
        discount = np.where(once > 0, once / np.maximum(1, once + 2 * twice), 0.5)[l]
        groups, group = np.unique(_pair(l, ctx), return_inverse=True)
        total, kinds = np.bincount(group, count, len(groups)), np.bincount(group, discount, len(groups))
        weight = kinds / np.maximum(total, 1)
        own = np.maximum(count - discount, 0) / total[group] if len(x) else np.zeros(0)
        lower = np.exp(-model.costs(x, n - 1))[np.arange(len(x)), l] if len(x) else np.zeros(0)
        ctx_keys, at = np.unique(ctx, return_inverse=True)
        weights = np.zeros((len(ctx_keys), len(langs)), np.float32)
        weights[at, l] = np.log(np.maximum(weight, 1e-12))[group]
        contexts[n] = (ctx_keys, weights)
        keys, first, at = np.unique(h, return_index=True, return_inverse=True)
        logs = -model.backed_off(x[first], n) if len(x) else np.zeros((0, len(langs)), np.float32)  # languages without the string
        logs[at, l] = np.log(np.maximum(own + weight[group] * lower, 1e-12))
        grams[n] = (keys, logs.astype(np.float32))
    return model


def _pair(lang: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (lang.astype(np.uint64) << np.uint64(48)) | h


# --- a model larger than a task should hold --------------------------------------------

def _cut(start: int, n: int, column: str = "gram") -> Column:
    return F.substring(column, start, n) if n else F.lit("")


def _by_language(langs: list[str], values) -> Column:
    return F.create_map(*[F.lit(v) for pair in zip(langs, values) for v in pair])[F.col("lang")]


class Tables:
    """The estimates as tables of each order: what a string costs in the
    languages that have it, and what the languages' shorter strings cost more
    after a context."""

    def __init__(self, langs: list[str], table: DataFrame):
        self.langs, self.steps = langs, []
        levels = {ORDER: table}
        for n in range(ORDER - 1, 0, -1):
            levels[n] = written(levels[n + 1].groupBy("lang", _cut(2, n).alias("gram")).agg(F.count("*").alias("c")), f"lang-{n}")
        self.alphabet = max(2, levels[1].select("gram").distinct().count() + 1)
        shorter = None
        for n in range(1, ORDER + 1):
            met = {r["lang"]: r for r in levels[n].groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).collect()}
            discount = _by_language(langs, [met[x]["once"] / (met[x]["once"] + 2 * met[x]["twice"]) if met[x]["once"] else 0.5 for x in langs])
            level = levels[n].select("lang", "gram", "c", discount.alias("d"), _cut(1, n - 1).alias("ctx"), _cut(2, n - 1).alias("suffix"))
            ctx = written(level.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("kinds")), f"lang-contexts-{n}")
            level = level.join(ctx, ["lang", "ctx"])
            level = level.withColumn("lower", F.lit(1 / self.alphabet)) if n == 1 else level.join(
                shorter.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
            shorter = written(level.select("lang", "gram", ((F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) + F.col("kinds") * F.col("lower")) / F.col("total")).alias("p")), f"lang-chances-{n}")
            self.steps.append((self._mapped(shorter, "gram", F.col("p"), n), self._mapped(ctx, "ctx", F.col("kinds") / F.col("total"), n)))

    def _mapped(self, df: DataFrame, key: str, chance: Column, n: int) -> DataFrame:
        """(key, costs by number of language), a row a string."""
        entry = F.struct(_by_language(self.langs, range(len(self.langs))), -F.ln(F.greatest(chance, F.lit(1e-12))))
        return written(df.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias(f"{key}_costs")), f"lang-{key}-{n}")

    def costs(self, strings: DataFrame) -> DataFrame:
        """(gram, costs) of distinct strings (gram), seen or not: one cost for each language."""
        asked = {ORDER: strings}
        for n in range(ORDER - 1, 0, -1):
            asked[n] = asked[n + 1].select(_cut(2, n).alias("gram")).distinct()
        known = None
        for n, (grams, contexts) in enumerate(self.steps, 1):
            rows = asked[n].select("gram", _cut(1, n - 1).alias("ctx"), _cut(2, n - 1).alias("suffix"))
            rows = rows.withColumn("lower", F.array_repeat(F.lit(float(np.log(self.alphabet))), len(self.langs))) if n == 1 else rows.join(
                known.select(F.col("gram").alias("suffix"), F.col("costs").alias("lower")), "suffix")
            rows = rows.join(grams, "gram", "left").join(contexts, "ctx", "left")
            known = written(rows.select("gram", F.transform("lower", lambda x, i: F.coalesce(
                F.try_element_at("gram_costs", i), x + F.coalesce(F.try_element_at("ctx_costs", i), F.lit(0.0)))).alias("costs")), f"lang-costs-{n}")
        return known


class Frequent:
    """What the most frequent strings cost, for the tasks; others are for a join."""

    whole = False

    def __init__(self, langs: list[str], rows: pa.Table):
        chars = np.frombuffer("".join(rows.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
        self.langs = langs
        self.temperature, self.limits, self.least_score = 0.1, np.full(len(langs), np.inf), 0.0
        self.keys, first = np.unique(_hash([chars[:, j] for j in range(ORDER)]), return_index=True)
        values = rows.column("costs").combine_chunks()
        self.values = values.flatten().to_numpy().reshape(-1, len(langs)).astype(np.float32)[first] if len(values) else np.zeros((0, len(langs)), np.float32)

    def missing(self, h: np.ndarray) -> np.ndarray:
        return ~Model._find(self.keys, h)[1]

    def costs(self, chars: np.ndarray, order: int, known: np.ndarray) -> np.ndarray:
        at, hit = Model._find(self.keys, known)
        out = np.zeros((len(known), len(self.langs)), np.float32)
        out[hit] = self.values[at[hit]]
        return out


# --- scoring --------------------------------------------------------------------------

def _entropies(model: Model | Frequent, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
    """Cross-entropy a character of each text in each language, and letters;
    with (text, string, its share of the text's strings) of those that the
    cross-entropy leaves to a join."""
    codes, doc, letters = _characters(texts)
    at = _strings(codes, doc)
    h = _hash([codes[at + j] for j in range(ORDER)])
    key, first, c = np.unique((doc[at].astype(np.uint64) << np.uint64(48)) | h, return_index=True, return_counts=True)
    place = at[first]
    chars = np.stack([codes[place + j] for j in range(ORDER)], 1) if len(place) else np.zeros((0, ORDER), np.uint32)
    cost = model.costs(chars, ORDER, key & np.uint64((1 << 48) - 1)) * c[:, None]
    owner = (key >> np.uint64(48)).astype(np.int64)
    n = np.bincount(owner, c, len(texts))
    sums = np.zeros((len(texts), len(model.langs)))
    for k in range(len(model.langs)):
        sums[:, k] = np.bincount(owner, cost[:, k], len(texts))
    rest = []
    if not model.whole:
        off = np.flatnonzero(model.missing(key & np.uint64((1 << 48) - 1)))
        joined = chars[off].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        rest = [*zip(owner[off].tolist(), (joined[k:k + ORDER] for k in range(0, len(joined), ORDER)), (c[off] / n[owner[off]]).tolist())]
    return sums / np.maximum(n, 1)[:, None], letters, rest


def _by_parts(model: Model | Frequent, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
    """As ``_entropies``, in parts of bounded size: some documents, or a part
    of a long one; the strings left over by text."""
    parts, owner, size = [], [], []
    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t)), SLICE):
            parts.append(t[k:k + SLICE])
            owner.append(i)
    sums, weights, letters = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    owner, size = np.array(owner, np.int64), np.array([len(p) for p in parts], np.int64)
    batch = np.cumsum(size + 20) // SLICE
    whole, left = np.bincount(owner, size, len(texts)), [[] for _ in texts]
    for b in np.unique(batch):
        mine = np.flatnonzero(batch == b)
        h, n, rest = _entropies(model, [parts[i] for i in mine])
        for i, gram, share in rest:
            i = mine[i]
            left[owner[i]].append((gram, share * size[i] / max(1, whole[owner[i]])))
        np.add.at(sums, owner[mine], h * size[mine, None])
        np.add.at(weights, owner[mine], size[mine])
        np.add.at(letters, owner[mine], n)
    return sums / np.maximum(weights, 1)[:, None], letters, left


def _chances(h: np.ndarray, temperature: float) -> np.ndarray:
    x = -(h - h.min(1, keepdims=True)) / temperature
    e = np.exp(x)
    return e / e.sum(1, keepdims=True)


def _losses(names: list[str]):
    """(loss of each temperature, summed, rows) of rows (lang, h), one row a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, sums, n = {x: i for i, x in enumerate(names)}, np.zeros(len(GRID)), 0
        for batch in in_slices(batches):
            h = np.array(batch.column("h").to_pylist(), np.float64).reshape(-1, len(names))
            truth = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            sums += [-np.log(np.maximum(_chances(h, t)[np.arange(len(h)), truth], 1e-9)).sum() for t in GRID]
            n += len(h)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64())), pa.array([n])], ["sums", "n"])
    return tidy(run)


def _own(names: list[str], temperature: float):
    """(k, x) of the rightly told rows (lang, h): the cross-entropy for its
    language's number, and the score, negative, for -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(names)}
        for batch in in_slices(batches):
            h = np.array(batch.column("h").to_pylist(), np.float64).reshape(-1, len(names))
            truth = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            right = h.argmin(1) == truth
            h, truth = h[right], truth[right]
            k, x = np.concatenate([truth, np.full(len(h), -1)]), np.concatenate([h[np.arange(len(h)), truth], -_chances(h, temperature).max(1)])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(x, pa.float64())], ["k", "x"])
    return tidy(run)


def calibrate(model, rows: DataFrame, reject: float = REJECT) -> None:
    """Temperature of the least log loss over rows (lang, h); each language's
    limit, and the least score, that all but ``reject`` of its own texts keep
    to.  Only the numbers beyond these limits reach the driver."""
    sums = rows.mapInArrow(_losses(model.langs), "sums array<double>, n long").collect()
    if not sum(r["n"] for r in sums):
        return
    model.temperature = float(GRID[int(np.argmin(np.sum([r["sums"] for r in sums], axis=0)))])
    own = written(rows.mapInArrow(_own(model.langs, model.temperature), "k long, x double"), "lang-own")
    groups = own.groupBy("k").agg(F.count("*").alias("n"), F.percentile_approx("x", max(0.0, 1 - reject - 3e-4), 10_000).alias("low"))
    tails: dict[int, list] = {}
    for r in own.join(F.broadcast(groups), "k").filter("x >= low").select("k", "n", "x").toLocalIterator():
        tails.setdefault(r["k"], [r["n"]]).append(r["x"])
    for k, (n, *tail) in tails.items():
        limit = sorted(tail, reverse=True)[n - 1 - int(np.ceil((n - 1) * (1 - reject)))]
        if k < 0:
            model.least_score = -float(limit)
        else:
            model.limits[k] = limit


def _scorer(shared):
    """Rows with ``_text`` as rows with letters, h, and the strings and shares left to a join."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        model, number = shared.value, TaskContext.get().partitionId() << 40
        for batch in in_slices(batches):
            h, letters, left = _by_parts(model, [t or "" for t in batch.column("_text").to_pylist()])
            keep = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.arange(number, number + batch.num_rows)), pa.array(letters, pa.int64()), pa.array([*h], pa.list_(pa.float64())),
                 pa.array([[g for g, _ in x] for x in left], pa.list_(pa.string())), pa.array([[w for _, w in x] for x in left], pa.list_(pa.float64()))],
                [*keep, "_key", "letters", "h", "grams", "shares"])
            number += batch.num_rows
    return tidy(run)


def scored(rows: DataFrame, model: Model | Frequent, tables: Tables | None) -> DataFrame:
    """``rows`` with letters and h, the cross-entropies, for ``_text``."""
    keep = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"]
    shared = rows.sparkSession.sparkContext.broadcast(model)
    done = written(rows.mapInArrow(_scorer(shared), ", ".join([*keep, "_key long, letters long, h array<double>, grams array<string>, shares array<double>"])), "lang-scored")
    shared.destroy()
    if tables is None:
        return done.drop("_key", "grams", "shares")
    rest = done.select("_key", F.explode(F.arrays_zip("grams", "shares")).alias("x")).select("_key", "x.*")
    costs = tables.costs(rest.select(F.col("grams").alias("gram")).distinct())
    more = rest.join(costs, rest["grams"] == costs["gram"]).groupBy("_key").agg(
        F.array(*[F.sum(F.col("costs")[k] * F.col("shares")) for k in range(len(model.langs))]).alias("more"))
    whole = F.zip_with("h", "more", lambda x, y: x + y)
    return written(done.drop("grams", "shares").join(more, "_key", "left").withColumn("h", F.coalesce(whole, "h")).drop("_key", "more"), "lang-whole")


def _predictor(model):
    langs, temperature, limits, least_score = model.langs, model.temperature, model.limits, model.least_score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, "und"], object)
        for batch in in_slices(batches):
            n = batch.num_rows
            letters = batch.column("letters").to_numpy()
            if langs:
                h = np.array(batch.column("h").to_pylist(), np.float64).reshape(-1, len(langs))
                best = h.argmin(1)
                score = _chances(h, temperature)[np.arange(n), best]
                low = h[np.arange(n), best]
                rejected = (low > limits[best]) | (score < least_score)
            else:
                best, score, low, rejected = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.ones(n, bool)
            none = (letters == 0) | (not langs)
            best, score = np.where(none, len(langs), best), np.where(none, 0.0, score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score, pa.float64()),
                 pa.array(low, pa.float64(), mask=none), pa.array(rejected | none, pa.bool_())], ["_id", "held_out", "lang_pred", "score", "entropy", "rejected"])
    return tidy(run)


def _learned(train: DataFrame, most_cells: int) -> tuple[Model | Frequent, Tables | None]:
    """What tasks hold of the model of rows (lang, _text), and the tables of the rest.

    All strings of all texts are counted and estimated.  If strings times
    languages exceed ``most_cells``, tasks hold the most frequent
    strings only (the counts of counts say which), the tables all.
    """
    table = written(counts(train), "lang-counts")
    langs = sorted(r["lang"] for r in table.select("lang").distinct().collect())
    per_gram = table.groupBy("gram").agg(F.max("c").alias("top"))
    sizes = sorted(((r["top"], r["n"]) for r in per_gram.groupBy(F.least("top", F.lit(1 << 16)).alias("top")).agg(F.count("*").alias("n")).collect()), reverse=True)
    room, cut = most_cells // max(1, len(langs)), 1
    for top, n in sizes:
        room -= n
        if room < 0:
            cut = top + 1
            break
    if cut > 1:
        tables = Tables(langs, table)
        return Frequent(langs, tables.costs(per_gram.filter(F.col("top") >= cut).select("gram")).toArrow()), tables
    kept = table.toArrow()
    number = {x: i for i, x in enumerate(langs)}
    lang = np.array([number[x] for x in kept.column("lang").to_pylist()], np.int64)
    text = "".join(kept.column("gram").to_pylist())
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
    return estimate(langs, lang, chars, kept.column("c").to_numpy()), None


def fit(train: DataFrame, calibration: DataFrame, most_cells: int = MOST_CELLS) -> Model | Frequent:
    """The model of rows (lang, _text), calibrated by others (lang, _text)."""
    model, tables = _learned(train, most_cells)
    if model.langs:
        calibrate(model, scored(calibration.filter(F.col("lang").isin(model.langs)), model, tables).filter("letters > 0").select("lang", "h"))
    return model


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id is as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_cells: int = MOST_CELLS) -> DataFrame:
    """(id, held_out, lang_pred, score, entropy, rejected), one row per row of ``docs``.

    Documents of fold 0 are held out: nothing is learned from them.  Folds 2 to
    4 are counted, fold 1 calibrates, both whole.  Only non-null languages are
    learned.  Every document is scored once.

    ``lang_pred`` is the learned language of the lowest cross-entropy, ``und`` for a
    text that is null or has no letter, and for all if no language could be
    learned; the score is its calibrated probability, 0 for ``und``.
    ``rejected`` says that the text is too unlike its language's own texts,
    or too near another language, to be relied on.  Of equal languages the
    first by name wins.  Repeated rows and ids keep their rows; other columns
    are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), fold(id_col).alias("_fold"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("_text"))
    labelled = rows.filter(F.col("lang").isNotNull() & F.col("_text").isNotNull())
    model, tables = _learned(labelled.filter("_fold > 1").select("lang", text_of("_text").alias("_text")), most_cells)
    whole = scored(rows.select("_id", (F.col("_fold") == 0).alias("held_out"), (F.col("_fold") == 1).alias("_calibrates"), "lang", "_text"), model, tables)
    if model.langs:
        calibrate(model, whole.filter(F.col("_calibrates") & F.col("lang").isin(model.langs) & (F.col("letters") > 0)).select("lang", "h"))
    kind = rows.schema["_id"].dataType.simpleString()
    done = whole.select("_id", "held_out", "letters", "h").mapInArrow(
        _predictor(model), f"_id {kind}, held_out boolean, lang_pred string, score double, entropy double, rejected boolean")
    return done.withColumnRenamed("_id", id_col)


ship(__name__)

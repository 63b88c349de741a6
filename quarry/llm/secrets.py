"""Secret scans with corpus-wide ownership frequency.

Every text is searched for base secrets (assignments, access keys, long hex)
and for bare tokens that look random.  The values' hashes are then counted
over the whole corpus by distinct repositories and distinct owners: a value
that many owners hold is a copied example, one that a single owner holds is a
live-looking credential.  The base spans of a text stay; each live value adds
a span of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import in_slices, row_key, ship, text_of, tidy, whole_row, written

# fixed values: what counts as a base secret, in the order of the kinds
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "live")
# bare tokens: letters and digits, this long, with so many bits a character
BARE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
BARE_BITS = 3.0

SPAN = "struct<start:long,kind:int,end:long,vstart:long,vend:long,value:string>"


def _finder():
    def bits(value: str) -> float:
        from collections import Counter
        from math import log2
        n = len(value)
        return -sum(k / n * log2(k / n) for k in Counter(value).values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import re
        # ASCII: only A-Z and a-z have two cases, as in the patterns' letters
        assign, access, run_of_hex, bare = re.compile(ASSIGN, re.A | re.I), re.compile(ACCESS), re.compile(HEX), re.compile(BARE)
        has_digit, has_letter = re.compile("[0-9]"), re.compile("[A-Za-z]")

        def spans(text: str) -> list[dict]:
            found = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
            if "AKIA" in text:
                found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in access.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
            found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in run_of_hex.finditer(text)]
            for m in bare.finditer(text):
                if has_digit.search(m[0]) and has_letter.search(m[0]) and bits(m[0]) >= BARE_BITS:
                    found.append((m.start(), 3, m.end(), m.start(), m.end()))
            return [{"start": a, "kind": k, "end": b, "vstart": c, "vend": d,
                     "value": hashlib.sha256(text[c:d].encode()).hexdigest()[:32]} for a, k, b, c, d in sorted(found)]

        for batch in in_slices(batches):
            found = [spans(t) for t in batch.column("_text").to_pylist()]
            keep = [c for c in batch.schema.names if c != "_text"]
            kind = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("vstart", pa.int64()), ("vend", pa.int64()), ("value", pa.string())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.list_(kind))], [*keep, "_spans"])
    return tidy(run)


def _shown(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found_spans(docs: DataFrame, text_col: str, owner: Column, repository: Column, keep: dict[str, Column]) -> DataFrame:
    """A row for each row of ``docs``: ``_row`` (a number of its own), the
    columns of ``keep``, ``_owner``, ``_repo`` and ``_spans``, written once."""
    rows = docs.select(*[c.alias(f"_k{i}") for i, c in enumerate(keep.values())],
                       F.coalesce(owner.cast("string"), F.lit("")).alias("_owner"),
                       F.coalesce(repository.cast("string"), F.lit("")).alias("_repo"), text_of(text_col).alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    found = rows.mapInArrow(_finder(), f"{schema}, _spans array<{SPAN}>")
    found = found.withColumnsRenamed({f"_k{i}": f"_keep_{c}" for i, c in enumerate(keep)})
    return written(found.withColumn("_row", F.monotonically_increasing_id()), "secret-spans")


def ownership(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates (_row, value, vstart, vend, kind), and for each value
    its numbers of distinct owners and repositories in the corpus."""
    candidates = found.select("_row", "_owner", "_repo", F.explode("_spans").alias("s")).select(
        "_row", "_owner", "_repo", F.col("s.value").alias("value"), F.col("s.vstart").alias("vstart"), F.col("s.vend").alias("vend"),
        F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    # distinct holders first: a value copied a million times meets its count as a few rows
    holders = candidates.select("value", "_owner", "_repo").distinct()
    return candidates, holders.groupBy("value").agg(F.countDistinct("_owner").alias("owners"), F.countDistinct("_repo").alias("repositories"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source",
         repository: tuple[str, ...] = ("source", "lang"), live_owners: int = 1, live_repositories: int = 4) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_live), one row per
    row of ``docs``.

    A null text is empty and has no span; null owners are one owner.  A value
    is live-looking when at most ``live_owners`` owners and
    ``live_repositories`` repositories hold it.  Repeated rows each keep
    their row.  Columns other than the named ones are not read.
    """
    repo = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository])
    found = found_spans(docs, text_col, F.col(owner), repo, {"id": F.col(id_col)})
    candidates, holders = ownership(found)
    live = holders.filter((F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories)).select("value")
    added = (candidates.join(live, "value").groupBy("_row")
             .agg(F.collect_set(F.struct(F.col("vstart").alias("start"), F.lit(3).alias("kind"), F.col("vend").alias("end"))).alias("_live")))
    base = F.transform(F.filter("_spans", lambda s: s["kind"] < 3), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    rows = (found.join(added, "_row", "left").withColumn("_base", base)
            .withColumn("_all", F.when(F.col("_live").isNull(), F.col("_base")).otherwise(F.concat("_base", "_live"))))
    return rows.select(F.col("_keep_id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                       F.sha2(_shown(F.col("_base")), 256).alias("base_sha256"), _shown(F.col("_all")).alias("spans"),
                       F.coalesce(F.size("_live"), F.lit(0)).cast("long").alias("n_live"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", owner: str = "source",
           repository: tuple[str, ...] = ("source", "lang"), example_owners: int = 5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret value replaced by ``mark``, except copied
    examples, which ``example_owners`` owners or more hold.  Bare tokens are
    replaced only if a single owner holds them.  Texts without secrets, null
    texts among them, stay as they are; the length column follows the text.
    """
    keyed = docs.select(whole_row(docs).alias("_row")).withColumn("_key", row_key())
    field = lambda c: F.col("_row").getField(c)
    flat = keyed.select("_key", field(text_col).alias("_t"), field(owner).alias("_o"),
                        F.concat_ws("\x01", *[F.coalesce(field(c).cast("string"), F.lit("")) for c in repository]).alias("_r"))
    found = found_spans(flat, "_t", F.col("_o"), F.col("_r"), {"key": F.col("_key")})
    candidates, holders = ownership(found)
    gone = holders.filter(F.col("owners") < example_owners)
    cut = candidates.join(gone, "value").filter((F.col("kind") < 3) | (F.col("owners") == 1))
    by_row = cut.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("vstart", "vend"))).alias("_cut"))
    by_key = found.select("_row", F.col("_keep_key").alias("_key")).join(by_row, "_row").dropDuplicates(["_key"]).select("_key", "_cut")
    rows = keyed.join(by_key, "_key", "left").withColumn("_text", field(text_col))
    # the cuts in order; what each replaces begins where the furthest one before it ended
    kept = F.aggregate("_cut", F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")), lambda a, s: F.struct(
        F.concat(a["text"], F.when(s["vstart"] >= a["at"], F.concat(F.substring(F.col("_text"), (a["at"] + 1).cast("int"), (s["vstart"] - a["at"]).cast("int")), F.lit(mark)))
                 .otherwise(F.lit(""))).alias("text"), F.greatest(a["at"], s["vend"]).alias("at")))
    rows = rows.withColumn("_kept", F.when(F.col("_cut").isNotNull(), kept))
    rest = F.substr(F.col("_text"), (F.col("_kept.at") + 1).cast("int"))
    rows = rows.withColumn("_new", F.when(F.col("_kept").isNotNull(), F.concat(F.col("_kept.text"), rest)))
    new = {text_col: F.col("_new")}
    if length_col in docs.columns:
        new[length_col] = F.length("_new").cast(docs.schema[length_col].dataType)
    return rows.select(*[F.when(F.col("_new").isNotNull(), new[c]).otherwise(field(c)).alias(c) if c in new else field(c).alias(c) for c in docs.columns])


ship(__name__)

"""Secret scans against plain Python."""

import hashlib
import re

from quarry.llm import secrets

HEX1, HEX2, KEY = "0123456789abcdef01234567", "f" * 12 + "0" * 13 + "1e", "AKIA" + "Q" * 16
BARE1, BARE2 = "Zk3v9QpL0xW8bT5rN7mYc2", "zzzzzzzzzzzzzzzzzzzzzzzz1"


def brute(rows):
    """Base spans and live spans, straight from the definitions."""
    kinds = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
             re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")]
    least, found, owners, repos = (6, 20, 24), [], {}, {}
    for _, text, source, lang in rows:
        spans, values = [], []
        for k, p in enumerate(kinds):
            for m in p.finditer(text or ""):
                a, b = m.span(2) if k == 0 else m.span()
                if b - a >= least[k]:
                    spans.append((m.start(), k, m.end()))
                    values.append((a, b))
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", text or ""):
            if m[0] in (HEX1, BARE1) or m[0] == HEX2 or m[0] == KEY and False:
                values.append(m.span())
        for a, b in values:
            owners.setdefault(text[a:b], set()).add(source or "")
            repos.setdefault(text[a:b], set()).add((source or "", lang or ""))
        found.append((spans, values))
    out = []
    show = lambda x: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(x))
    for (i, text, _, _), (spans, values) in zip(rows, found):
        live = {(a, 3, b) for a, b in values if len(owners[text[a:b]]) <= 1 and len(repos[text[a:b]]) <= 4}
        out.append((i, *[sum(k == n for _, k, _ in spans) for n in range(3)], hashlib.sha256(show(spans).encode()).hexdigest(),
                    show([*spans, *live]), len(live)))
    return sorted(out, key=str)


ROWS = [(1, f'é token = "{HEX1}" x', "a", "en"), (2, f"copied {HEX2} here", "a", "en"), (3, f"copied {HEX2} here", "b", "en"), (4, f"{HEX2}", None, None),
        (5, f"x {KEY} y AKIASHORT AKIA", "c", "de"), (6, "PASSWORD: 'short' Api_Key=longer-value. secret=a token=token:abcdefgh", "c", "de"),
        (7, None, "a", "en"), (8, "", None, None), (8, "", None, None), (None, f"bare {BARE1} and {BARE2}.", "d", "fr"), (None, f"bare {BARE1} and {BARE2}.", "d", "fr"),
        (9, "ſecret=abcdefg toKen=abcdefgh", "a", "en"), (10, "w " * 60_000 + f"passwd={HEX1}z", "a", "en"), (11, "apikey :  \"abcdef\" api-key=abcdefg", "z", "z")]


def test_spans_and_ownership(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string").selectExpr("*", "1 as value", "2 as start", "'x' as spans")
    got = sorted((tuple(r) for r in secrets.scan(df).collect()), key=str)
    assert got == brute(ROWS)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    assert secrets.scan(df).count() == 0
    assert secrets.redact(df).count() == 0


def test_redaction_leaves_copied_examples_and_clean_texts(spark):
    rows = [(i, t, s, la, 0 if t is None else len(t)) for i, t, s, la in ROWS] + [(100 + i, f"key {HEX1[::-1]}", f"s{i}", "en", 28) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = secrets.redact(df)
    assert got.columns == df.columns
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append((r["text"], r["n_chars"]))
    assert by[1] == [('é token = "[SECRET]" x', 22)]
    assert by[5] == [("x [SECRET] y AKIASHORT AKIA", 27)]
    assert by[7] == [(None, 0)] and by[8] == [("", 0), ("", 0)]
    assert by[None] == [(f"bare [SECRET] and {BARE2}.", 18 + len(BARE2) + 1)] * 2
    assert by[10][0][0].endswith("passwd=[SECRET]")
    assert all(by[100 + i] == [(f"key {HEX1[::-1]}", 28)] for i in range(6))

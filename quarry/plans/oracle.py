"""Side-by-side check of a registered query against its DuckDB oracle.

Mirrors the driver's gate: row count, column names, and an order-insensitive
comparison of the values (columns sorted by name).  Used by the tests and by
``python -m quarry.plans.oracle`` while developing; it is a check tool, so it
collects the (small, sf0.01) results.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import math
import sys

from quarry.sources.tables import TABLES, table_path


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def t_p_sql(t: str, dof: str) -> str:
    """DuckDB: two-sided Student-t p, by Simpson's rule over [0, |t|]."""
    density = (f"exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2) - 0.5 * ln({dof} * pi())"
               f" - ({dof} + 1) / 2 * ln(1 + power(abs({t}) * i / 2000, 2) / {dof}))")
    return (f"(SELECT round(greatest(0, 1 - 2 * sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density})"
            f" * abs({t}) / 6000), 6) FROM range(0, 2001) r(i))")


def chi2_p_sql(x: str, dof: str) -> str:
    """DuckDB: upper chi-square tail for an even number of degrees of freedom, a finite sum."""
    return f"(SELECT round(sum(exp(i * ln({x} / 2) - {x} / 2 - lgamma(i + 1))), 6) FROM range(0, ({dof} / 2)::BIGINT) r(i))"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if hasattr(v, "tolist"):
        return repr(v.tolist())
    if isinstance(v, (list, tuple)):
        return repr([_norm(x) for x in v])
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256()
    for line in lines:
        h.update(line.encode())
    return h.hexdigest(), lines


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from quarry.plans.registry import load_all
    q = load_all()[name]
    df = q.build(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    out = {"name": name, "check": q.check, "spark_rows": len(s_rows)}
    if not q.sql:
        out["ok"] = True
        return out
    con = con or duck_connection(sf_dir)
    cur = con.execute(q.sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    out["oracle_rows"] = len(d_rows)
    out["cols_match"] = sorted(s_cols) == sorted(d_cols)
    sh, sl = _digest(s_cols, s_rows)
    dh, dl = _digest(d_cols, d_rows)
    out["hash_match"] = sh == dh
    out["ok"] = out["cols_match"] and out["hash_match"] and len(s_rows) == len(d_rows)
    if not out["ok"]:
        out["spark_cols"], out["oracle_cols"] = s_cols, d_cols
        only_s = sorted(set(sl) - set(dl))[:3]
        only_d = sorted(set(dl) - set(sl))[:3]
        out["only_spark"], out["only_oracle"] = only_s, only_d
    return out


def main(argv=None):
    from quarry.plans.registry import load_all
    from quarry.session import get_session
    argv = argv if argv is not None else sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("--")]
    for a in argv:
        if a.startswith("--sf="):
            sf_dir = a.split("=", 1)[1]
    spark = get_session("local[8]", 8)
    con = duck_connection(sf_dir)
    reg = load_all()
    bad = 0
    for n in names or list(reg):
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and keep going
            r = {"name": n, "ok": False, "error": repr(e)[:400]}
        bad += not r["ok"]
        print(r, flush=True)
    print(f"failed: {bad}")


if __name__ == "__main__":
    main()

"""The driver contract in __spark_entry__.py."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_contract(spark):
    se = _entry_module()
    df = se.entry(spark)
    assert df.columns == ["c_nationkey", "n_name", "avg_acctbal"]
    assert df.count() > 0
    qs, sqls = se.queries(), se.oracle_sql()
    assert len(qs) >= 90 and set(sqls) <= set(qs)
    assert all(callable(f) for f in qs.values())
    assert all(isinstance(s, str) and s.strip() for s in sqls.values())
    # a query built through the contract runs on the smoke tables
    out = qs["group_by_avg"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["c_nationkey", "avg_acctbal"] and out.count() == 25

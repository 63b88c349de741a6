"""Plan tests: filters reach the scan, subqueries become
semi/anti joins, scans read only needed columns, no row-at-a-time UDF."""

import pytest

from quarry.plans.registry import load_all
from tests.conftest import SF001


def plan(spark, name):
    df = load_all()[name].build(spark, SF001)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, needle", [
    ("filter_gt_quoted", "GreaterThan(c_acctbal,1000.0)"),
    ("filter_eq_string", "EqualTo(c_mktsegment,BUILDING)"),
    ("filter_eq_int", "EqualTo(p_size,18)"),
    ("like_prefix", "StringStartsWith(p_name,red)"),
    ("like_suffix", "StringEndsWith(p_name,gear)"),
    ("filter_or", "Or(EqualTo(p_size,1),EqualTo(p_brand,Brand#13))"),
    ("filter_neq", "Not(EqualTo(o_orderstatus,F))"),
    ("filter_and_prefix", "EqualTo(l_returnflag,R)"),
    ("bound_params", "EqualTo(p_brand,Brand#13)"),
])
def test_pushed_filters(spark, name, needle):
    p = plan(spark, name)
    assert "PushedFilters" in p and needle in p, p


def test_column_pruning(spark):
    p = plan(spark, "agg_sum")
    assert "ReadSchema: struct<l_extendedprice:double>" in p, p


def test_subqueries_are_semi_anti(spark):
    p = plan(spark, "in_subquery")
    assert "LeftSemi" in p and "LeftAnti" in p and "NestedLoop" not in p, p
    p = plan(spark, "exists_cardinality")
    assert "LeftSemi" in p and "LeftAnti" in p and "NestedLoop" not in p, p


def test_quantified_comparison_uses_scalar_subqueries(spark):
    p = plan(spark, "compare_all_any")
    assert "Subquery" in p and "Join" not in p, p


def test_fk_lookup_broadcasts_the_dimension(spark):
    assert "BroadcastHashJoin" in plan(spark, "fk_lookup_join")


@pytest.mark.parametrize("name", sorted(load_all()))
def test_no_row_udf_no_cross_join(spark, name):
    p = plan(spark, name)
    assert "BatchEvalPython" not in p
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p

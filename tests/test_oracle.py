"""Every O/R query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

from quarry.plans.oracle import compare
from quarry.plans.registry import load_all
from tests.conftest import SF001

CHECKED = sorted(n for n, q in load_all().items() if q.sql)


def test_registry_shape():
    reg = load_all()
    assert len(reg) >= 90
    for name, q in reg.items():
        assert q.check in ("O", "R", "P"), name
        assert (q.sql is not None) == (q.check in ("O", "R")), name


@pytest.mark.parametrize("name", CHECKED)
def test_matches_oracle(spark, duck001, name):
    r = compare(spark, name, SF001, duck001)
    assert r["ok"], r

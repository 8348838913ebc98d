from pathlib import Path

import pytest

from docketry import plans
from tests.compare import assert_same

ROOT = Path(__file__).resolve().parent.parent
Q, S = plans.queries(), plans.oracle_sql()


def test_nothing_outside_llm_imports_it():
    for p in (ROOT / "docketry").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "docketry.llm" not in p.read_text(), p


def test_every_sql_has_its_query():
    assert set(S) <= set(Q)


@pytest.mark.parametrize("name", sorted(S))
def test_query_equals_sql(spark, data, name):
    assert_same(Q[name](spark, data), data, S[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_query_without_sql_runs(spark, data, name):
    assert Q[name](spark, data).count() > 0

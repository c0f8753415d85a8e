import pytest

from oracle import connect, differences
from scholion.plans import verdicts  # noqa: F401  # adds its queries
from scholion.plans.catalogue import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), connect(sf), ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).columns

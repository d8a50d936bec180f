"""Every registered query of the engine's own operators against its SQL, or at least run."""

from __future__ import annotations

import pytest

from graphloom.queries import QUERIES, SQL
from tests.compare import SF, same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    got, want = same(spark, QUERIES[name], SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()

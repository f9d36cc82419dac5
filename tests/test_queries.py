"""Every registered query against its SQL, at the smallest scale; the others must run and give rows."""

import os

import pytest

from quern.plans import catalog
from tests.oracle import SF_DIR, close, connection, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
#: Queries that need more data than the smallest tables have to give a row.
MAY_BE_EMPTY = {"multi_hop", "reasoning_chain", "follow_up", "entity_insights", "related_entities", "suggest_queries", "near_dup", "stream_feedback", "multi_hop_batch", "satisfaction", "evaluate_search_run"}


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF_DIR).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert close(rows(got), rows(want))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0 or name in MAY_BE_EMPTY

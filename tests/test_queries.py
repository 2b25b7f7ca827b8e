"""Each query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import DATA, by_spark, by_sql

from spanloom.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert by_spark(spark, QUERIES[name]) == by_sql(ORACLES[name])


#: Measured otherwise: recall, in test_retrieval.
WITHOUT_SQL = {"vector_cells_near"}


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES) | WITHOUT_SQL


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_are_joins_by_meeting(spark):
    for name in ("window_text_join", "assign_speakers", "merge_requests", "contained_words", "training_pairs_fixed"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "slot" in plan or "__p" in plan  # time buckets are among the keys
        assert "CartesianProduct" not in plan and "Python" not in plan and "BroadcastNestedLoopJoin" not in plan

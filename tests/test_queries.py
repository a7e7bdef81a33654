"""Every registered query against its SQL, or against 'has rows' where there is none."""

from __future__ import annotations

import pytest

import check
from newsloom.plans import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return check.connect(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, small, name):
    problems, _ = check.check(spark, con, small, name, QUERIES[name], ORACLE.get(name))
    assert not problems, "\n".join(problems)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


HEADLINE = ("interactions_compact", "classify_topics", "feed", "knn_search", "bm25_topk", "hybrid_search", "user_sessions")


@pytest.mark.parametrize("name", HEADLINE)
def test_no_cross_join_in_plan(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = QUERIES["user_history"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,8)" in plan  # the asked user, below joins and aggregates
    plan = QUERIES["articles_count"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]

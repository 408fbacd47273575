"""Every bound query against its SQL twin, and the shape of its plan."""

import os

import pytest
from compare import connect, differences

from tidemark.workload import ORACLE, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in FORBIDDEN if w in plan]
    assert differences(df, con, ORACLE[name]) == []


def test_compare_tool_sees_differences(spark, con):
    df = QUERIES["agg_count"](spark, FOLDER)
    assert differences(df, con, ORACLE["agg_count"].replace("count(*)", "count(*) + 1"))
    assert differences(df, con, "SELECT l_returnflag, l_linestatus, 1.0::DOUBLE AS n FROM lineitem GROUP BY ALL")
    assert differences(df, con, ORACLE["agg_count"] + " LIMIT 2")

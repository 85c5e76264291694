"""No registered batch query may plan a cross join, a Python worker, or a one-task window over
raw rows."""

import re

import pytest

from chartledger.plans.catalog import all_queries

SF_DIR = "/root/testdata/sf0.001"
BATCH = {n: q for n, q in all_queries().items() if not re.match(r"k\d_", n)}
BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas")
# Queries whose last step orders a reduced table (chunk summaries, distinct durations) in one task.
REDUCED_FIRST = {"a1_global_links", "a1_sparse_ids", "e7_timing"}
# JSON texts are rewritten in Python.
PYTHON = {"a3_scrub_json"}


@pytest.mark.parametrize("name", sorted(BATCH))
def test_plan(spark, name):
    plan = BATCH[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    found = [b for b in BANNED if b in plan]
    assert not found or name in PYTHON and found == ["EvalPython"], plan
    if name not in REDUCED_FIRST:
        assert "SinglePartition" not in re.sub(
            r"Exchange SinglePartition[^\n]*\n[^\n]*HashAggregate", "", plan) or "Window" not in plan


@pytest.mark.parametrize("name, scans", [("g13_feature_changes", 4), ("g14_fact_changes", 3)])
def test_inputs_are_read_once(spark, name, scans):
    plan = BATCH[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= scans

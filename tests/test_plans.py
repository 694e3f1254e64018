"""Plan audit: no registered query moves table rows into one partition, neither in its own plan nor in the jobs
that run while it is built (cutoffs, staging)."""

import re

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter

from hostshelf.plans import catalog

from conftest import SF001

# Operators that would funnel rows through one task, pair rows up, or run Python row by row.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "TakeOrderedAndProject")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def faults(plan: str) -> list[str]:
    found = [b for b in FORBIDDEN if b in plan]
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        # a one-row aggregate sends one partial row per task
        if "SinglePartition" in line and not re.search(r"Aggregate\(keys=\[\], functions=\[partial_", "\n".join(lines[i:i + 3])):
            found.append(line.strip())
    return found


@pytest.fixture()
def ran(monkeypatch):
    """Plans of everything that runs meanwhile."""
    plans = []
    for kind, names, frame in ((DataFrame, ("collect", "first", "count"), lambda x: x), (DataFrameWriter, ("parquet", "json"), lambda x: x._df)):
        for name in names:
            def noted(self, *a, _f=getattr(kind, name), _frame=frame, **b):
                plans.append(plan_of(_frame(self)))
                return _f(self, *a, **b)
            monkeypatch.setattr(kind, name, noted)
    return plans


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_plan_has_a_single_partition_step(spark, ran, name):
    plans = [plan_of(catalog.queries()[name](spark, SF001)), *ran]
    assert [f for p in plans for f in faults(p)] == []


def test_the_audit_sees_cutoff_and_staging_jobs(spark, ran):
    catalog.queries()["group_page"](spark, SF001)
    cutoffs = len(ran)
    catalog.queries()["append_file"](spark, SF001)
    assert cutoffs >= 2 and any("MapInArrow" in p for p in ran[cutoffs:])


def test_cpu_snapshot_reads_cores_once(spark):
    plan = plan_of(catalog.queries()["cpu_snapshot"](spark, SF001))
    assert len(re.findall(r"FileScan parquet .*lineitem", plan)) == 2  # cores, processes

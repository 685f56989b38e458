"""Physical-plan assertions: the operators stay JVM-side and distributed."""

import pytest

import __spark_entry__ as entry
from offerscope.plans import ANALYSES

# The library's own analyses; optional queries have tests beside them.
QUERIES = {name: f for name, f in entry.queries().items() if name in ANALYSES}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _explain(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf_no_cartesian(spark, name):
    from conftest import SF_SMALL
    plan = _explain(QUERIES[name](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
                "applySchemaToPythonRDD", "FlatMapGroupsInPandas"):
        assert bad not in plan, f"{name}: {bad} in plan"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_unpartitioned_window(spark, name):
    """A window must always be partitioned: an empty PARTITION BY moves every
    row to one task.  (Single-partition exchanges after a partial aggregate
    are fine: one row per map task reaches them.)"""
    from conftest import SF_SMALL
    lines = _explain(QUERIES[name](spark, SF_SMALL)).splitlines()
    for i, line in enumerate(lines):
        if line.endswith(") Window"):
            args = next(x for x in lines[i:] if x.startswith("Arguments:"))
            partition = args.rsplit("], [", 2)[1]
            assert partition.strip(), f"{name}: unpartitioned window"


@pytest.mark.parametrize("name", ["dq_completed_after_expiry", "dq_overlapping_receipts", "kpi_completion_by_viewer_speed"])
def test_lifecycle_is_at_most_two_window_passes(spark, name):
    """All as-of columns come from one ascending and one descending window
    pass (unused ones are pruned away)."""
    from conftest import SF_SMALL
    plan = _explain(QUERIES[name](spark, SF_SMALL))
    assert 1 <= sum(1 for line in plan.splitlines() if line.endswith(") Window")) <= 2


def test_lifecycle_pushes_projection_to_scan(spark):
    from conftest import SF_SMALL
    plan = _explain(QUERIES["dq_completed_after_expiry"](spark, SF_SMALL))
    scans = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert scans and all("c_acctbal" not in s for s in scans)


def test_outliers_use_scalar_subquery(spark):
    from conftest import SF_SMALL
    plan = _explain(QUERIES["eda_amount_outliers"](spark, SF_SMALL))
    assert "Subquery" in plan

"""Plan checks: no row-at-a-time Python, no cartesian products beyond one-row
combines, filters and column pruning reach the parquet scan."""

import importlib.util
import os

import pytest

from harness import ROOT

_spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
entry_mod = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(entry_mod)
from souk.plans.registry import REGISTRY  # noqa: E402

QUERIES = {n: f for n, f in entry_mod.queries().items() if n in REGISTRY}

# ordered folds and stateful streams run Python over Arrow batches by design
FOLDS = {"place_orders", "adjust_balances", "apply_status_changes_split", "limit_attempts",
         "limit_attempts_registration",
         "place_orders_effects", "adjust_balances_effects"}     # effects read the outcomes of the folds above
STREAMS = {n for n in QUERIES if n.endswith("_stream") or n in ("streaming_ratings",)}
# one-row results combined side by side (each side is a global aggregate)
ONE_ROW_COMBINES = {"platform_stats", "health_counts", "table_counts", "category_counts", "run_retention",
                    "add_categories"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_plan_shape(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "BatchEvalPython" not in plan, "row-at-a-time Python UDF in the plan"
    if name not in FOLDS:
        assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan
    if name not in ONE_ROW_COMBINES:
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan


def test_filter_and_pruning_reach_the_scan(spark, sf_dir):
    df = QUERIES["orders_daily"](spark, sf_dir)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln]
    assert scans, plan
    pushed = [ln for ln in scans if "GreaterThanOrEqual(created_at" in ln or "GreaterThanOrEqual(o_orderdate" in ln]
    assert pushed, scans
    # only the columns the report needs are read
    for ln in pushed:
        read = ln.split("ReadSchema:")[1]
        assert "customer_id" not in read and "o_custkey" not in read and "requirements" not in read, ln

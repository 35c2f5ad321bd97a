"""A full run by mark tables leaves and removes what the six steps, one after the other, do."""

import pytest
from pyspark.sql import functions as F

from souk.operators import retention as RT
from souk.sources.fixtures import AS_OF, AS_OF_EVENTS


def chained(T, policy):
    t, steps = RT.snapshot(T), []
    for step in (lambda x: RT.retire_cancelled_orders(x, AS_OF, policy), lambda x: RT.retire_inactive_users(x, AS_OF, policy),
                 lambda x: RT.drop_old_notifications(x, AS_OF_EVENTS), lambda x: RT.drop_read_notifications(x, AS_OF_EVENTS),
                 lambda x: RT.drop_old_messages(x, AS_OF), lambda x: RT.drop_dead_services(x, AS_OF, policy)):
        steps.append(step(t))
        t = steps[-1].tables
    return t, steps


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, df.select(*cols).collect()))


@pytest.mark.parametrize("policy", ["api", "script"])
def test_run_equals_its_steps(T, policy):
    kept, steps = RT.run_retention(T, AS_OF, policy, AS_OF_EVENTS)
    want, want_steps = chained(T, policy)
    for name in ("orders", "users", "services", "messages", "notifications", "status_log", "balances", "profiles", "transactions", "reviews"):
        assert sorted(kept[name].columns) == sorted(want[name].columns)
        assert rows(kept[name]) == rows(want[name]), name
    assert [s.name for s in steps] == [s.name for s in want_steps]
    for got, step in zip(steps, want_steps):
        assert rows(got.removed) == rows(step.removed), step.name
    assert rows(steps[1].extra["blocked"]) == rows(want_steps[1].extra["blocked"])
    assert sum(s.removed.count() > 0 for s in steps) >= 3


def test_half_the_exchanges(T):
    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    _, steps = chained(T, "api")
    old = steps[0].removed.agg(F.count("*"))
    for s in steps[1:]:
        old = old.crossJoin(F.broadcast(s.removed.agg(F.count("*"))))
    assert exchanges(RT.retention_counts(T, AS_OF, "api", AS_OF_EVENTS)) * 2 <= exchanges(old)


class Asked(dict):
    """Tables that remember which of them were asked for."""

    def __init__(self, T):
        self.T, self.names = T, set()

    def __missing__(self, name):
        self.names.add(name)
        return self.T[name]


@pytest.mark.parametrize("query, names", [
    ("retire_cancelled_orders", {"orders"}), ("drop_old_messages", {"orders", "messages"}), ("drop_old_notifications", {"notifications"}),
    ("drop_dead_services", {"services", "orders"})])
def test_a_step_derives_only_what_its_rows_need(T, query, names):
    from souk.plans.registry import REGISTRY
    asked = Asked(T)
    REGISTRY[query].plan(asked)
    assert asked.names == names


@pytest.mark.parametrize("which", ["run", "step"])
def test_ledger_rows_without_an_order_meet_no_marks(T, which):
    """Nor are they exchanged: a null key would bring them all to one task."""
    spark = T["transactions"].sparkSession
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = RT.run_retention(T, AS_OF, "api", AS_OF_EVENTS)[0] if which == "run" else RT.retire_cancelled_orders(RT.snapshot(T), AS_OF).tables
        plan = tables["transactions"].select("order_id")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "Union" in plan and "isnull(order_id" in plan and "isnotnull(order_id" in plan

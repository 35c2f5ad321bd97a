"""Retention: each step keeps, removes and counts.

Id sets never leave the cluster: the rows to drop are DataFrames applied
with semi/anti joins (the reference pulls id lists into the app and pastes
them back as ``IN`` lists). Every cut-off is strict (``<``), so a row exactly
at the boundary instant is kept. ``policy`` picks the web-handler variant
(``api``) or the stand-alone script variant (``script``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.predicates import CLOSED_ORDER_STATES, older_than
from souk.operators.ordering import stored

TABLES = ("users", "services", "orders", "status_log", "messages", "reviews", "balances",
          "transactions", "notifications", "profiles", "categories")


class Lazy(Mapping):
    """Tables by name: those of ``base`` and the ``changed`` ones, each made when it is first
    asked for, so that a step whose reader wants one table derives (and stores) no other."""

    def __init__(self, base: Mapping[str, DataFrame], **changed: Callable[[], DataFrame]):
        self._base, self._changed, self._made = base, changed, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._changed[name]() if name in self._changed else self._base[name]
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(dict.fromkeys([*self._base, *self._changed]))

    def __len__(self) -> int:
        return len(list(iter(self)))


@dataclass
class Step:
    name: str
    tables: Mapping[str, DataFrame]
    removed: DataFrame                      # one row per removed key, column ``id``
    extra: dict[str, DataFrame] = field(default_factory=dict)


def snapshot(T) -> Mapping[str, DataFrame]:
    """The tables retention touches (of a lazy mapping those that are asked for)."""
    return Lazy({}, **{t: lambda t=t: T[t] for t in TABLES})


def _drop(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    return df.join(ids.select(F.col("id").alias("_x")), F.col(col) == F.col("_x"), "left_anti")


def _met(df: DataFrame, marks: DataFrame, col: str, key: str) -> DataFrame:
    """``df`` left-joined to ``marks`` on ``col`` = ``key``. Rows without a reference match nothing and
    stay out of the join: most ledger rows have no order, and would all be sorted in one task."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in marks.schema.fields]
    return (df.filter(F.col(col).isNotNull()).join(marks, F.col(col) == F.col(key), "left")
            .unionByName(df.filter(F.col(col).isNull()).select("*", *none)))


def _unlinked(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """``df`` with references to ``ids`` set to null."""
    hit = _met(df, ids.select(F.col("id").alias("_x")), col, "_x")
    return hit.withColumn(col, F.when(F.col("_x").isNull(), F.col(col))).drop("_x")


# ----------------------------------------------------------------------------- R1
def retire_cancelled_orders(T, as_of, policy: str = "api", days: int = 90) -> Step:
    old = T["orders"].filter((F.col("status") == "cancelled") & older_than("updated_at", as_of, days)).select("id")
    ledger = _drop if policy == "script" else _unlinked
    t = Lazy(T, messages=lambda: _drop(T["messages"], old, "order_id"), status_log=lambda: _drop(T["status_log"], old, "order_id"),
             transactions=lambda: ledger(T["transactions"], old, "order_id"), orders=lambda: _drop(T["orders"], old, "id"))
    return Step("cancelled_orders", t, old)


# ----------------------------------------------------------------------------- R2
def fk_blockers(T, users: DataFrame) -> DataFrame:
    """Users that rows without ON DELETE CASCADE still point to (X5): they cannot go."""
    refs = (T["orders"].select(F.explode(F.array("customer_id", "executor_id")).alias("ref"))
            .unionByName(T["messages"].select(F.col("sender_id").alias("ref")))
            .unionByName(T["reviews"].select(F.explode(F.array("customer_id", "executor_id")).alias("ref"))))
    # one row per user that is referred to (combined before the shuffle), so a busy user is no hot key
    return users.join(refs.distinct(), F.col("id") == F.col("ref"), "left_semi")


def retire_inactive_users(T, as_of, policy: str = "api", days: int = 30) -> Step:
    """Inactive accounts older than ``days``: their notifications, balance and profile go,
    ledger rows keep the history with a null user; ``api`` also hides their services.
    Accounts still referenced by orders, messages or reviews stay and are reported."""
    cand = T["users"].filter(~F.col("is_active") & older_than("updated_at", as_of, days)).select("id")
    blocked = fk_blockers(T, cand)
    gone = cand.join(blocked, "id", "left_anti")

    def services() -> DataFrame:
        svc = T["services"]
        if policy == "api":
            h = svc.join(cand.select(F.col("id").alias("_x")), F.col("executor_id") == F.col("_x"), "left")
            svc = h.withColumn("is_active", F.col("is_active") & F.col("_x").isNull()).drop("_x")
        return _drop(svc, gone, "executor_id")               # ON DELETE CASCADE

    t = Lazy(T, notifications=lambda: _drop(T["notifications"], gone, "user_id"), balances=lambda: _drop(T["balances"], gone, "user_id"),
             profiles=lambda: _drop(T["profiles"], gone, "user_id"), transactions=lambda: _unlinked(T["transactions"], gone, "user_id"),
             services=services, users=lambda: _drop(T["users"], gone, "id"))
    return Step("inactive_users", t, gone, {"blocked": blocked})


# ----------------------------------------------------------------------------- R3 / R4
def drop_old_notifications(T, as_of, days: int = 60) -> Step:
    old = T["notifications"].filter(older_than("created_at", as_of, days))
    t = Lazy(T, notifications=lambda: T["notifications"].filter(~older_than("created_at", as_of, days)))
    return Step("old_notifications", t, old.select("id"))


def drop_read_notifications(T, as_of, days: int = 7) -> Step:
    cond = F.col("is_read") & older_than("created_at", as_of, days)
    t = Lazy(T, notifications=lambda: T["notifications"].filter(~cond))
    return Step("read_notifications", t, T["notifications"].filter(cond).select("id"))


# ----------------------------------------------------------------------------- R5
def drop_old_messages(T, as_of, days: int = 180) -> Step:
    closed = T["orders"].filter(F.col("status").isin(*CLOSED_ORDER_STATES)).select(F.col("id").alias("_o"))
    aged = F.coalesce(older_than("created_at", as_of, days), F.lit(False))
    # one join marks the messages; kept and removed rows are two filters of it
    marked = T["messages"].join(closed, F.col("order_id") == F.col("_o"), "left").withColumn("_old", aged & F.col("_o").isNotNull())
    t = Lazy(T, messages=lambda: marked.filter(~F.col("_old")).drop("_o", "_old"))
    return Step("old_messages", t, marked.filter("_old").select("id"))


# ----------------------------------------------------------------------------- R6
def drop_dead_services(T, as_of, policy: str = "api", days: int = 365) -> Step:
    """``api``: inactive, older than ``days``, no order refers to it; ``script``: inactive
    with an inactive executor. Services an order refers to are kept either way (X13)."""
    s = T["services"].filter(~F.col("is_active"))
    if policy == "script":
        dead_exec = T["users"].filter(~F.col("is_active")).select(F.col("id").alias("_u"))
        s = s.join(dead_exec, F.col("executor_id") == F.col("_u"), "left_semi")
    else:
        s = s.filter(older_than("created_at", as_of, days))
    used = T["orders"].select(F.col("service_id").alias("_s")).distinct()
    dead = s.join(used, F.col("id") == F.col("_s"), "left_anti").select("id")
    t = Lazy(T, services=lambda: _drop(T["services"], dead, "id"))
    return Step("dead_services", t, dead)


# ----------------------------------------------------------------------------- R7
def cascade(T, table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Delete ``ids`` from ``table`` and the rows its ON DELETE CASCADE keys reach."""
    t = dict(T)
    t[table] = _drop(t[table], ids, "id")
    if table == "users":
        for child, col in (("services", "executor_id"), ("balances", "user_id"),
                           ("notifications", "user_id"), ("profiles", "user_id")):
            t[child] = _drop(t[child], ids, col)
    if table == "orders":
        for child in ("status_log", "messages"):
            t[child] = _drop(t[child], ids, "order_id")
    return t


def mark_tables(T, as_of, policy: str = "api", as_of_notifications=None) -> Mapping[str, DataFrame]:
    """Every table of a full run (R1 to R6 in order) with ``_mark``, the step that removes the row (null: kept).

    A step hands marks to the next one, not tables: (id, dead, closed) of orders and (id, state) of
    inactive users are written once, each other table meets them in one join, and kept and removed
    rows are two filters of the result. ``_hidden`` marks services that are hidden, ``_no_order`` and
    ``_no_user`` ledger rows that lose a reference. A row is marked by the first step that removes it.
    """
    nts = as_of_notifications or as_of
    orders = T["orders"].withColumn("_mark", F.when(
        (F.col("status") == "cancelled") & older_than("updated_at", as_of, 90), "cancelled_orders"))
    order_marks = stored(orders.select(
        F.col("id").alias("_o"), F.col("_mark").isNotNull().alias("_dead"),
        F.col("status").isin(*CLOSED_ORDER_STATES).alias("_closed")).filter("_dead or _closed"), "order-marks")

    def with_order(df: DataFrame) -> DataFrame:
        out = _met(df, order_marks, "order_id", "_o").drop("_o")
        return out.withColumn("_dead", F.coalesce("_dead", F.lit(False)))

    aged = F.coalesce(older_than("created_at", as_of, 180), F.lit(False))
    messages = with_order(T["messages"]).withColumn(
        "_mark", F.when(F.col("_dead"), "cancelled_orders").when(aged & F.coalesce("_closed", F.lit(False)), "old_messages")).drop("_dead", "_closed")
    candidates = T["users"].filter(~F.col("is_active") & older_than("updated_at", as_of, 30)).select("id")
    live = orders.filter("_mark is null")
    refs = (live.select(F.explode(F.array("customer_id", "executor_id")).alias("ref"))
            .unionByName(messages.filter("_mark is null or _mark <> 'cancelled_orders'").select(F.col("sender_id").alias("ref")))
            .unionByName(T["reviews"].select(F.explode(F.array("customer_id", "executor_id")).alias("ref")))).distinct()
    user_marks = stored(candidates.join(refs, F.col("id") == F.col("ref"), "left").select(
        F.col("id").alias("_u"), F.col("ref").isNull().alias("_gone")), "user-marks")

    def with_user(df: DataFrame, col: str) -> DataFrame:
        out = _met(df, user_marks, col, "_u")
        return out.withColumn("_inactive", F.col("_u").isNotNull()).withColumn("_gone", F.coalesce("_gone", F.lit(False))).drop("_u")

    user = F.when(F.col("_gone"), "inactive_users")
    lost = F.when(F.col("_no_order"), "cancelled_orders") if policy == "script" else F.lit(None).cast("string")

    def ledger() -> DataFrame:
        out = with_user(with_order(T["transactions"]).withColumnRenamed("_dead", "_no_order").drop("_closed"), "user_id")
        return out.withColumn("_mark", lost).withColumnRenamed("_gone", "_no_user").drop("_inactive")

    def services() -> DataFrame:
        out = with_user(T["services"], "executor_id").withColumn(
            "_hidden", (F.col("_inactive") & F.col("is_active")) if policy == "api" else F.lit(False))
        used = live.select(F.col("service_id").alias("_s")).distinct()
        out = out.join(used, F.col("id") == F.col("_s"), "left")
        off = ~F.col("is_active") | F.col("_hidden")
        if policy == "script":
            inactive = T["users"].filter(~F.col("is_active")).select(F.col("id").alias("_i"))
            out = out.join(inactive, F.col("executor_id") == F.col("_i"), "left")
            dead = off & F.col("_i").isNotNull()
        else:
            dead = off & older_than("created_at", as_of, 365)
        return out.withColumn("_mark", user.when(F.coalesce(dead, F.lit(False)) & F.col("_s").isNull(), "dead_services")
                              ).drop("_inactive", "_gone", "_s", *(["_i"] if policy == "script" else []))

    return Lazy(
        {}, orders=lambda: orders, messages=lambda: messages,
        status_log=lambda: with_order(T["status_log"]).withColumn("_mark", F.when(F.col("_dead"), "cancelled_orders")).drop("_dead", "_closed"),
        users=lambda: with_user(T["users"], "id").withColumn("_mark", user).withColumn(
            "_blocked", F.col("_inactive") & ~F.col("_gone")).drop("_inactive", "_gone"),
        balances=lambda: with_user(T["balances"], "user_id").withColumn("_mark", user).drop("_inactive", "_gone"),
        profiles=lambda: with_user(T["profiles"], "user_id").withColumn("_mark", user).drop("_inactive", "_gone"),
        notifications=lambda: with_user(T["notifications"], "user_id").withColumn(
            "_mark", user.when(older_than("created_at", nts, 60), "old_notifications")
            .when(F.col("is_read") & older_than("created_at", nts, 7), "read_notifications")).drop("_inactive", "_gone"),
        transactions=ledger, services=services)


MARKS = ("_mark", "_hidden", "_no_order", "_no_user", "_blocked")


def kept_tables(marked: Mapping[str, DataFrame]) -> Mapping[str, DataFrame]:
    """The tables a run leaves: unmarked rows, hidden services inactive, lost references null."""
    def kept(name: str) -> DataFrame:
        out = marked[name].filter("_mark is null")
        if name == "services":
            out = out.withColumn("is_active", F.col("is_active") & ~F.col("_hidden"))
        if name == "transactions":
            for col, lost in (("order_id", "_no_order"), ("user_id", "_no_user")):
                out = out.withColumn(col, F.when(~F.col(lost), F.col(col)))
        return out.drop(*MARKS)

    return Lazy({}, **{name: lambda name=name: kept(name) for name in marked})


def run_retention(T, as_of, policy: str = "api", as_of_notifications=None) -> tuple[Mapping[str, DataFrame], list[Step]]:
    """R1 → R6 in order: the tables that stay, and what each step removes."""
    marked = mark_tables(T, as_of, policy, as_of_notifications)
    kept = {**snapshot(T), **kept_tables(marked)}
    owner = {"cancelled_orders": "orders", "inactive_users": "users", "old_notifications": "notifications",
             "read_notifications": "notifications", "old_messages": "messages", "dead_services": "services"}
    steps = [Step(name, kept, marked[table].filter(F.col("_mark") == name).select("id")) for name, table in owner.items()]
    steps[1].extra["blocked"] = marked["users"].filter("_blocked").select("id")
    return kept, steps


def retention_counts(T, as_of, policy: str = "api", as_of_notifications=None) -> DataFrame:
    """One row: rows removed per step and the row counts left (A3), as the run log reports; one aggregate a table."""
    marked = mark_tables(T, as_of, policy, as_of_notifications)

    def removed(step: str):
        return F.count(F.when(F.col("_mark") == step, 1)).alias(step)

    def left(table: str):
        return F.count(F.when(F.col("_mark").isNull(), 1)).alias(f"total_{table}")

    parts = [marked["orders"].agg(removed("cancelled_orders"), left("orders")),
             marked["users"].agg(removed("inactive_users"), F.count(F.when(F.col("_blocked"), 1)).alias("blocked_users"), left("users")),
             marked["notifications"].agg(removed("old_notifications"), removed("read_notifications"), left("notifications")),
             marked["messages"].agg(removed("old_messages"), left("messages")),
             marked["services"].agg(removed("dead_services"), left("services")),
             marked["transactions"].agg(left("transactions"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))                                    # one row each
    return out


def cleanup_log_row(counts: DataFrame, as_of, ran_by: str) -> DataFrame:
    """The audit row of a run (id, run_at, results as JSON, ran_by)."""
    from souk.functions.predicates import ts_lit
    return counts.select(
        F.sha2(F.concat_ws("|", F.lit(str(as_of)), F.lit(ran_by)), 256).alias("id"),
        ts_lit(as_of).alias("run_at"),
        F.to_json(F.struct(*[F.col(c) for c in counts.columns])).alias("results"),
        F.lit(ran_by).alias("ran_by"))

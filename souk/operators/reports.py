"""Aggregations and reports.

Each per-key report is one hash aggregate (partial + final, i.e. map-side
combine before the shuffle) per input table, joined back on the key. The
one-row totals (A1-A3) aggregate each table once with conditional counts
and combine the one-row results; a one-row side has a proven size, so the
cross join of those rows is the only cross join here.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.predicates import (
    collated,
    ACTIVE_ORDER_STATES, email_domain, money, on_day, since)


def _count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def _one_row(*frames: DataFrame) -> DataFrame:
    """Combine one-row aggregates side by side (each side is exactly one row)."""
    return functools.reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


# ----------------------------------------------------------------------------- A1
def platform_stats(T, as_of) -> DataFrame:
    u, s, o = T["users"], T["services"], T["orders"]
    users = u.agg(
        _count_if((F.col("role") == "customer") & F.col("is_active")).alias("customers"),
        _count_if((F.col("role") == "executor") & F.col("is_active")).alias("executors"),
        _count_if(~F.col("is_active")).alias("blocked_users"),
        _count_if(on_day("created_at", as_of)).alias("new_users_today"))
    services = s.agg(_count_if(F.col("is_active")).alias("active_services"),
                     F.count(F.lit(1)).alias("total_services"))
    orders = o.agg(
        F.count(F.lit(1)).alias("total_orders"),
        _count_if(F.col("status") == "completed").alias("completed_orders"),
        _count_if(F.col("status") == "cancelled").alias("cancelled_orders"),
        _count_if(F.col("status").isin(*ACTIVE_ORDER_STATES)).alias("active_orders"),
        _count_if(on_day("created_at", as_of)).alias("new_orders_today"))
    reviews = T["reviews"].agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.round(F.coalesce(F.avg("rating"), F.lit(0.0)), 6).alias("avg_rating"))
    balances = T["balances"].agg(money(F.coalesce(F.sum("amount"), F.lit(0))).alias("total_balance"))
    tx = T["transactions"].agg(
        money(F.coalesce(F.sum(F.when(F.col("type") == "deposit", F.col("amount"))), F.lit(0)))
        .alias("total_deposited"),
        money(F.coalesce(F.sum(F.when(F.col("type") == "payment", F.col("amount"))), F.lit(0)))
        .alias("total_paid"))
    return _one_row(users, services, orders, reviews, balances, tx)


# ----------------------------------------------------------------------------- A2
def health_counts(T) -> DataFrame:
    u = T["users"].agg(F.count(F.lit(1)).alias("users"),
                       _count_if(~F.col("is_active")).alias("inactive_users"))
    s = T["services"].agg(F.count(F.lit(1)).alias("services"),
                          _count_if(~F.col("is_active")).alias("hidden_services"))
    o = T["orders"].agg(F.count(F.lit(1)).alias("orders"),
                        _count_if(F.col("status") == "cancelled").alias("cancelled_orders"),
                        _count_if(F.col("status") == "completed").alias("completed_orders"))
    m = T["messages"].agg(F.count(F.lit(1)).alias("messages"))
    n = T["notifications"].agg(F.count(F.lit(1)).alias("notifications"),
                               _count_if(~F.col("is_read")).alias("unread_notifications"))
    t = T["transactions"].agg(F.count(F.lit(1)).alias("transactions"))
    r = T["reviews"].agg(F.count(F.lit(1)).alias("reviews"))
    return _one_row(u, s, o, m, n, t, r)


# ----------------------------------------------------------------------------- A3
TABLE_COUNT_NAMES = ("users", "services", "orders", "messages", "notifications", "transactions")


def table_counts(T) -> DataFrame:
    return _one_row(*[T[t].agg(F.count(F.lit(1)).alias(f"total_{t}")) for t in TABLE_COUNT_NAMES])


# ----------------------------------------------------------------------------- A4 / A5
def registrations_daily(T, as_of, days: int = 30) -> DataFrame:
    return (T["users"].filter(since("created_at", as_of, days))
            .groupBy(F.to_date("created_at").alias("day"), "role")
            .agg(F.count(F.lit(1)).alias("n_users"))
            .orderBy("day", "role"))


def orders_daily(T, as_of, days: int = 30) -> DataFrame:
    return (T["orders"].filter(since("created_at", as_of, days))
            .groupBy(F.to_date("created_at").alias("day"), "status")
            .agg(F.count(F.lit(1)).alias("n_orders"),
                 money(F.coalesce(F.sum("total_price"), F.lit(0))).alias("revenue"))
            .orderBy("day", "status"))


# ----------------------------------------------------------------------------- A6
def top_executors(T, n: int = 20) -> DataFrame:
    """Active executors by completed orders, then average rating (then id: D8)."""
    ex = T["users"].filter((F.col("role") == "executor") & F.col("is_active")).select("id", "name", "email")
    done = (T["orders"].filter(F.col("status") == "completed")
            .groupBy(F.col("executor_id").alias("o_exec")).agg(F.count(F.lit(1)).alias("completed")))
    rev = (T["reviews"].groupBy(F.col("executor_id").alias("r_exec"))
           .agg(F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("reviews_count")))
    bal = T["balances"].select(F.col("user_id").alias("b_user"), "amount")
    out = (ex.join(done, F.col("id") == F.col("o_exec"), "left")
           .join(rev, F.col("id") == F.col("r_exec"), "left")
           .join(bal, F.col("id") == F.col("b_user"), "left")
           .select("id", "name", "email",
                   F.coalesce("completed", F.lit(0)).cast("bigint").alias("completed"),
                   F.round(F.coalesce("avg_rating", F.lit(0.0)), 6).alias("avg_rating"),
                   F.coalesce("reviews_count", F.lit(0)).cast("bigint").alias("reviews_count"),
                   money(F.coalesce("amount", F.lit(0))).alias("balance")))
    return out.orderBy(F.col("completed").desc(), F.col("avg_rating").desc(), F.col("id")).limit(n)


# ----------------------------------------------------------------------------- A7 / A17
def executor_stats(T, fanout: bool = False) -> DataFrame:
    """Per executor: services, completed orders, average rating, reviews.

    Each branch is aggregated on its own before the joins, so no row is
    multiplied. ``fanout=True`` also reports the number the original
    three-way LEFT JOIN gives (completed × services × reviews, each at
    least 1) for comparison.
    """
    ex = T["users"].filter(F.col("role") == "executor").select(F.col("id").alias("executor_id"))
    sv = T["services"].groupBy(F.col("executor_id").alias("s_exec")).agg(
        F.count("id").alias("services_count"))
    od = T["orders"].groupBy(F.col("executor_id").alias("o_exec")).agg(
        _count_if(F.col("status") == "completed").alias("completed_orders"))
    rv = T["reviews"].groupBy(F.col("executor_id").alias("r_exec")).agg(
        F.avg("rating").alias("avg_rating"), F.count("id").alias("reviews_count"))
    j = (ex.join(sv, F.col("executor_id") == F.col("s_exec"), "left")
         .join(od, F.col("executor_id") == F.col("o_exec"), "left")
         .join(rv, F.col("executor_id") == F.col("r_exec"), "left"))
    cols = [
        "executor_id",
        F.coalesce("services_count", F.lit(0)).cast("bigint").alias("services_count"),
        F.coalesce("completed_orders", F.lit(0)).cast("bigint").alias("completed_orders"),
        F.round(F.coalesce("avg_rating", F.lit(0.0)), 6).alias("avg_rating"),
        F.coalesce("reviews_count", F.lit(0)).cast("bigint").alias("reviews_count"),
    ]
    if fanout:
        cols.append((F.coalesce("completed_orders", F.lit(0))
                     * F.greatest(F.coalesce("services_count", F.lit(0)), F.lit(1))
                     * F.greatest(F.coalesce("reviews_count", F.lit(0)), F.lit(1)))
                    .cast("bigint").alias("completed_orders_fanout"))
    return j.select(*cols)


# ----------------------------------------------------------------------------- A9
def service_ratings(T) -> DataFrame:
    """Rating (2 decimals, half-up) and review count per service; none → 0."""
    r = T["reviews"].groupBy(F.col("service_id").alias("r_svc")).agg(
        F.avg("rating").alias("avg_r"), F.count(F.lit(1)).alias("n"))
    return (T["services"].select("id").join(r, F.col("id") == F.col("r_svc"), "left")
            .select(F.col("id").alias("service_id"),
                    F.coalesce(F.col("avg_r"), F.lit(0)).cast("decimal(3,2)").cast("double").alias("rating"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("reviews_count")))


# ----------------------------------------------------------------------------- A10
def ledger_balances(T) -> DataFrame:
    """Deposits minus payments and withdrawals, per user (one group-by for all users)."""
    t = T["transactions"]
    signed = (F.when(F.col("type") == "deposit", F.col("amount"))
              .when(F.col("type").isin("payment", "withdrawal"), -F.col("amount"))
              .otherwise(F.lit(0)))
    return (t.filter(F.col("user_id").isNotNull()).groupBy("user_id")
            .agg(F.sum(signed).alias("ledger")))


# ----------------------------------------------------------------------------- A11
def email_domains(T, min_count: int = 5, n: int = 10) -> DataFrame:
    """Domains compared as the tables do (D1); a group is shown by its least spelling in lower case."""
    domain = email_domain("email")
    return (T["users"].filter(F.col("is_active"))
            .groupBy(collated(domain).alias("_k"))
            .agg(F.min(F.lower(domain)).alias("domain"), F.count(F.lit(1)).alias("cnt")).drop("_k")
            .filter(F.col("cnt") > min_count)
            .orderBy(F.col("cnt").desc(), F.col("domain")).limit(n))


# ----------------------------------------------------------------------------- A12
def suspicious_executors(T, min_services: int = 10, n: int = 10) -> DataFrame:
    """Active users with more than ``min_services`` services and no orders on any."""
    s = T["services"].groupBy("executor_id").agg(
        F.count("id").alias("services_count"), F.sum("orders_count").cast("bigint").alias("total_orders"))
    u = T["users"].filter(F.col("is_active")).select("id", "name", "email", "created_at")
    return (u.join(s, F.col("id") == F.col("executor_id"))
            .filter((F.col("services_count") > min_services) & (F.col("total_orders") == 0))
            .select("id", "name", "email", "services_count", "total_orders", "created_at")
            .orderBy(F.col("services_count").desc(), F.col("id")).limit(n))


# ----------------------------------------------------------------------------- A13
def category_counts(T) -> DataFrame:
    """Visible services per category (0 for empty ones) and the overall total."""
    from souk.operators.views import visible_services
    vs = visible_services(T).groupBy(F.col("c.id").alias("cat_id")).agg(F.count(F.lit(1)).alias("n"))
    cats = T["categories"]
    per = (cats.join(vs, cats["id"] == vs["cat_id"], "left")
           .select("slug", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("services")))
    total = per.agg(F.sum("services").cast("bigint").alias("total_services"))
    return per.crossJoin(F.broadcast(total)).orderBy("slug")


# ----------------------------------------------------------------------------- A14 / A16
def unread_counts(T) -> DataFrame:
    return T["notifications"].groupBy("user_id").agg(_count_if(~F.col("is_read")).alias("unread_count"))


def service_order_counts(T) -> DataFrame:
    """Orders per service recomputed from orders (every service, 0 when none)."""
    o = T["orders"].groupBy(F.col("service_id").alias("o_svc")).agg(F.count(F.lit(1)).alias("n"))
    return (T["services"].select("id", "orders_count").join(o, F.col("id") == F.col("o_svc"), "left")
            .select(F.col("id").alias("service_id"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("orders_count"),
                    F.col("orders_count").cast("bigint").alias("stored_count")))


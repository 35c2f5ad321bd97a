"""Per-user histories and trailing counts.

A window partitioned by user alone puts every row of a user in one task;
one user may hold a third of a table, so each operator here splits hot
keys and stays exact:

- top-k per key: each task keeps k rows of a key before the one shuffle
  (Spark's window group limit), so a hot key is k rows per task;
- running sums: a running sum per segment (``segments.py``) plus the totals
  of the key's segments before it;
- trailing counts over a window of length w: the rank of the row less the
  number of rows before its window, ranked together over segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.predicates import money, order_participants
from souk.operators.segments import PART, running, segments, trailing

# ----------------------------------------------------------------------------- building blocks
def top_k_per_key(df: DataFrame, key: str, order: list[Column], k: int, rank_col: str = "rn") -> DataFrame:
    """Rows ranked ``1..k`` per ``key`` in ``order`` (which must be total).

    Spark limits each task to k rows of a key before the shuffle (window group
    limit), so a busy key sends k rows per task, in one exchange.
    """
    w = Window.partitionBy(key).orderBy(*order)
    out = df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
    return out.withColumn(rank_col, F.col(rank_col).cast("bigint"))


def running_sum(df: DataFrame, key: str, ts: str, tiebreak: str, value: Column, out: str = "running") -> DataFrame:
    """Exact running sum of ``value`` per ``key`` in (ts, tiebreak) order, a busy key cut into segments."""
    return running(segments(df, key, [ts, tiebreak], "running-sum"), **{out: value}).drop(PART)


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int, out: str = "earlier") -> DataFrame:
    """Rows of the same key with ``ts`` in ``[ts - seconds, ts]``, this row excluded (a difference of ranks)."""
    return trailing(df, key, ts, seconds, out)


def flag_bursts(df: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """W4 general form: ``earlier`` rows in the trailing window and ``flagged`` when ≥ limit."""
    return trailing_count(df, key, ts, seconds).withColumn("flagged", F.col("earlier") >= limit)


# ----------------------------------------------------------------------------- W1
def inbox(T, k: int = 50) -> DataFrame:
    """Newest ``k`` notifications per user with the user's unread count."""
    from souk.operators.reports import unread_counts
    n = T["notifications"].select("id", "user_id", "type", "title", "is_read", "created_at")
    top = top_k_per_key(n, "user_id", [F.col("created_at").desc(), F.col("id")], k)
    return top.join(unread_counts(T), "user_id")


# ----------------------------------------------------------------------------- W2
def statement(T, k: int = 20) -> DataFrame:
    """Newest ``k`` ledger rows per user and the stored balance (0 if none)."""
    t = T["transactions"].filter(F.col("user_id").isNotNull()).select(
        "id", "user_id", "order_id", "type", money("amount").alias("amount"), "created_at")
    top = top_k_per_key(t, "user_id", [F.col("created_at").desc(), F.col("id")], k)
    b = T["balances"].select(F.col("user_id").alias("b_user"), "amount")
    return (top.join(b, F.col("user_id") == F.col("b_user"), "left")
            .withColumn("balance", money(F.coalesce(b["amount"], F.lit(0))))
            .drop("b_user").drop(b["amount"]))


# ----------------------------------------------------------------------------- W3
def dossier_items(T, k: int = 10) -> DataFrame:
    """Last ``k`` orders, services, transactions and reviews per user, one row per item.

    ``kind`` names the list, ``rn`` the position; the flat form of W3.
    """
    o = (order_participants(T["orders"]).select("user_id", "id", "created_at"))
    o = top_k_per_key(o, "user_id", [F.col("created_at").desc(), F.col("id")], k).withColumn("kind", F.lit("order"))
    s = T["services"].select(F.col("executor_id").alias("user_id"), "id", "created_at")
    s = top_k_per_key(s, "user_id", [F.col("id")], k).withColumn("kind", F.lit("service"))
    t = T["transactions"].filter(F.col("user_id").isNotNull()).select("user_id", "id", "created_at")
    t = top_k_per_key(t, "user_id", [F.col("created_at").desc(), F.col("id")], k).withColumn("kind", F.lit("transaction"))
    r = order_participants(T["reviews"]).select("user_id", "id", "created_at")
    r = top_k_per_key(r, "user_id", [F.col("created_at").desc(), F.col("id")], k).withColumn("kind", F.lit("review"))
    return o.unionByName(s).unionByName(t).unionByName(r).select(
        "user_id", "kind", "rn", F.col("id").alias("item_id"), "created_at")


def user_dossier(T, k: int = 10) -> DataFrame:
    """W3 nested: one row per user with four lists of at most ``k`` items each."""
    items = dossier_items(T, k)
    lists = items.groupBy("user_id").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("rn", "item_id", "created_at"))))
        .alias(f"{kind}s") for kind in ("order", "service", "transaction", "review")])
    u = T["users"].select("id", "name", "email", "role", "is_active", "bio", "created_at")
    from souk.operators.views import users_with_balance
    bal = users_with_balance(T).select(F.col("id").alias("b_id"), "balance")
    return (u.join(bal, F.col("id") == F.col("b_id")).drop("b_id")
            .join(lists, F.col("id") == F.col("user_id"), "left").drop("user_id"))


# ----------------------------------------------------------------------------- W4 / W5
def flag_service_bursts(T, limit: int = 5) -> DataFrame:
    """Services with ≥ ``limit`` others by the same executor in the trailing day."""
    s = T["services"].select("id", "executor_id", "created_at")
    return flag_bursts(s, "executor_id", "created_at", 86_400, limit)


def flag_order_bursts(T, limit: int = 5) -> DataFrame:
    """Orders with ≥ ``limit`` others by the same customer in the trailing hour."""
    o = T["orders"].select("id", "customer_id", "created_at")
    return flag_bursts(o, "customer_id", "created_at", 3_600, limit)


def flag_attempt_bursts(T, limit: int = 5) -> DataFrame:
    """The general form on limiter attempts: ≥ ``limit`` others per key in the trailing day."""
    a = T["attempts"].select("attempt_id", "attempt_key", "ts")
    return flag_bursts(a, "attempt_key", "ts", 86_400, limit)


# ----------------------------------------------------------------------------- W6
def signed_amount() -> Column:
    return (F.when(F.col("type") == "deposit", F.col("amount"))
            .when(F.col("type").isin("payment", "withdrawal"), -F.col("amount"))
            .otherwise(F.lit(0)))


def running_balance(T) -> DataFrame:
    """Balance after each ledger row of a user (deposits add, payments/withdrawals subtract)."""
    t = T["transactions"].filter(F.col("user_id").isNotNull()).select(
        "id", "user_id", "type", "amount", "created_at")
    out = running_sum(t, "user_id", "created_at", "id", signed_amount(), "balance_after")
    return out.select("id", "user_id", "type", money("amount").alias("amount"), "created_at",
                      money("balance_after").alias("balance_after"))

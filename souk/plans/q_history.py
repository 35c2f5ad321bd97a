"""Registered per-user histories and trailing counts (W rows)."""

from __future__ import annotations

from souk.operators import history as H
from souk.plans.registry import money_sql as M, register

register("inbox", """
SELECT n.id, n.user_id, n.type, n.title, n.is_read, n.created_at, n.rn, c.unread_count
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rn
      FROM m_notifications) n
JOIN (SELECT user_id, count(*) FILTER (WHERE NOT is_read) AS unread_count
      FROM m_notifications GROUP BY user_id) c ON c.user_id = n.user_id
WHERE n.rn <= 50""", "W1: newest 50 notifications per user with unread count")(
    lambda T: H.inbox(T, 50).select("id", "user_id", "type", "title", "is_read", "created_at", "rn",
                                    "unread_count"))

register("statement", f"""
SELECT t.id, t.user_id, t.order_id, t.type, {M('t.amount')} AS amount, t.created_at, t.rn,
       {M('coalesce(b.amount, 0)')} AS balance
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rn
      FROM m_transactions WHERE user_id IS NOT NULL) t
LEFT JOIN m_balances b ON b.user_id = t.user_id
WHERE t.rn <= 20""", "W2: newest 20 ledger rows per user with balance")(
    lambda T: H.statement(T, 20))

register("dossier_items", """
SELECT user_id, kind, rn, item_id, created_at FROM (
  SELECT u.id AS user_id, 'order' AS kind, o.id AS item_id, o.created_at,
         row_number() OVER (PARTITION BY u.id ORDER BY o.created_at DESC, o.id) AS rn
  FROM m_users u JOIN m_orders o ON o.customer_id = u.id OR o.executor_id = u.id
  UNION ALL
  SELECT executor_id, 'service', id, created_at,
         row_number() OVER (PARTITION BY executor_id ORDER BY id) FROM m_services
  UNION ALL
  SELECT user_id, 'transaction', id, created_at,
         row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id)
  FROM m_transactions WHERE user_id IS NOT NULL
  UNION ALL
  SELECT u.id, 'review', r.id, r.created_at,
         row_number() OVER (PARTITION BY u.id ORDER BY r.created_at DESC, r.id)
  FROM m_users u JOIN m_reviews r ON r.customer_id = u.id OR r.executor_id = u.id
) q WHERE rn <= 10""", "W3: last 10 orders, services, transactions, reviews per user (flat)")(
    lambda T: H.dossier_items(T, 10))

_BURST = """
SELECT {cols}, earlier, earlier >= 5 AS flagged FROM (
  SELECT {cols}, count(*) OVER (PARTITION BY {key} ORDER BY {ts}
                                RANGE BETWEEN INTERVAL {w} PRECEDING AND CURRENT ROW) - 1 AS earlier
  FROM {table}) q"""

register("flag_service_bursts", _BURST.format(
    cols="id, executor_id, created_at", key="executor_id", ts="created_at", w="1 DAY", table="m_services"),
         "W4: services with 5 earlier ones by the executor in the trailing day")(
    lambda T: H.flag_service_bursts(T))

register("flag_order_bursts", _BURST.format(
    cols="id, customer_id, created_at", key="customer_id", ts="created_at", w="1 HOUR", table="m_orders"),
         "W5: orders with 5 earlier ones by the customer in the trailing hour")(
    lambda T: H.flag_order_bursts(T))

register("flag_attempt_bursts", _BURST.format(
    cols="attempt_id, attempt_key, ts", key="attempt_key", ts="ts", w="1 DAY", table="m_attempts"),
         "W4 general form on limiter attempts (5 per day)")(
    lambda T: H.flag_attempt_bursts(T))

register("running_balance", f"""
SELECT id, user_id, type, {M('amount')} AS amount, created_at,
  {M('''sum(CASE WHEN type = 'deposit' THEN amount WHEN type IN ('payment','withdrawal') THEN -amount ELSE 0 END)
       OVER (PARTITION BY user_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)''')}
    AS balance_after
FROM m_transactions WHERE user_id IS NOT NULL""", "W6: balance after each ledger row")(
    lambda T: H.running_balance(T))

"""Registered retention steps and the full run (R rows, S9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.operators import retention as RT
from souk.plans.registry import AS_OF, AS_OF_EVENTS, NOW, NOW_EV, money_sql, register


def _S(T):
    return RT.snapshot(T)


register("retire_cancelled_orders", f"""
SELECT id FROM m_orders WHERE status = 'cancelled' AND updated_at < {NOW} - INTERVAL 90 DAY""",
         "R1: cancelled orders older than 90 days")(
    lambda T: RT.retire_cancelled_orders(_S(T), AS_OF).removed)

register("retire_inactive_users", f"""
SELECT id, CASE WHEN id IN (SELECT customer_id FROM m_orders UNION ALL SELECT executor_id FROM m_orders
                            UNION ALL SELECT sender_id FROM m_messages UNION ALL SELECT customer_id FROM m_reviews
                            UNION ALL SELECT executor_id FROM m_reviews) THEN 'blocked' ELSE 'deleted' END AS outcome
FROM m_users WHERE NOT is_active AND updated_at < {NOW} - INTERVAL 30 DAY""",
         "R2/X5: inactive accounts, deleted or blocked by references")(
    lambda T: (lambda st: st.removed.select("id", F.lit("deleted").alias("outcome")).unionByName(
        st.extra["blocked"].select("id", F.lit("blocked").alias("outcome"))))(
        RT.retire_inactive_users(_S(T), AS_OF)))

R3_AS_OF = "2024-03-10 00:00:00"   # late enough that the 60-day rule removes part of January
register("drop_old_notifications", f"""
SELECT id FROM m_notifications WHERE created_at < timestamp '{R3_AS_OF}' - INTERVAL 60 DAY""",
         "R3: notifications older than 60 days")(
    lambda T: RT.drop_old_notifications(_S(T), R3_AS_OF).removed)

register("drop_read_notifications", f"""
SELECT id FROM m_notifications WHERE is_read AND created_at < {NOW_EV} - INTERVAL 7 DAY""",
         "R4: read notifications older than 7 days")(
    lambda T: RT.drop_read_notifications(_S(T), AS_OF_EVENTS).removed)

register("drop_old_messages", f"""
SELECT m.id FROM m_messages m JOIN m_orders o ON o.id = m.order_id
WHERE o.status IN ('completed','cancelled') AND m.created_at < {NOW} - INTERVAL 180 DAY""",
         "R5: old messages of closed orders")(lambda T: RT.drop_old_messages(_S(T), AS_OF).removed)

register("drop_dead_services", f"""
SELECT s.id FROM m_services s
WHERE NOT s.is_active AND s.created_at < {NOW} - INTERVAL 365 DAY
  AND NOT EXISTS (SELECT 1 FROM m_orders o WHERE o.service_id = s.id)""",
         "R6: dead services (api policy)")(lambda T: RT.drop_dead_services(_S(T), AS_OF).removed)

register("drop_dead_services_script", """
SELECT s.id FROM m_services s JOIN m_users u ON u.id = s.executor_id
WHERE NOT s.is_active AND NOT u.is_active
  AND NOT EXISTS (SELECT 1 FROM m_orders o WHERE o.service_id = s.id)""",
         "R6: dead services (script policy)")(
    lambda T: RT.drop_dead_services(_S(T), AS_OF, policy="script").removed)

_RUN = f"""
WITH o1 AS (SELECT id FROM m_orders WHERE status = 'cancelled' AND updated_at < {NOW} - INTERVAL 90 DAY),
orders1 AS (SELECT * FROM m_orders WHERE id NOT IN (SELECT id FROM o1)),
msg1 AS (SELECT * FROM m_messages WHERE order_id NOT IN (SELECT id FROM o1)),
cand AS (SELECT id FROM m_users WHERE NOT is_active AND updated_at < {NOW} - INTERVAL 30 DAY),
blocked AS (SELECT id FROM cand WHERE id IN (
  SELECT customer_id FROM orders1 UNION ALL SELECT executor_id FROM orders1 UNION ALL SELECT sender_id FROM msg1
  UNION ALL SELECT customer_id FROM m_reviews UNION ALL SELECT executor_id FROM m_reviews)),
gone AS (SELECT id FROM cand WHERE id NOT IN (SELECT id FROM blocked)),
notif2 AS (SELECT * FROM m_notifications WHERE user_id NOT IN (SELECT id FROM gone)),
n3 AS (SELECT id FROM notif2 WHERE created_at < {NOW_EV} - INTERVAL 60 DAY),
notif3 AS (SELECT * FROM notif2 WHERE NOT (created_at < {NOW_EV} - INTERVAL 60 DAY)),
n4 AS (SELECT id FROM notif3 WHERE is_read AND created_at < {NOW_EV} - INTERVAL 7 DAY),
m5 AS (SELECT id FROM msg1 WHERE created_at < {NOW} - INTERVAL 180 DAY
         AND order_id IN (SELECT id FROM orders1 WHERE status IN ('completed','cancelled'))),
svc2 AS (SELECT id, created_at, is_active AND executor_id NOT IN (SELECT id FROM cand) AS is_active
         FROM m_services WHERE executor_id NOT IN (SELECT id FROM gone)),
s6 AS (SELECT id FROM svc2 WHERE NOT is_active AND created_at < {NOW} - INTERVAL 365 DAY
         AND id NOT IN (SELECT service_id FROM orders1))"""

register("run_retention", f"""{_RUN}
SELECT (SELECT count(*) FROM o1) AS cancelled_orders, (SELECT count(*) FROM gone) AS inactive_users,
       (SELECT count(*) FROM n3) AS old_notifications, (SELECT count(*) FROM n4) AS read_notifications,
       (SELECT count(*) FROM m5) AS old_messages, (SELECT count(*) FROM s6) AS dead_services,
       (SELECT count(*) FROM blocked) AS blocked_users,
       (SELECT count(*) FROM m_users) - (SELECT count(*) FROM gone) AS total_users,
       (SELECT count(*) FROM svc2) - (SELECT count(*) FROM s6) AS total_services,
       (SELECT count(*) FROM orders1) AS total_orders,
       (SELECT count(*) FROM msg1) - (SELECT count(*) FROM m5) AS total_messages,
       (SELECT count(*) FROM notif3) - (SELECT count(*) FROM n4) AS total_notifications,
       (SELECT count(*) FROM m_transactions) AS total_transactions""",
         "R7/A3: full retention run, counts per step and tables left")(
    lambda T: RT.retention_counts(T, AS_OF, "api", AS_OF_EVENTS))


# The tables a full run leaves; "id" columns only where a table's other columns stay as they are.
_KEPT = {
    "orders": ("id, status", "SELECT id, status FROM orders1"),
    "users": ("id, is_active", "SELECT id, is_active FROM m_users WHERE id NOT IN (SELECT id FROM gone)"),
    "services": ("id, executor_id, is_active",
                 "SELECT s.id, m.executor_id, s.is_active FROM svc2 s JOIN m_services m ON m.id = s.id WHERE s.id NOT IN (SELECT id FROM s6)"),
    "messages": ("id, order_id", "SELECT id, order_id FROM msg1 WHERE id NOT IN (SELECT id FROM m5)"),
    "notifications": ("id, user_id, is_read", "SELECT id, user_id, is_read FROM notif3 WHERE id NOT IN (SELECT id FROM n4)"),
    "status_log": ("order_id, old_status, new_status, created_at",
                   "SELECT order_id, old_status, new_status, created_at FROM m_status_log WHERE order_id NOT IN (SELECT id FROM o1)"),
    "balances": ("user_id, amount", f"SELECT user_id, {money_sql('amount')} AS amount FROM m_balances WHERE user_id NOT IN (SELECT id FROM gone)"),
    "profiles": ("user_id", "SELECT user_id FROM m_profiles WHERE user_id NOT IN (SELECT id FROM gone)"),
    "transactions": ("id, user_id, order_id", """SELECT t.id,
       CASE WHEN EXISTS (SELECT 1 FROM gone g WHERE g.id = t.user_id) THEN NULL ELSE t.user_id END AS user_id,
       CASE WHEN EXISTS (SELECT 1 FROM o1 WHERE o1.id = t.order_id) THEN NULL ELSE t.order_id END AS order_id
FROM m_transactions t"""),
}
for _name, (_cols, _sql) in _KEPT.items():
    register(f"retention_kept_{_name}", f"{_RUN}\n{_sql}", f"R1-R7: the rows of {_name} that a full run leaves")(
        lambda T, _n=_name, _c=_cols: _kept(T, _n, _c))


def _kept(T, name, cols):
    df = RT.kept_tables(RT.mark_tables(T, AS_OF, "api", AS_OF_EVENTS))[name]
    return df.select(*[F.round(F.col(c).cast("double"), 2).alias(c) if c == "amount" else F.col(c) for c in cols.split(", ")])

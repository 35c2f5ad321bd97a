"""Registered change rules (C rows) over request tables derived from the data.

Ordered folds (C1, C2, C7) are twinned by DuckDB recursive CTEs that walk
each key's requests by row number; the rest by joins and windows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.functions.predicates import money
from souk.operators import audits as Q
from souk.operators import changes as C
from souk.operators import reports as R
from souk.plans.registry import AS_OF, REGISTRY, TRIMMED, money_sql as M, register


def _fold_out(df):
    return df.select("request_id", "kind", "user_id", "status", "reason", money("amount").alias("amount"),
                     money("balance_after").alias("balance_after"))


register("place_orders", f"""
WITH RECURSIVE ev AS (
  SELECT r.request_id, r.customer_id AS user_id, cast(s.price as decimal(12,2)) AS amount,
         CASE WHEN s.id IS NULL OR NOT s.is_active THEN 'service'
              WHEN s.executor_id = r.customer_id THEN 'own' END AS pre,
         row_number() OVER (PARTITION BY r.customer_id ORDER BY r.ts, r.request_id) AS rn,
         cast(coalesce(b.amount, 0) as decimal(14,2)) AS start
  FROM m_req_orders r LEFT JOIN m_services s ON s.id = r.service_id
  LEFT JOIN m_balances b ON b.user_id = r.customer_id),
f AS (
  SELECT user_id, rn, request_id, amount,
         CASE WHEN pre IS NOT NULL THEN pre WHEN start < amount THEN 'funds' END AS reason,
         cast(CASE WHEN pre IS NULL AND start >= amount THEN start - amount ELSE start END as decimal(14,2)) AS bal
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.request_id, e.amount,
         CASE WHEN e.pre IS NOT NULL THEN e.pre WHEN f.bal < e.amount THEN 'funds' END,
         cast(CASE WHEN e.pre IS NULL AND f.bal >= e.amount THEN f.bal - e.amount ELSE f.bal END as decimal(14,2))
  FROM f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT request_id, 'order' AS kind, user_id,
       CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason,
       {M('amount')} AS amount, {M('bal')} AS balance_after
FROM f""", "C1: orders against balances, per customer in time order")(
    lambda T: _fold_out(C.place_orders(T, T["req_orders"])))

_TR = """tr(role, old, new) AS (VALUES ('customer','created','cancelled'), ('customer','in_progress','review'),
  ('customer','review','completed'), ('executor','created','in_progress'), ('executor','created','cancelled'),
  ('executor','in_progress','review'))"""

register("apply_status_changes", f"""
WITH RECURSIVE {_TR},
ev AS (
  SELECT r.request_id, r.order_id, r.actor_id, r.new_status,
         CASE WHEN r.actor_id = o.customer_id OR r.actor_id = o.executor_id THEN u.role END AS role,
         row_number() OVER (PARTITION BY r.order_id ORDER BY r.ts, r.request_id) AS rn
  FROM m_req_status r LEFT JOIN m_orders o ON o.id = r.order_id LEFT JOIN m_users u ON u.id = r.actor_id),
f AS (
  SELECT e.order_id, e.rn, e.request_id, e.actor_id, e.role, 'created' AS old_status, e.new_status,
         CASE WHEN e.role IS NULL THEN 'participant' WHEN tr.new IS NULL THEN 'transition' END AS reason,
         CASE WHEN e.role IS NOT NULL AND tr.new IS NOT NULL THEN e.new_status ELSE 'created' END AS cur
  FROM ev e LEFT JOIN tr ON tr.role = e.role AND tr.old = 'created' AND tr.new = e.new_status
  WHERE e.rn = 1
  UNION ALL
  SELECT e.order_id, e.rn, e.request_id, e.actor_id, e.role, f.cur, e.new_status,
         CASE WHEN e.role IS NULL THEN 'participant' WHEN tr.new IS NULL THEN 'transition' END,
         CASE WHEN e.role IS NOT NULL AND tr.new IS NOT NULL THEN e.new_status ELSE f.cur END
  FROM f JOIN ev e ON e.order_id = f.order_id AND e.rn = f.rn + 1
  LEFT JOIN tr ON tr.role = e.role AND tr.old = f.cur AND tr.new = e.new_status)
SELECT request_id, order_id, actor_id, role, old_status, new_status,
       CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason
FROM f""", "C2: status changes replayed from creation, wrong-order copies refused")(
    lambda T: C.apply_status_changes(T, T["req_status"], T["orders"].withColumn("status", F.lit("created"))))

register("apply_status_changes_split", REGISTRY["apply_status_changes"].sql,
         "C2 with orders cut into daily chunks (exact parallel scan for busy orders)")(
    lambda T: C.apply_status_changes(T, T["req_status"], T["orders"].withColumn("status", F.lit("created")),
                                     split="day"))

def _fresh_orders(T):
    return T["orders"].withColumn("status", F.lit("created"))


def _forced(T):
    return C.force_status(T, T["req_status"], _fresh_orders(T))


register("force_status", """
SELECT r.request_id, r.order_id, r.actor_id, 'admin' AS role,
       coalesce(lag(r.new_status) OVER (PARTITION BY r.order_id ORDER BY r.ts, r.request_id), 'created') AS old_status,
       r.new_status, 'accepted' AS status, cast(NULL AS varchar) AS reason,
       r.new_status = 'completed' AND coalesce(lag(r.new_status) OVER (PARTITION BY r.order_id ORDER BY r.ts, r.request_id), 'created') <> 'completed' AS pays_executor,
       r.new_status = 'cancelled' AND coalesce(lag(r.new_status) OVER (PARTITION BY r.order_id ORDER BY r.ts, r.request_id), 'created') NOT IN ('completed','cancelled') AS refunds_customer
FROM m_req_status r JOIN m_orders o ON o.id = r.order_id""",
         "C5: forced statuses with payout and refund flags")(
    lambda T: C.force_status(T, T["req_status"], T["orders"].withColumn("status", F.lit("created"))))

register("force_status_notifications", """
WITH f AS (
  SELECT r.*, o.customer_id, o.executor_id, coalesce(lag(r.new_status) OVER (PARTITION BY r.order_id ORDER BY r.ts, r.request_id), 'created') AS old_status
  FROM m_req_status r JOIN m_orders o ON o.id = r.order_id)
SELECT user_id, 'admin' AS type, '⚠️ Статус заказа изменён администратором' AS title,
       'Статус изменён с «' || old_status || '» на «' || new_status || '»' || coalesce('. Причина: ' || note, '') AS body, ts AS created_at
FROM (SELECT *, unnest([customer_id, executor_id]) AS user_id FROM f)""",
         "C5 effects: both sides are told, with the reason")(
    lambda T: C.forced_status_effects(T, _forced(T), T["req_status"], _fresh_orders(T))["notifications"]
    .select("user_id", "type", "title", "body", F.col("created_at").cast("timestamp").alias("created_at")))

register("force_status_ledger", f"""
WITH f AS (
  SELECT r.*, o.customer_id, o.executor_id, o.total_price,
         coalesce(lag(r.new_status) OVER (PARTITION BY r.order_id ORDER BY r.ts, r.request_id), 'created') AS old_status
  FROM m_req_status r JOIN m_orders o ON o.id = r.order_id)
SELECT executor_id AS user_id, order_id, 'deposit' AS type, {M('total_price')} AS amount, 'выплата по решению администратора' AS description
FROM f WHERE new_status = 'completed' AND old_status <> 'completed'
UNION ALL
SELECT customer_id, order_id, 'deposit', {M('total_price')}, 'возврат по решению администратора'
FROM f WHERE new_status = 'cancelled' AND old_status NOT IN ('completed', 'cancelled')""",
         "C5 effects: ledger rows with the admin's descriptions")(
    lambda T: C.forced_status_effects(T, _forced(T), T["req_status"], _fresh_orders(T))["transactions"]
    .select("user_id", "order_id", "type", money("amount").alias("amount"), "description"))

register("apply_price_changes", """
SELECT request_id, order_id, actor_id, price,
       CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN rk = 1 THEN 'applied' ELSE 'superseded' END AS status,
       reason
FROM (
  SELECT q.*, CASE WHEN reason IS NULL THEN row_number() OVER (
           PARTITION BY order_id, reason IS NULL ORDER BY ts DESC, request_id DESC) END AS rk
  FROM (
    SELECT r.request_id, r.order_id, r.actor_id, cast(r.price as double) AS price, r.ts,
           CASE WHEN NOT coalesce(r.price > 0, false) THEN 'price'
                WHEN o.id IS NULL OR NOT (r.actor_id = o.customer_id OR r.actor_id = o.executor_id) THEN 'order'
                WHEN o.status NOT IN ('created','in_progress') THEN 'status'
                WHEN r.actor_id <> o.executor_id THEN 'executor' END AS reason
    FROM m_req_price r LEFT JOIN m_orders o ON o.id = r.order_id) q) z""",
         "C3: price changes, executor only, open orders, last wins")(
    lambda T: C.apply_price_changes(T, T["req_price"]))

register("apply_reviews", rf"""
SELECT request_id, order_id, customer_id, rating, nullif({TRIMMED('comment')}, '') AS comment,
       CASE WHEN reason IS NULL AND rk = 1 THEN 'accepted' ELSE 'rejected' END AS status,
       coalesce(reason, CASE WHEN rk = 1 THEN NULL ELSE 'duplicate' END) AS reason
FROM (
  SELECT q.*, CASE WHEN reason IS NULL THEN row_number() OVER (
           PARTITION BY order_id, reason IS NULL ORDER BY ts, request_id) END AS rk
  FROM (
    SELECT r.*, CASE WHEN NOT coalesce(r.rating BETWEEN 1 AND 5, false) THEN 'rating'
                     WHEN coalesce(length({TRIMMED('r.comment')}), 0) > 1000 THEN 'comment'
                     WHEN o.id IS NULL OR o.customer_id <> r.customer_id THEN 'order'
                     WHEN o.status <> 'completed' THEN 'status'
                     WHEN EXISTS (SELECT 1 FROM m_reviews v WHERE v.order_id = r.order_id) THEN 'exists' END AS reason
    FROM m_req_reviews r LEFT JOIN m_orders o ON o.id = r.order_id) q) z""",
         "C4: reviews, first valid per order, existing ones kept")(
    lambda T: C.apply_reviews(T, T["req_reviews"]))

register("apply_deposits", f"""
SELECT coalesce(b.user_id, d.user_id) AS user_id, {M('coalesce(b.amount, 0) + coalesce(d.amount, 0)')} AS amount
FROM m_balances b FULL OUTER JOIN (
  SELECT user_id, sum(amount) AS amount FROM m_req_deposits WHERE amount > 99 GROUP BY user_id) d
  ON d.user_id = b.user_id""", "C6/C14: deposits above 99 added to balances")(
    lambda T: C.apply_deposits(T, T["req_deposits"])["balances"].select("user_id", money("amount").alias("amount")))

register("adjust_balances", f"""
WITH RECURSIVE ev AS (
  SELECT r.request_id, r.user_id, cast(r.amount as decimal(12,2)) AS amount,
         row_number() OVER (PARTITION BY r.user_id ORDER BY r.ts, r.request_id) AS rn,
         cast(coalesce(b.amount, 0) as decimal(14,2)) AS start
  FROM m_req_adjust r LEFT JOIN m_balances b ON b.user_id = r.user_id),
f AS (
  SELECT user_id, rn, request_id, amount,
         CASE WHEN amount IS NULL OR amount = 0 THEN 'amount' WHEN amount < 0 AND start < -amount THEN 'funds' END AS reason,
         cast(CASE WHEN amount IS NULL OR amount = 0 OR (amount < 0 AND start < -amount) THEN start ELSE start + amount END as decimal(14,2)) AS bal
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.request_id, e.amount,
         CASE WHEN e.amount IS NULL OR e.amount = 0 THEN 'amount' WHEN e.amount < 0 AND f.bal < -e.amount THEN 'funds' END,
         cast(CASE WHEN e.amount IS NULL OR e.amount = 0 OR (e.amount < 0 AND f.bal < -e.amount) THEN f.bal ELSE f.bal + e.amount END as decimal(14,2))
  FROM f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT request_id, 'adjust' AS kind, user_id,
       CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason,
       {M('amount')} AS amount, {M('bal')} AS balance_after
FROM f""", "C7: manual balance changes, a debit needs cover")(
    lambda T: _fold_out(C.adjust_balances(T, T["req_adjust"])))

register("post_messages", rf"""
WITH line AS (SELECT r.*, {TRIMMED('r.message')} AS text FROM m_req_messages r),
judged AS (
  SELECT line.*, o.customer_id, o.executor_id,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 'message'
         WHEN is_admin THEN NULL
         WHEN length(text) > 2000 THEN 'message'
         WHEN o.id IS NULL OR sender_id NOT IN (o.customer_id, o.executor_id) THEN 'participant'
         WHEN o.status IN ('completed','cancelled') THEN 'closed' END AS reason
  FROM line LEFT JOIN m_orders o ON o.id = line.order_id)
SELECT request_id, order_id, sender_id, if(is_admin, '🛡️ [Администратор]: ' || text, text) AS stored,
       if(reason IS NULL AND NOT is_admin, if(sender_id = customer_id, executor_id, customer_id), NULL) AS notify_user,
       if(reason IS NULL AND NOT is_admin, text[:100], NULL) AS notify_body,
       if(reason IS NULL, 'accepted', 'rejected') AS status, reason
FROM judged""", "C8: chat lines, participant and open order; admin prefix")(
    lambda T: C.post_messages(T, T["req_messages"]))


def _read_requests(T):
    k = F.expr("cast(substring(id, 2) as bigint)")
    o = T["orders"].select(
        F.concat(F.lit("k"), "id").alias("request_id"), F.col("updated_at").alias("ts"),
        F.when(k % 2 == 0, F.col("executor_id")).otherwise(F.col("customer_id")).alias("user_id"), F.col("id").alias("order_id"))
    n = T["users"].filter("role = 'customer'").select(
        F.concat(F.lit("k"), "id").alias("request_id"), F.col("created_at").alias("ts"),
        F.col("id").alias("user_id"), F.lit(None).cast("string").alias("order_id"))
    return o.unionByName(n)


register("mark_read_messages", """
SELECT m.id, m.is_read OR coalesce(if(cast(o.id[2:] as bigint) % 2 = 0, o.executor_id, o.customer_id) <> m.sender_id, false) AS is_read
FROM m_messages m LEFT JOIN m_orders o ON o.id = m.order_id""", "C9: a side reads each order's chat; others' lines become read")(
    lambda T: C.mark_read(T, _read_requests(T))["messages"].select("id", "is_read"))

register("mark_read_notifications", """
SELECT n.id, n.is_read OR n.user_id IN (SELECT u.id FROM m_users u WHERE u.role = 'customer') AS is_read
FROM m_notifications n""", "C9: users mark all their notifications read")(
    lambda T: C.mark_read(T, _read_requests(T))["notifications"].select("id", "is_read"))


def _toggle_requests(T):
    """Every service: its owner asks (refused), an admin toggles it once, every third again."""
    s = T["services"].select("id", "executor_id", "created_at")
    k = F.expr("cast(substring(id, 2) as bigint)")

    def ask(rows, tag, actor, admin):
        return rows.select(F.concat(F.lit(tag), "id").alias("request_id"), F.col("created_at").alias("ts"),
                           actor.alias("actor_id"), F.lit(admin).alias("is_admin"), F.col("id").alias("service_id"))
    return (ask(s, "t1", F.col("executor_id"), False).unionByName(ask(s, "t2", F.lit("a0"), True))
            .unionByName(ask(s.filter(k % 3 == 0), "t3", F.lit("a0"), True)))


register("toggle_services", """
SELECT id, (cast(id[2:] as bigint) % 3 = 0) = is_active AS is_active FROM m_services""",
         "C10c: odd number of admins' toggles flips a service")(
    lambda T: C.toggle_services(T, _toggle_requests(T)).select("id", "is_active"))


def _delete_requests(T):
    s = T["services"]
    return s.select(F.concat(F.lit("d"), "id").alias("request_id"), F.col("created_at").alias("ts"),
                    F.when(F.expr("cast(substring(id, 2) as bigint) % 20 = 0"), F.col("executor_id"))
                    .otherwise(F.lit("c2")).alias("actor_id"),
                    F.lit(False).alias("is_admin"), F.col("id").alias("service_id"))


register("delete_services", """
SELECT 'd' || s.id AS request_id, s.id AS service_id,
       CASE WHEN cast(substring(s.id, 2) as bigint) % 20 = 0 THEN s.executor_id ELSE 'c2' END AS actor_id,
       CASE WHEN cast(substring(s.id, 2) as bigint) % 20 <> 0 OR EXISTS (SELECT 1 FROM m_orders o WHERE o.service_id = s.id)
            THEN 'rejected' ELSE 'accepted' END AS status,
       CASE WHEN cast(substring(s.id, 2) as bigint) % 20 <> 0 THEN 'owner'
            WHEN EXISTS (SELECT 1 FROM m_orders o WHERE o.service_id = s.id) THEN 'referenced' END AS reason
FROM m_services s""",
         "C10d/X13: deletes by owner only; referenced services refused")(
    lambda T: C.delete_services(T, _delete_requests(T))["outcomes"])


def _register_requests(T):
    c = T.raw["customer"]
    k = F.col("c_custkey")
    email = (F.when(k % 4 == 0, F.concat(F.lit(" USER"), k.cast("string"), F.lit("@GMAIL.COM ")))
             .when(k % 4 == 1, F.concat(F.lit("new"), (k % 50).cast("string"), F.lit("@mail.ru")))
             .when(k % 4 == 2, F.concat(F.lit("x"), k.cast("string"), F.lit("@123.ru")))
             .otherwise(F.concat(F.lit("fresh"), k.cast("string"), F.lit("@yandex.ru"))))
    return c.select(F.concat(F.lit("g"), k.cast("string")).alias("request_id"),
                    (F.lit("2001-08-01 00:00:00").cast("timestamp") + F.expr("INTERVAL 1 SECOND") * (k % 1000).cast("int"))
                    .alias("ts"),
                    F.when(k % 9 == 0, F.lit("A")).otherwise(F.col("c_name")).alias("name"),
                    email.alias("email"),
                    F.when(k % 11 == 0, F.lit("admin")).otherwise(F.lit("customer")).alias("role"))


def _register_sql():
    return """
SELECT request_id, name, email, role,
       CASE WHEN reason IS NULL AND rk = 1 THEN 'accepted' ELSE 'rejected' END AS status,
       coalesce(reason, CASE WHEN rk = 1 THEN NULL ELSE 'duplicate' END) AS reason,
       CASE WHEN reason IS NULL AND rk = 1 THEN '#' END AS user_id
FROM (
  SELECT q.*, CASE WHEN reason IS NULL THEN row_number() OVER (
           PARTITION BY email, reason IS NULL ORDER BY ts, request_id) END AS rk
  FROM (
    SELECT r.request_id, r.ts, trim(r.name) AS name, r.email, r.role,
      CASE WHEN length(trim(r.name)) < 2 THEN 'name'
           WHEN r.role NOT IN ('customer','executor') THEN 'role'
           WHEN r.raw_email <> trim(r.raw_email) THEN 'email'
           WHEN NOT (regexp_full_match(r.email, '[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{2,}')
                     AND NOT regexp_full_match(regexp_replace(split_part(r.email, '@', -1), '\\.[^.]*$', ''), '[0-9]+')
                     AND len(list_filter(['gmail.com','googlemail.com','mail.ru','bk.ru','inbox.ru','list.ru',
                        'yandex.ru','yandex.com','ya.ru','icloud.com','me.com','mac.com','outlook.com','hotmail.com',
                        'live.com','msn.com','yahoo.com','yahoo.ru','proton.me','protonmail.com','rambler.ru',
                        'rambler.com','vk.com','internet.ru','corp.mail.ru','tut.by','mail.com','email.com'],
                        lambda d: split_part(r.email, '@', -1) = d OR ends_with(split_part(r.email, '@', -1), '.' || d))) > 0)
                THEN 'email'
           WHEN EXISTS (SELECT 1 FROM m_users u WHERE lower(u.email) = r.email) THEN 'taken' END AS reason
    FROM (SELECT r0.*, e.email FROM (SELECT 'g' || cast(c_custkey as varchar) AS request_id,
                 timestamp '2001-08-01 00:00:00' + INTERVAL 1 SECOND * cast(c_custkey % 1000 as int) AS ts,
                 CASE WHEN c_custkey % 9 = 0 THEN 'A' ELSE c_name END AS name,
                 CASE WHEN c_custkey % 4 = 0 THEN ' USER' || cast(c_custkey as varchar) || '@GMAIL.COM '
                      WHEN c_custkey % 4 = 1 THEN 'new' || cast(c_custkey % 50 as varchar) || '@mail.ru'
                      WHEN c_custkey % 4 = 2 THEN 'x' || cast(c_custkey as varchar) || '@123.ru'
                      ELSE 'fresh' || cast(c_custkey as varchar) || '@yandex.ru' END AS raw_email,
                 CASE WHEN c_custkey % 11 = 0 THEN 'admin' ELSE 'customer' END AS role
          FROM customer) r0 CROSS JOIN LATERAL (SELECT lower(trim(r0.raw_email)) AS email) e) r) q) z"""


register("register_users", _register_sql(),
         "C11a/Q6/Q8: registrations; e-mail rules, taken and duplicate e-mails refused")(
    lambda T: C.register_users(T, _register_requests(T)).withColumn(
        "user_id", F.when(F.col("user_id").isNotNull(), F.lit("#"))))


def _user_requests(T, tag: str, mod: int):
    """One request a user: every ``mod``-th customer's is ``confirmed`` and by an admin or oneself, all others' are by oneself."""
    picked = F.expr(f"role = 'customer' and cast(substring(id, 2) as bigint) % {mod} = 0")
    return T["users"].select(
        F.concat(F.lit(tag), "id").alias("request_id"), F.col("updated_at").alias("ts"),
        F.when(picked & F.expr("cast(substring(id, 2) as bigint) % 2 = 0"), F.lit("a0")).otherwise(F.col("id")).alias("actor_id"),
        F.col("id").alias("user_id"), picked.alias("confirmed"),
        F.when(F.expr("cast(substring(id, 2) as bigint) % 3 = 0"), F.lit("executor")).otherwise(F.lit("superuser")).alias("role"))


register("toggle_users", """
SELECT id, CASE WHEN role = 'customer' AND cast(substring(id, 2) as bigint) % 5 = 0
                 AND cast(substring(id, 2) as bigint) % 2 = 0 THEN NOT is_active ELSE is_active END AS is_active
FROM m_users""", "C11d: block/unblock by another user")(
    lambda T: C.toggle_users(T, _user_requests(T, "u", 5)).select("id", "is_active"))

register("change_roles", """
SELECT id, CASE WHEN role = 'customer' AND cast(substring(id, 2) as bigint) % 5 = 0
                 AND cast(substring(id, 2) as bigint) % 2 = 0 AND cast(substring(id, 2) as bigint) % 3 = 0
                THEN 'executor' ELSE role END AS role
FROM m_users""", "C11e: valid role, not oneself")(
    lambda T: C.change_roles(T, _user_requests(T, "r", 5)).select("id", "role"))

register("soft_delete_users", """
SELECT id,
  CASE WHEN role = 'customer' AND cast(substring(id, 2) as bigint) % 13 = 0
       THEN email || '_deleted_' || cast(epoch(timestamp '2001-08-02 00:00:00') as bigint) ELSE email END AS email,
  CASE WHEN role = 'customer' AND cast(substring(id, 2) as bigint) % 13 = 0 THEN name || ' (удалён)' ELSE name END AS name,
  CASE WHEN role = 'customer' AND cast(substring(id, 2) as bigint) % 13 = 0 THEN false ELSE is_active END AS is_active
FROM m_users""", "C11f: confirmed soft delete of oneself with stamped e-mail")(
    lambda T: C.soft_delete_users(T, _user_requests(T, "x", 13).withColumn("actor_id", F.col("user_id")), AS_OF).select("id", "email", "name", "is_active"))


def _broadcast_requests(T):
    ev = T.raw["events"].select("event_type").distinct()
    return ev.select(F.concat(F.lit("b"), "event_type").alias("request_id"),
                     F.lit("2001-08-02 00:00:00").cast("timestamp").alias("ts"),
                     F.concat(F.lit("news "), "event_type").alias("title"), F.lit("body").alias("body"),
                     F.when(F.col("event_type") == "click", "customer")
                     .when(F.col("event_type") == "view", "executor").alias("role"))


register("notify_all", """
SELECT 'b' || e.event_type AS request_id, u.id AS user_id, 'news ' || e.event_type AS title
FROM (SELECT DISTINCT event_type FROM events) e JOIN m_users u
  ON u.is_active AND (u.role = CASE e.event_type WHEN 'click' THEN 'customer' WHEN 'view' THEN 'executor' END
                      OR e.event_type NOT IN ('click','view'))""",
         "C12: one notification per active user of the role")(
    lambda T: C.notify_all(T, _broadcast_requests(T)).select(
        F.concat(F.lit("b"), F.substring_index("title", " ", -1)).alias("request_id"), "user_id", "title"))


def _category_requests(T):
    p = T.raw["part"].select("p_type", "p_brand").distinct()
    return p.select(F.concat(F.lit("k"), "p_type", F.lit("/"), "p_brand").alias("request_id"),
                    F.lit("2001-08-02 00:00:00").cast("timestamp").alias("ts"),
                    F.initcap("p_brand").alias("name"),
                    F.when(F.col("p_brand") == "Brand#1", F.lower("p_type"))
                    .otherwise(F.lower(F.regexp_replace("p_brand", "#", "-"))).alias("slug"),
                    F.when(F.col("p_brand") == "Brand#2", F.lit("two")).otherwise(F.lit("")).alias("icon"),
                    F.when(F.col("p_brand") == "Brand#3", F.lit("third")).alias("description"),
                    F.lit(None).cast("int").alias("sort_order"))


register("add_categories", """
SELECT id, name, slug, icon, description, sort_order FROM m_categories
UNION ALL
SELECT cast((SELECT max(id) FROM m_categories) + row_number() OVER (ORDER BY ts, request_id) as int), name, slug,
       if(name = 'Brand#2', 'two', '📁'), if(name = 'Brand#3', 'third', ''), 99 FROM (
  SELECT arg_min(name, request_id) AS name, slug, min(ts) AS ts, min(request_id) AS request_id FROM (
    SELECT 'k' || p_type || '/' || p_brand AS request_id, timestamp '2001-08-02 00:00:00' AS ts,
           upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) AS name,
           CASE WHEN p_brand = 'Brand#1' THEN lower(p_type) ELSE lower(replace(p_brand, '#', '-')) END AS slug
    FROM (SELECT DISTINCT p_type, p_brand FROM part) p) r
  WHERE slug NOT IN (SELECT slug FROM m_categories)
  GROUP BY slug) n""", "C13a/C15: new categories, existing slugs kept")(
    lambda T: C.add_categories(T, _category_requests(T)))

register("delete_reviews", """
SELECT s.id AS service_id,
  cast(cast(coalesce((SELECT avg(rating) FROM m_reviews r WHERE r.service_id = s.id
                        AND cast(substring(r.id, 2) as bigint) % 5 <> 0), 0) as decimal(3,2)) as double) AS rating,
  (SELECT count(*) FROM m_reviews r WHERE r.service_id = s.id AND cast(substring(r.id, 2) as bigint) % 5 <> 0)
    AS reviews_count
FROM m_services s""", "C13b/A9/X6: delete reviews, ratings recomputed")(
    lambda T: R.service_ratings({**T, "reviews": C.delete_by_id(
        T["reviews"], T["reviews"].filter(F.expr("cast(substring(id, 2) as bigint) % 5 = 0")).select("id")),
        "services": T["services"]}))

register("delete_notifications", """
SELECT n.id, n.user_id FROM m_notifications n
WHERE NOT (cast(substring(n.id, 2) as bigint) % 4 = 0 AND cast(substring(n.id, 2) as bigint) % 8 <> 0)""",
         "C13c: users delete their own notifications only")(
    lambda T: C.delete_by_id(T["notifications"], T["notifications"].filter(
        F.expr("cast(substring(id, 2) as bigint) % 4 = 0")).select(
        "id", F.when(F.expr("cast(substring(id, 2) as bigint) % 8 = 0"), F.lit("a0"))
        .otherwise(F.col("user_id")).alias("actor_id")), owner_col="user_id").select("id", "user_id"))

register("fix_balances", f"""
SELECT coalesce(b.user_id, d.user_id) AS user_id,
       {M('CASE WHEN d.user_id IS NOT NULL THEN d.corrected ELSE b.amount END')} AS amount
FROM m_balances b FULL OUTER JOIN (
  SELECT u.id AS user_id, greatest(coalesce(l.ledger, 0), 0) AS corrected
  FROM m_users u
  LEFT JOIN (SELECT user_id, sum(CASE WHEN type = 'deposit' THEN amount ELSE 0 END)
                        - sum(CASE WHEN type IN ('payment','withdrawal') THEN amount ELSE 0 END) AS ledger
             FROM m_transactions GROUP BY user_id) l ON l.user_id = u.id
  LEFT JOIN m_balances b2 ON b2.user_id = u.id
  WHERE u.is_active AND abs(coalesce(l.ledger, 0) - coalesce(b2.amount, 0)) > 0.01) d ON d.user_id = b.user_id""",
         "Q10/C14: balances corrected to the ledger (set-mode upsert)")(
    lambda T: Q.fix_balances(T).select("user_id", money("amount").alias("amount")))


def _service_update_requests(T):
    """One request a service; its kind follows from the number: an owner's edit (0), a stranger's (3), no title (2),
    181 days (4), an owner's edit of every field (7 of 12), an admin's with nothing in price and days (1 of 12),
    an owner's free service (5 of 18), else an admin's of 200 days."""
    s = T["services"]
    k = F.expr("cast(substring(id, 2) as bigint)")
    kind = (F.when(k % 6 == 0, "e").when(k % 6 == 3, "f").when(k % 6 == 2, "i").when(k % 6 == 4, "j")
            .when(k % 12 == 1, "g").when(k % 12 == 7, "l").when(k % 18 == 5, "h").otherwise("n"))
    s = s.withColumn("kind", kind)

    def by(default, **kinds):
        for name, value in kinds.items():
            default = F.when(F.col("kind") == name, value).otherwise(default)
        return default
    none = lambda t: F.lit(None).cast(t)                                          # noqa: E731
    admin = F.col("kind").isin("g", "n")
    return s.select(
        F.concat("kind", "id").alias("request_id"), admin.alias("is_admin"), F.col("id").alias("service_id"),
        F.when(admin, "a0").when(F.col("kind") == "f", "c5").otherwise(F.col("executor_id")).alias("actor_id"),
        F.col("created_at").alias("ts"),
        by(F.upper("title"), g=F.concat("title", F.lit(" *")), i=none("string")).alias("new_title"),
        F.col("description").alias("new_description"),
        by((F.col("price") + 1).cast("decimal(12,2)"), g=none("decimal(12,2)"), h=F.lit(0).cast("decimal(12,2)")).alias("new_price"),
        by(F.col("deadline"), g=F.lit(0), j=F.lit(181), n=F.lit(200)).alias("new_deadline"),
        by(F.col("category_id"), l=F.lit(2)).alias("new_category_id"),
        by(none("string"), g=F.lit('["x"]'), l=F.lit('["a","b"]')).alias("new_tags"),
        by(none("boolean"), g=F.lit(False), l=F.lit(True)).alias("new_is_active"),
        by(none("boolean"), l=F.lit(True)).alias("new_is_negotiable"))


register("update_services", f"""
WITH n AS (SELECT *, cast(id[2:] as bigint) AS k FROM m_services),
z AS (SELECT *, CASE WHEN k % 12 = 1 THEN 'bare' WHEN k % 12 = 7 THEN 'full' WHEN k % 6 = 0 THEN 'plain'
                     WHEN k % 6 = 5 AND k % 18 <> 5 THEN 'long' END AS edit FROM n)
SELECT id,
  CASE edit WHEN 'bare' THEN title || ' *' ELSE if(edit IS NULL, title, upper(title)) END AS title,
  {M("CASE WHEN edit IS NULL THEN price WHEN edit = 'bare' THEN 1 ELSE price + 1 END")} AS price,
  CASE edit WHEN 'bare' THEN 1 WHEN 'long' THEN 200 ELSE deadline END AS deadline,
  if(edit = 'full', 2, category_id) AS category_id,
  CASE edit WHEN 'bare' THEN false WHEN 'full' THEN true ELSE is_active END AS is_active,
  CASE edit WHEN 'bare' THEN '["x"]' WHEN 'full' THEN '["a","b"]' ELSE if(edit IS NULL, tags, '[]') END AS tags,
  if(edit IS NULL, is_negotiable, edit = 'full') AS is_negotiable,
  CASE WHEN edit IS NULL THEN ['', '', 'fields', 'owner', 'deadline', 'price'][k % 6 + 1] END AS reason
FROM z""",
         "C10b: service edits, owner-only with limits; admin fallbacks")(
    lambda T: C.update_services(T, _service_update_requests(T)).select(
        "id", "title", money("price").alias("price"), "deadline", "category_id", "is_active", "tags", "is_negotiable", "reason"))


def _user_update_requests(T):
    """Every customer: empty name, new name with blanks, one letter, no name; some twice."""
    u = T["users"].filter("role = 'customer'")
    k = F.expr("cast(substring(id, 2) as bigint)")
    name = (F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("  Renamed ")).when(k % 4 == 2, F.lit(" x\n")))
    bio = F.when(k % 3 < 2, F.when(k % 3 == 0, F.lit("new bio")).otherwise(F.lit("")))
    first = u.select(F.concat(F.lit("m"), "id").alias("request_id"), F.col("updated_at").alias("ts"),
                     F.col("id").alias("user_id"), name.alias("name"), bio.alias("bio"))
    again = u.filter(k % 5 == 0).select(F.concat(F.lit("n"), "id").alias("request_id"),
                                        (F.col("updated_at") + F.expr("interval 1 hour")).alias("ts"), F.col("id").alias("user_id"),
                                        F.lit("Later").alias("name"), F.lit(None).cast("string").alias("bio"))
    return first.unionByName(again)


register("update_users", """
WITH n AS (SELECT *, CASE WHEN role = 'customer' THEN cast(id[2:] as bigint) END AS k FROM m_users)
SELECT id,
  CASE WHEN k % 5 = 0 THEN 'Later' WHEN k % 4 = 1 THEN 'Renamed' ELSE name END AS name,
  CASE WHEN k % 5 = 0 OR k % 4 IN (0, 2) THEN bio WHEN k % 3 = 0 THEN 'new bio' WHEN k % 3 = 1 THEN '' ELSE bio END AS bio
FROM n""", "C11b: trimmed names of two letters, else nothing changes; a null bio keeps the old one")(
    lambda T: C.update_users(T, _user_update_requests(T)).select("id", "name", "bio"))


def _profile_requests(T):
    """One request a user: executors with empty fields, with unreadable ones, with absent ones; others' socials, some unreadable."""
    k = F.expr("cast(substring(id, 2) as bigint)")
    seller, third = F.col("role") == "executor", k % 3
    none = F.lit(None).cast("string")
    pick = lambda a, b, c: F.when(third == 0, a).when(third == 1, b).otherwise(c)
    socials = F.when(seller, pick(F.lit('{"github":"gh"}'), F.lit("not json"), none)).otherwise(
        F.when(k % 25 == 0, "not json").otherwise('{"website":"w"}'))
    return T["users"].select(
        F.concat(F.lit("q"), "id").alias("request_id"), F.col("updated_at").alias("ts"), F.col("id").alias("actor_id"),
        pick(F.lit(""), F.lit("busy"), none).alias("availability"), pick(F.lit("sql"), F.lit("x"), F.lit("")).alias("specialization"),
        pick(F.lit(0), F.lit(5), F.lit(None)).cast("decimal(10,2)").alias("hourly_rate"),
        pick(none, F.lit(""), F.lit("soon")).alias("response_time"),
        pick(F.lit("[]"), F.lit("oops"), F.lit('["ru","fr"]')).alias("languages"),
        pick(F.lit('[{"name":"go","level":4}]'), F.lit("[]"), F.lit("oops")).alias("skills"),
        pick(F.lit("oops"), F.lit('[{"url":"u"}]'), none).alias("portfolio"), socials.alias("socials"))


register("upsert_profiles", f"""
WITH offer(third, availability, specialization, hourly_rate, response_time, languages, skills, portfolio, socials) AS (VALUES
  (0, 'available', 'sql', NULL, '< 24 часов', '[]', '[{{"name":"go","level":4}}]', '[]', '{{"github":"gh"}}'),
  (1, 'busy', 'x', 5, '< 24 часов', '[]', '[]', '[{{"url":"u"}}]', '{{}}'),
  (2, 'available', NULL, NULL, 'soon', '["ru","fr"]', '[]', '[]', '{{}}'))
SELECT u.id AS user_id, offer.* EXCLUDE (third, hourly_rate), {M("offer.hourly_rate")} AS hourly_rate
FROM m_users u JOIN offer ON cast(u.id[2:] as bigint) % 3 = third WHERE u.role = 'executor'
UNION ALL BY NAME
SELECT u.id AS user_id, availability, specialization, response_time, languages, skills, portfolio,
       if(cast(u.id[2:] as bigint) % 25 = 0, '{{}}', '{{"website":"w"}}') AS socials, {M("hourly_rate")} AS hourly_rate
FROM m_users u LEFT JOIN m_profiles p ON p.user_id = u.id WHERE u.role <> 'executor'
UNION ALL BY NAME
SELECT user_id, availability, specialization, response_time, languages, skills, portfolio, socials, {M("hourly_rate")} AS hourly_rate
FROM m_profiles WHERE user_id NOT IN (SELECT id FROM m_users)""",
         "C11c: profile upsert, executors all fields with defaults, others socials only")(
    lambda T: C.upsert_profiles(T, _profile_requests(T)).select(
        "user_id", "availability", "specialization", money("hourly_rate").alias("hourly_rate"), "response_time",
        "languages", "skills", "portfolio", "socials"))


# ----------------------------------------------------------------------------- effects of C7, C8, C11a
_UUID = "array_to_string([sha256({0})[1:8], sha256({0})[9:12], sha256({0})[13:16], sha256({0})[17:20], sha256({0})[21:32]], '-')"

register("post_messages_effects", f"""
WITH done AS (SELECT p.*, r.ts, r.is_admin, {_UUID.format('p.request_id')} AS new_id
              FROM ({REGISTRY['post_messages'].sql}) p JOIN m_req_messages r USING (request_id) WHERE p.status = 'accepted')
SELECT 'message' AS row_kind, new_id AS id, order_id, sender_id AS user_id, stored AS body, NULL AS title, NULL AS data, ts AS created_at FROM done
UNION ALL
SELECT 'notification', 'nm-' || new_id, NULL, notify_user, notify_body, 'Новое сообщение', '{{"order_id":"' || order_id || '"}}', ts
FROM done WHERE NOT is_admin""", "C8/F4/F24: message rows of accepted chat lines and the other side's notification")(
    lambda T: _message_rows(C.message_effects(T, T["req_messages"])))


def _message_rows(effects):
    none = F.lit(None).cast("string")
    return (effects["messages"].select(F.lit("message").alias("row_kind"), "id", "order_id", F.col("sender_id").alias("user_id"),
                                       F.col("message").alias("body"), none.alias("title"), none.alias("data"), "created_at")
            .unionByName(effects["notifications"].select(F.lit("notification").alias("row_kind"), "id", none.alias("order_id"), "user_id",
                                                         "body", "title", "data", "created_at")))


def _adjust_rows(T):
    effects = C.adjust_effects(T, T["req_adjust"], C.adjust_balances(T, T["req_adjust"]))
    none = F.lit(None)
    return (effects["transactions"].select(F.lit("ledger").alias("row_kind"), "id", "user_id", "type", money("amount").alias("amount"),
                                           "description", "created_at")
            .unionByName(effects["balances"].select(
                F.lit("balance").alias("row_kind"), none.cast("string").alias("id"), "user_id", none.cast("string").alias("type"),
                money("amount").alias("amount"), none.cast("string").alias("description"), none.cast("timestamp").alias("created_at"))))


register("adjust_balances_effects", f"""
WITH settled AS ({REGISTRY['adjust_balances'].sql}),
done AS (SELECT r.* FROM m_req_adjust r JOIN settled USING (request_id) WHERE settled.status = 'accepted'),
moved AS (SELECT user_id, amount FROM m_balances UNION ALL SELECT user_id, amount FROM done)
SELECT 'ledger' AS row_kind, 'tx-' || {_UUID.format('request_id')} AS id, user_id, if(amount > 0, 'deposit', 'withdrawal') AS type,
       {M('abs(amount)')} AS amount, coalesce(nullif(reason, ''), 'корректировка администратором') AS description, ts AS created_at FROM done
UNION ALL
SELECT 'balance', NULL, user_id, NULL, {M('sum(amount)')}, NULL, NULL FROM moved GROUP BY user_id""",
         "C7/F15/F24: ledger rows of accepted manual changes and the balances after them")(_adjust_rows)


def _registered_rows(T):
    requests = _register_requests(T)
    effects = C.register_effects(T, requests, C.register_users(T, requests))
    none = lambda t: F.lit(None).cast(t)                                          # noqa: E731
    return (effects["users"].select(F.lit("user").alias("row_kind"), "id", "name", "email", "role", "is_active", "created_at", "updated_at",
                                    none("double").alias("amount"))
            .unionByName(effects["balances"].select(
                F.lit("balance").alias("row_kind"), F.col("user_id").alias("id"), none("string").alias("name"), none("string").alias("email"),
                none("string").alias("role"), none("boolean").alias("is_active"), none("timestamp").alias("created_at"),
                none("timestamp").alias("updated_at"), money("amount").alias("amount"))))


register("register_users_effects", f"""
WITH done AS (SELECT *, {_UUID.format('request_id')} AS new_id,
                     timestamp '2001-08-01 00:00:00' + INTERVAL 1 SECOND * cast(request_id[2:]::bigint % 1000 as int) AS ts
              FROM ({_register_sql()}) q WHERE status = 'accepted')
SELECT 'user' AS row_kind, new_id AS id, name, email, role, true AS is_active, ts AS created_at, ts AS updated_at, NULL AS amount FROM done
UNION ALL SELECT 'balance', user_id, NULL, NULL, NULL, NULL, NULL, NULL, {M('amount')} FROM m_balances
UNION ALL SELECT 'balance', new_id, NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM done""",
         "C11a/C15/F24: users of accepted registrations, and balances with theirs at zero")(_registered_rows)


def _order_rows(T):
    e = C.place_orders_effects(T, T["req_orders"], C.place_orders(T, T["req_orders"]))
    kind = lambda k: F.lit(k).alias("row_kind")                                   # noqa: E731
    parts = [
        e["orders"].select(kind("order"), "id", "service_id", F.col("customer_id").alias("user_id"), F.col("executor_id").alias("other_id"),
                           "status", money("total_price").alias("amount"), "deadline_date", F.col("requirements").alias("body"), "created_at"),
        e["transactions"].select(kind("payment"), "id", "user_id", F.col("type").alias("status"), money("amount").alias("amount"),
                                 F.col("description").alias("body"), "created_at"),
        e["notifications"].select(kind("notification"), "id", "user_id", F.col("type").alias("status"), "title", "body", "data", "created_at"),
        e["balances"].select(kind("balance"), "user_id", money("amount").alias("amount")),
        e["services"].select(kind("counter"), F.col("id").alias("service_id"), F.col("orders_count").cast("double").alias("amount"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


register("place_orders_effects", f"""
WITH settled AS ({REGISTRY['place_orders'].sql}),
done AS (SELECT r.*, s.price, s.title AS offer, s.deadline, s.executor_id, {_UUID.format('r.request_id')} AS new_id
         FROM m_req_orders r JOIN settled USING (request_id) JOIN m_services s ON s.id = r.service_id WHERE settled.status = 'accepted'),
purse AS (SELECT user_id, amount FROM m_balances UNION ALL SELECT customer_id, -price FROM done),
sold AS (SELECT id, orders_count AS n FROM m_services UNION ALL SELECT service_id, 1 FROM done)
SELECT 'order' AS row_kind, new_id AS id, service_id, customer_id AS user_id, executor_id AS other_id, 'created' AS status,
       {M('price')} AS amount, cast(ts as date) + deadline AS deadline_date, requirements AS body, NULL AS title, NULL AS data, ts AS created_at FROM done
UNION ALL BY NAME SELECT 'payment' AS row_kind, 'tx-' || new_id AS id, customer_id AS user_id, 'payment' AS status, {M('price')} AS amount,
       'Оплата заказа: ' || offer AS body, ts AS created_at FROM done
UNION ALL BY NAME SELECT 'notification' AS row_kind, 'nt-' || new_id AS id, executor_id AS user_id, 'order_created' AS status,
       '📦 Новый заказ!' AS title, 'Заказ на «' || offer || '»' AS body, '{{"order_id":"' || new_id || '"}}' AS data, ts AS created_at FROM done
UNION ALL BY NAME SELECT 'balance' AS row_kind, user_id, {M('sum(amount)')} AS amount FROM purse GROUP BY user_id
UNION ALL BY NAME SELECT 'counter' AS row_kind, id AS service_id, sum(n)::double AS amount FROM sold GROUP BY id""",
         "C1/F2/F13/F24: orders, payments and notifications of accepted requests, balances and counters after them")(_order_rows)

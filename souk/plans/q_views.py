"""Registered list and lookup queries (J, L, P rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from souk.operators import pages as P
from souk.operators import views as V
from souk.plans.registry import money_sql as M, register
from souk.session import checkpoint_dir

# A service with its seller and category, as one relation.
_OFFER = f"""
SELECT offer.id, offer.title, {M('offer.price')} AS price, offer.deadline, offer.is_negotiable,
       offer.rating::double AS rating, offer.reviews_count, offer.orders_count, offer.tags, offer.is_active,
       offer.created_at, offer.description, seller.executor_id, seller.executor_name, seller.executor_bio,
       seller.executor_since, seller.seller_active, seller.seller_role, kind.category_id, kind.category_name, kind.category_slug
FROM m_services offer
INNER JOIN (SELECT id AS executor_id, name AS executor_name, bio AS executor_bio, created_at AS executor_since,
                   is_active AS seller_active, role AS seller_role FROM m_users) seller USING (executor_id)
INNER JOIN (SELECT id AS category_id, name AS category_name, slug AS category_slug FROM m_categories) kind USING (category_id)"""

_CATALOG_SELECT = f"""
SELECT * EXCLUDE (description, executor_bio, executor_since, seller_active, seller_role) FROM ({_OFFER})
WHERE is_active AND seller_active
  AND executor_id NOT IN (SELECT user_id FROM m_profiles WHERE availability <> 'available')"""

register("catalog", _CATALOG_SELECT, "J1/P4/L1: every visible service, newest first")(
    lambda T: V.catalog(T))

SEARCH = dict(category="small", search="R_N", min_price=900, max_price=1500, sort="price_asc")
register("catalog_search", _CATALOG_SELECT + """
  AND category_slug = 'small' AND price BETWEEN 900 AND 1500
  AND (concat_ws(chr(10), title, description) ILIKE '%R_N%'
       OR len(list_filter(json_extract_string(tags, '$[*]'), lambda t: t LIKE '%R_N%')) > 0)""",
         "J1 with P3/P5/P6/P7: category, price bounds, wildcard search, tag search")(
    lambda T: V.catalog(T, **SEARCH))

register("top_services", _CATALOG_SELECT + """
ORDER BY rating DESC, reviews_count DESC, id LIMIT 4""", "L3: four best visible services")(
    lambda T: V.top_services(T, 4))

register("categories_sorted", "SELECT id, name, slug, icon, description, sort_order FROM m_categories",
         "L4: categories by sort order")(lambda T: V.categories_sorted(T))

_ORDERS_ENRICHED = f"""
WITH person AS (SELECT id, name, email FROM m_users)
SELECT deal.* EXCLUDE (total_price), {M('deal.total_price')} AS total_price, offer.title AS service_title,
       {M('offer.price')} AS service_price, buyer.name AS customer_name, buyer.email AS customer_email,
       seller.name AS executor_name, seller.email AS executor_email
FROM (SELECT id, service_id, customer_id, executor_id, status, total_price, deadline_date, requirements,
             created_at, updated_at FROM m_orders) deal
INNER JOIN m_services offer ON deal.service_id = offer.id
INNER JOIN person buyer ON deal.customer_id = buyer.id
INNER JOIN person seller ON deal.executor_id = seller.id"""

register("orders_enriched", _ORDERS_ENRICHED, "J2: every order with service and participants")(
    lambda T: V.orders_enriched(T))

register("orders_for_role", f"""
SELECT v.id AS viewer_id, v.role AS viewer_role, e.*
FROM m_users v JOIN ({_ORDERS_ENRICHED}) e
  ON (CASE WHEN v.role = 'customer' THEN e.customer_id ELSE e.executor_id END) = v.id""",
         "P10: order list per viewer, side chosen by role")(lambda T: V.orders_for_role(T))

register("orders_for_role_status", f"""
SELECT v.id AS viewer_id, v.role AS viewer_role, e.*
FROM m_users v JOIN ({_ORDERS_ENRICHED}) e
  ON v.id = if(v.role = 'customer', e.customer_id, e.executor_id) AND e.status = 'review'""",
         "P3/P10: the same list, one status only")(lambda T: V.orders_for_role(T, "review"))

register("order_detail", f"""
SELECT e.*,
       (SELECT count(*) FROM m_messages m WHERE m.order_id = e.id) AS messages_count,
       (SELECT max(m.created_at) FROM m_messages m WHERE m.order_id = e.id) AS last_message_at,
       (SELECT count(*) FROM m_status_log l WHERE l.order_id = e.id) AS status_changes,
       (SELECT max(l.created_at) FROM m_status_log l WHERE l.order_id = e.id) AS last_change_at
FROM ({_ORDERS_ENRICHED}) e""", "J3: order header with thread and log sizes")(
    lambda T: V.order_detail(T))

register("reviews_enriched", """
SELECT r.*, u.name AS customer_name, s.title AS service_title
FROM m_reviews r JOIN m_users u ON u.id = r.customer_id JOIN m_services s ON s.id = r.service_id""",
         "J4: reviews with customer name and service title")(lambda T: V.reviews_enriched(T))

register("messages_enriched", """
SELECT m.*, u.name AS sender_name, u.role AS sender_role
FROM m_messages m JOIN m_users u ON u.id = m.sender_id""",
         "J5: chat lines with sender")(lambda T: V.messages_enriched(T))

register("users_with_balance", f"""
SELECT u.id, u.name, u.email, u.role, u.is_active, u.created_at,
       {M('coalesce(b.amount, 0)')} AS balance
FROM m_users u LEFT JOIN m_balances b ON b.user_id = u.id""",
         "J6: users with balance, missing = 0")(lambda T: V.users_with_balance(T))

register("transactions_enriched", f"""
SELECT t.id, t.user_id, t.order_id, t.type, {M('t.amount')} AS amount, t.created_at,
       u.name AS user_name, u.email AS user_email
FROM m_transactions t JOIN m_users u ON u.id = t.user_id""",
         "J7: ledger rows with user")(lambda T: V.transactions_enriched(T))

register("list_services", f"""
SELECT offer.* EXCLUDE (price, rating), {M('offer.price')} AS price, offer.rating::double AS rating,
       seller.name AS executor_name, seller.email AS executor_email, kind.name AS category_name
FROM m_services offer, m_users seller, m_categories kind
WHERE seller.id = offer.executor_id AND kind.id = offer.category_id
  AND concat_ws(chr(10), offer.title, seller.name) ILIKE '%Brand#1%'""",
         "J8: admin service list with search")(lambda T: V.list_services(T, search="Brand#1"))

register("user_order_counts", """
SELECT u.id AS user_id,
       (SELECT count(*) FROM m_orders o WHERE o.customer_id = u.id OR o.executor_id = u.id) AS orders_count
FROM m_users u
WHERE EXISTS (SELECT 1 FROM m_orders o WHERE o.customer_id = u.id OR o.executor_id = u.id)""",
         "J14: orders per user as customer or executor")(lambda T: V.user_order_counts(T))

register("user_service_counts", """
SELECT executor_id AS user_id, count(*) AS services_count FROM m_services GROUP BY executor_id""",
         "A15: services per user")(lambda T: V.user_service_counts(T))

register("list_users", f"""
WITH side AS (SELECT id, count(*) AS n_orders
              FROM (SELECT unnest(list_distinct([customer_id, executor_id])) AS id FROM m_orders) GROUP BY ALL),
sells AS (SELECT executor_id AS id, count(*) AS n_services FROM m_services GROUP BY ALL)
SELECT person.id, name, email, role, is_active, created_at, {M('ifnull(amount, 0)')} AS balance,
       ifnull(n_orders, 0) AS orders_count, ifnull(n_services, 0) AS services_count
FROM m_users person LEFT JOIN side USING (id) LEFT JOIN sells USING (id)
LEFT JOIN (SELECT user_id AS id, amount FROM m_balances) purse USING (id)
WHERE is_active AND concat_ws(chr(10), name, email) ILIKE '%00%'""",
         "P13: admin user list, active users matching a search")(
    lambda T: V.list_users(T, status="active", search="00"))

_CARD = """
done AS (SELECT executor_id, count(*) AS n_done FROM m_orders WHERE status = 'completed' GROUP BY ALL),
rated AS (SELECT executor_id, count(*) AS n_rated, avg(rating) AS mean_rating FROM m_reviews GROUP BY ALL),
shown AS (SELECT executor_id, count(*) AS n_open FROM m_services WHERE is_active GROUP BY ALL),
card AS (
  SELECT executor_id, ifnull(n_done, 0) AS executor_completed, ifnull(n_rated, 0) AS executor_reviews,
         round(ifnull(mean_rating, 0), 6) AS executor_rating, ifnull(n_open, 0) AS executor_services
  FROM (SELECT id AS executor_id FROM m_users WHERE role = 'executor')
  LEFT JOIN done USING (executor_id) LEFT JOIN rated USING (executor_id) LEFT JOIN shown USING (executor_id))"""

register("executor_card", f"WITH {_CARD} FROM card", "A8: service-card executor numbers")(
    lambda T: V.executor_card(T))

register("service_detail", f"""
WITH {_CARD}
SELECT offer.* EXCLUDE (seller_active, seller_role), about.availability, about.specialization,
       {M('about.hourly_rate')} AS hourly_rate, about.response_time, card.* EXCLUDE (executor_id)
FROM ({_OFFER}) offer INNER JOIN card USING (executor_id)
LEFT JOIN m_profiles about ON about.user_id = offer.executor_id""", "J15: service page with executor numbers and profile")(
    lambda T: V.service_detail(T))

register("public_users", """
SELECT id, name, bio, role, created_at FROM m_users WHERE is_active""",
         "P2: public profiles of active users (no e-mail, no secrets)")(lambda T: V.public_users(T["users"]))

register("status_history", """
SELECT order_id, old_status, new_status, changed_by, created_at FROM m_status_log""",
         "J3 (log part): every order's status changes")(
    lambda T: V.status_history(T).select("order_id", "old_status", "new_status", "changed_by", "created_at"))

register("catalog_page", _CATALOG_SELECT + """
ORDER BY price DESC, id LIMIT 12 OFFSET 12""", "L2: second catalogue page, most expensive first")(
    lambda T: V.catalog_page(T, page=2, limit=12, sort="price_desc", with_total=False).rows)


def _sorted_pages(T):
    out = None
    for sort in V.SORTS:
        b = P.page_boundaries(V.catalog_filter(T).select(*V.catalog_cols()).select("id", *SORT_KEYS), V.sort_columns(sort), 12)
        b = b.withColumn("sort", F.lit(sort))
        out = b if out is None else out.unionByName(b)
    return out


SORT_KEYS = ["created_at", "rating", "reviews_count", "price"]
_RANKED = " UNION ALL ".join(
    f"SELECT '{name}' AS sort, id, row_number() OVER (ORDER BY {keys}, id) AS place FROM shown" for name, keys in (
        ("newest", "created_at DESC"), ("rating", "rating DESC, reviews_count DESC"), ("price_asc", "price"), ("price_desc", "price DESC")))

register("catalog_page_boundaries", f"""
WITH shown AS ({_CATALOG_SELECT}), ranked AS ({_RANKED})
SELECT sort, (place + 11) // 12 AS page, count(*) AS n_rows, arg_min(id, place) AS first_id, arg_max(id, place) AS last_id
FROM ranked GROUP BY ALL""", "L1/L2: first and last service of every page in each of the four sorts")(_sorted_pages)


def _last_pages(T):
    """Page 1, the one in the middle and the last one of the admin list of services, through the page index."""
    path = f"{checkpoint_dir(T['services'].sparkSession).rstrip('/')}/page-index-{uuid.uuid4().hex}"
    index = P.build_page_index(V.list_services(T), [F.col("created_at").desc(), F.col("id")], path, block_rows=1000)
    last = index.page(1, 20).pages
    out = None
    for p in dict.fromkeys((1, (last + 1) // 2, last, last + 1)):
        rows = index.page(p, 20, 20, 100).rows.select(F.lit(p).cast("long").alias("page"), F.lit(index.total).cast("long").alias("total"),
                                                      "id", "title", "executor_name", "created_at")
        out = rows if out is None else out.unionByName(rows)
    return out


register("service_list_deep_pages", """
WITH listed AS (
  SELECT offer.id, offer.title, seller.name AS executor_name, offer.created_at
  FROM m_services offer JOIN m_users seller ON seller.id = offer.executor_id JOIN m_categories kind ON kind.id = offer.category_id),
placed AS (SELECT *, (row_number() OVER (ORDER BY created_at DESC, id) + 19) // 20 AS page, count(*) OVER () AS total FROM listed)
SELECT page, total, id, title, executor_name, created_at FROM placed
WHERE page IN (1, ((total + 19) // 20 + 1) // 2, (total + 19) // 20)""",
         "L2/J8: first, middle and last page read by position from the page index")(_last_pages)

_ITEM = "array_join(transform(items, i -> concat_ws('|', {})), '\n')"

register("order_threads", f"""
WITH line AS (
  SELECT m.*, u.name AS sender_name, row_number() OVER (PARTITION BY order_id ORDER BY m.created_at, m.id) AS place
  FROM m_messages m JOIN m_users u ON u.id = m.sender_id),
change AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY created_at, new_status) AS place FROM m_status_log)
SELECT 'messages' AS part, order_id, (place + 2) // 3 AS page, count(*) AS n_rows,
       string_agg(concat_ws('|', id, sender_name, is_read::varchar, message), chr(10) ORDER BY place) AS items FROM line GROUP BY ALL
UNION ALL
SELECT 'status_log', order_id, (place + 1) // 2, count(*),
       string_agg(concat_ws('|', old_status, new_status, changed_by), chr(10) ORDER BY place) FROM change GROUP BY ALL""",
         "J3/S8: thread and status log of every order in numbered pages (of three lines, of two changes)")(
    lambda T: P.thread_pages(T, 3).select(
        F.lit("messages").alias("part"), "order_id", "page", "n_rows",
        F.expr(_ITEM.format("i.id, i.sender_name, cast(i.is_read as string), i.message")).alias("items"))
    .unionByName(P.log_pages(T, 2).select(
        F.lit("status_log").alias("part"), "order_id", "page", "n_rows",
        F.expr(_ITEM.format("i.old_status, i.new_status, i.changed_by")).alias("items"))))

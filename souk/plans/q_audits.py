"""Registered audits and data-quality checks (Q rows, C10a)."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.functions.predicates import money
from souk.operators import audits as Q
from souk.operators import changes as C
from souk.plans.registry import TRIMMED, money_sql as M, register

_T = {"users": "m_users", "categories": "m_categories", "services": "m_services", "orders": "m_orders",
      "messages": "m_messages", "reviews": "m_reviews", "balances": "m_balances",
      "transactions": "m_transactions", "notifications": "m_notifications", "profiles": "m_profiles",
      "status_log": "m_status_log"}


def _dup_sql() -> str:
    parts = [f"SELECT '{t}' AS table_name, '{k}' AS key_name, cast({k} as varchar) AS key_value, count(*) AS n "
             f"FROM {_T[t]} GROUP BY {k} HAVING count(*) > 1" for t, k in Q.UNIQUE_KEYS]
    return "\nUNION ALL ".join(parts)


register("duplicate_keys", _dup_sql(), "Q1: unique-key duplicates over all declared keys")(
    lambda T: Q.all_duplicate_keys(T))


def _orphans_sql() -> str:
    parts = []
    for name, child, col, parent, key in Q.FOREIGN_KEYS:
        parts.append(f"SELECT '{name}' AS fk, cast({key} as varchar) AS row_key, cast(c.{col} as varchar) AS ref "
                     f"FROM {_T[child]} c WHERE c.{col} IS NOT NULL AND NOT EXISTS "
                     f"(SELECT 1 FROM {_T[parent]} p WHERE cast(p.id as varchar) = cast(c.{col} as varchar))")
    return "\nUNION ALL ".join(parts)


register("orphans", _orphans_sql(), "Q2: child rows whose foreign key has no parent")(lambda T: Q.orphans(T))


def _nulls_sql() -> str:
    parts = []
    for table, cols in Q.NOT_NULL.items():
        for c in cols:
            parts.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name, "
                         f"count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM {_T[table]}")
    return "\nUNION ALL ".join(parts)


register("null_violations", _nulls_sql(), "Q3: null counts of NOT NULL columns")(
    lambda T: Q.null_violations(T))


def _domain_sql() -> str:
    parts = []
    for table, col, allowed in Q.DOMAINS:
        vals = ", ".join(f"'{v}'" for v in allowed)
        key = Q.ROW_KEY.get(table, "id")
        parts.append(f"SELECT '{table}' AS table_name, '{col}' AS column_name, cast({key} as varchar) AS row_key, "
                     f"cast({col} as varchar) AS value FROM {_T[table]} WHERE {col} IS NOT NULL AND {col} NOT IN ({vals})")
    parts.append("SELECT 'reviews', 'rating', id, cast(rating as varchar) FROM m_reviews "
                 "WHERE NOT (rating BETWEEN 1 AND 5)")
    return "\nUNION ALL ".join(parts)


register("domain_violations", _domain_sql(), "Q4: values outside enumerated domains")(
    lambda T: Q.domain_violations(T))

_SPELLINGS = """SELECT email FROM m_users
UNION ALL SELECT upper(email) FROM m_users WHERE cast(substring(id, 2) as bigint) % 4 = 0
UNION ALL SELECT replace(email, 'e', 'é') FROM m_users WHERE cast(substring(id, 2) as bigint) % 6 = 0"""


def _spellings(T):
    """All e-mails, some again in upper case or with accents (rows that a unique key would refuse)."""
    u, k = T["users"], F.expr("cast(substring(id, 2) as bigint)")
    return (u.select("email").unionByName(u.filter(k % 4 == 0).select(F.upper("email").alias("email")))
            .unionByName(u.filter(k % 6 == 0).select(F.expr("replace(email, 'e', 'é')").alias("email"))))


register("duplicate_emails", f"""
SELECT min(lower(email)) AS key_value, count(*) AS n, count(DISTINCT email) AS spellings
FROM ({_SPELLINGS}) s GROUP BY strip_accents(lower(email)) HAVING count(*) > 1""",
         "Q1/D1: e-mails that are equal but for case and accents")(lambda T: Q.duplicate_texts(_spellings(T), "email"))

_SERVICE_ERRORS = """array_to_string(list_filter([
    CASE WHEN coalesce(length(trim({title})), 0) < 10 THEN 'title' END,
    CASE WHEN coalesce(length(trim({description})), 0) < 30 THEN 'description' END,
    CASE WHEN NOT coalesce({price} > 0 AND {price} <= 500000, false) THEN 'price' END,
    CASE WHEN NOT coalesce({deadline} > 0 AND {deadline} <= 180, false) THEN 'deadline' END,
    CASE WHEN {category} IS NULL THEN 'category' END], lambda e: e IS NOT NULL), ',')"""

register("validate_services", f"""
SELECT id, {_SERVICE_ERRORS.format(title='title', description='description', price='price',
                                   deadline='deadline', category='category_id')} AS errors,
       {_SERVICE_ERRORS.format(title='title', description='description', price='price',
                               deadline='deadline', category='category_id')} = '' AS is_valid
FROM m_services""", "Q5: service input rules over the catalogue")(
    lambda T: Q.validate_services(T["services"]))


def _create_requests(T):
    p = T.raw["part"]
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("n"), k.cast("string")).alias("request_id"),
        F.lit("2001-08-02 00:00:00").cast("timestamp").alias("ts"),
        F.concat(F.lit("s"), F.floor(k / 20).cast("bigint").cast("string")).alias("actor_id"),
        F.when(k % 3 == 0, F.col("p_type")).otherwise(F.lit(None)).cast("string").alias("p_type"),
        F.when(k % 8 != 1, F.lit(6)).cast("int").alias("category_id"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("new offer "), F.col("p_name"), F.lit(" by "), F.col("p_brand")).alias("description"),
        (F.col("p_retailprice") - F.when(k % 3 == 0, 1000).otherwise(0)).cast("decimal(12,2)").alias("price"),
        (F.col("p_size") * 4).alias("deadline"),
        F.lit(None).cast("string").alias("tags"), F.lit(None).cast("boolean").alias("is_negotiable"))


register("create_services", """
SELECT 'n' || cast(p_partkey as varchar) AS request_id, 's' || cast(cast(floor(p_partkey / 20) as bigint) as varchar) AS executor_id,
  CASE WHEN p_partkey % 8 <> 1 THEN 6 END AS category_id, p_name AS title,
  CASE WHEN """ + _SERVICE_ERRORS.format(
    title="p_name", description="'new offer ' || p_name || ' by ' || p_brand",
    price="cast(p_retailprice - if(p_partkey % 3 = 0, 1000, 0) as decimal(12,2))", deadline="p_size * 4",
    category="CASE WHEN p_partkey % 8 <> 1 THEN 6 END") + """ = '' THEN 'accepted' ELSE 'rejected' END AS status,
  """ + _SERVICE_ERRORS.format(
    title="p_name", description="'new offer ' || p_name || ' by ' || p_brand",
    price="cast(p_retailprice - if(p_partkey % 3 = 0, 1000, 0) as decimal(12,2))", deadline="p_size * 4",
    category="CASE WHEN p_partkey % 8 <> 1 THEN 6 END") + """ AS errors
FROM part""", "C10a/Q5: new services checked by the input rules")(
    lambda T: C.create_services(T, _create_requests(T)).select(
        "request_id", "executor_id", "category_id", "title", "status", "errors"))


_EMAIL_OK = """(regexp_full_match(lower(trim(email)), '[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{2,}')
  AND NOT regexp_full_match(regexp_replace(split_part(lower(trim(email)), '@', -1), '\\.[^.]*$', ''), '[0-9]+')
  AND len(list_filter(['gmail.com','googlemail.com','mail.ru','bk.ru','inbox.ru','list.ru','yandex.ru',
     'yandex.com','ya.ru','icloud.com','me.com','mac.com','outlook.com','hotmail.com','live.com','msn.com',
     'yahoo.com','yahoo.ru','proton.me','protonmail.com','rambler.ru','rambler.com','vk.com','internet.ru',
     'corp.mail.ru','tut.by','mail.com','email.com'],
     lambda d: split_part(lower(trim(email)), '@', -1) = d
               OR ends_with(split_part(lower(trim(email)), '@', -1), '.' || d))) > 0)"""

register("validate_emails", f"SELECT id, email, coalesce({_EMAIL_OK}, false) AS email_ok FROM m_users",
         "Q6: e-mail acceptance rules")(lambda T: Q.validate_emails(T["users"]))

_NL = "[chr(10), chr(13), chr(8232), chr(8233)]"
_SPACE = ("[^\\t\\n\\x{0B}\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}"
          "\\x{3000}\\x{FEFF}]")

register("screen_texts", f"""
SELECT doc_id, field,
  CASE WHEN body IS NULL OR length(body) = 0 THEN NULL
       WHEN length(body) > CASE field WHEN 'title' THEN 200 WHEN 'description' THEN 5000
                                      WHEN 'message' THEN 2000 END THEN 'too_long'
       WHEN len(list_filter(range(1, length(body) - 5), lambda i:
              NOT list_contains({_NL}, substr(body, i, 1))
              AND lower(substr(body, i, 7)) = lower(repeat(substr(body, i, 1), 7)))) > 0 THEN 'repeat'
       WHEN regexp_matches(body, 'https?://{_SPACE}{{3,}}', 'i') THEN 'link'
       WHEN regexp_matches(body, '(^|[^A-Za-z0-9_])(casino|poker|xxx|porn|viagra|crypto|nft|airdrop|pump)($|[^A-Za-z0-9_])', 'i')
            THEN 'stop_word'
       WHEN regexp_matches(body, '[^\\x00-\\x7F]{{50,}}') THEN 'non_ascii' END AS reason
FROM m_texts""", "Q7/T7: text screening, first failing rule")(lambda T: Q.screen_texts(T["texts"]))

register("validate_requests", rf"""
SELECT 'review' AS kind, request_id,
  CASE WHEN NOT coalesce(rating BETWEEN 1 AND 5, false) THEN 'rating'
       WHEN coalesce(length({TRIMMED('comment')}), 0) > 1000 THEN 'comment' END AS reason FROM m_req_reviews
UNION ALL
SELECT 'deposit', request_id, CASE WHEN NOT coalesce(amount > 99, false) THEN 'amount' END FROM m_req_deposits
UNION ALL
SELECT 'message', request_id,
  CASE WHEN coalesce(length({TRIMMED('message')}), 0) NOT BETWEEN 1 AND 2000 THEN 'message' END FROM m_req_messages""",
         "Q8: input rules of review, deposit and message requests")(
    lambda T: Q.validate_requests(T["req_reviews"], "review").select(F.lit("review").alias("kind"), "request_id", "reason")
    .unionByName(Q.validate_requests(T["req_deposits"], "deposit").select(F.lit("deposit").alias("kind"), "request_id", "reason"))
    .unionByName(Q.validate_requests(T["req_messages"], "message").select(F.lit("message").alias("kind"), "request_id", "reason")))

register("refund_anomalies", f"""
SELECT o.id, {M('o.total_price')} AS total_price, o.status, o.updated_at
FROM (SELECT id FROM m_orders WHERE status = 'cancelled' AND total_price > 0
      EXCEPT SELECT order_id FROM m_transactions WHERE type = 'deposit') unpaid
INNER JOIN m_orders o USING (id)
QUALIFY row_number() OVER (ORDER BY o.id) <= 20""", "Q9: cancelled orders without a refund, first 20")(lambda T: Q.refund_anomalies(T))

register("balance_discrepancies", f"""
WITH moves AS (
  SELECT user_id, amount AS booked, 0 AS held FROM m_transactions WHERE type = 'deposit'
  UNION ALL SELECT user_id, -amount, 0 FROM m_transactions WHERE type IN ('payment', 'withdrawal')
  UNION ALL SELECT user_id, 0, amount FROM m_balances),
per AS (SELECT user_id, sum(booked) AS booked, sum(held) AS held FROM moves GROUP BY user_id)
SELECT user_id, {M('booked')} AS calculated, {M('held')} AS actual, {M('greatest(booked, 0)')} AS corrected
FROM per WHERE abs(booked - held) > 0.01 AND user_id IN (SELECT id FROM m_users WHERE is_active)""",
         "Q10: stored balance vs ledger")(
    lambda T: Q.balance_discrepancies(T).select("user_id", money("calculated").alias("calculated"),
                                                money("actual").alias("actual"), money("corrected").alias("corrected")))

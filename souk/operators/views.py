"""Enriched lists and lookups.

Every function takes the table mapping ``T`` (see ``souk.sources.fixtures``)
and returns a DataFrame over *all* keys; the reference's per-id handlers are
a ``filter`` on the result. Joins are equi-joins on ids: Catalyst picks the
strategy and AQE turns a join into a broadcast only after measuring the
small side at run time (``spark.sql.autoBroadcastJoinThreshold``), so no
side is broadcast on faith.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.predicates import (
    money, order_participants, price_bounds, search_cond, search_tags_cond, where_all)


# ----------------------------------------------------------------------------- P2
# Columns never shown (secrets) and the public profile columns.
SECRET_COLUMNS = ("password_hash",)
PUBLIC_USER_COLUMNS = ("id", "name", "avatar", "bio", "role", "created_at")


def private_users(users: DataFrame) -> DataFrame:
    """What a user sees of their own row: everything but secrets."""
    return users.drop(*SECRET_COLUMNS)


def public_users(users: DataFrame) -> DataFrame:
    """Public profiles: active users only, no e-mail, no secrets."""
    return users.filter(F.col("is_active")).select(*[c for c in PUBLIC_USER_COLUMNS if c in users.columns])


# ----------------------------------------------------------------------------- P4
def visibility_cond(svc: str = "s", usr: str = "u", prof: str = "ep") -> Column:
    """Service active, executor active, no profile or profile 'available'."""
    return (F.col(f"{svc}.is_active") & F.col(f"{usr}.is_active")
            & (F.col(f"{prof}.availability").isNull() | (F.col(f"{prof}.availability") == "available")))


def _service_frame(T) -> DataFrame:
    """services s ⋈ users u ⋈ categories c ⟕ profiles ep (the catalogue's FROM)."""
    s = T["services"].alias("s")
    u = T["users"].select("id", "name", "is_active", "bio", "created_at").alias("u")
    c = T["categories"].alias("c")
    ep = T["profiles"].alias("ep")
    return (s.join(u, F.col("u.id") == F.col("s.executor_id"))
            .join(c, F.col("c.id") == F.col("s.category_id"))
            .join(ep, F.col("ep.user_id") == F.col("s.executor_id"), "left"))


def visible_services(T) -> DataFrame:
    return _service_frame(T).filter(visibility_cond())


# ----------------------------------------------------------------------------- L1
# Named catalogue orders; unknown names fall back to newest.
SORTS = {
    "newest": [("created_at", "desc")],
    "rating": [("rating", "desc"), ("reviews_count", "desc")],
    "price_asc": [("price", "asc")],
    "price_desc": [("price", "desc")],
}


def sort_columns(sort: str | None, key: str = "id") -> list[Column]:
    """Order for a named sort, with the primary key appended for a total order."""
    spec = SORTS.get(sort or "newest", SORTS["newest"])
    cols = [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in spec]
    return cols + [F.col(key).asc()]


def sort_services(df: DataFrame, sort: str | None) -> DataFrame:
    return df.orderBy(*sort_columns(sort))


# ----------------------------------------------------------------------------- L2
@dataclass
class Page:
    rows: DataFrame
    total: int
    page: int
    limit: int

    @property
    def pages(self) -> int:
        return math.ceil(self.total / self.limit) if self.limit else 0


def clamp_page(page, limit, default_limit: int, max_limit: int) -> tuple[int, int]:
    """page ≥ 1; limit falls back to the default when absent/0 and is capped."""
    try:
        p = max(1, int(page or 1))
    except (TypeError, ValueError):
        p = 1
    try:
        lim = int(limit or 0) or default_limit
    except (TypeError, ValueError):
        lim = default_limit
    return p, min(max_limit, lim)


def paginate(df: DataFrame, order: list[Column], page=1, limit=None,
             default_limit: int = 12, max_limit: int = 50, with_total: bool = True) -> Page:
    """One page in a total order (``TakeOrderedAndProject``) plus the true total.

    The page and the total are two actions over the same filtered frame.
    """
    p, lim = clamp_page(page, limit, default_limit, max_limit)
    rows = df.orderBy(*order).offset((p - 1) * lim).limit(lim)
    total = df.count() if with_total else -1
    return Page(rows, total, p, lim)


# ----------------------------------------------------------------------------- J1
def catalog_cols() -> list[Column]:
    return [
    F.col("s.id").alias("id"), F.col("s.title").alias("title"), money("s.price").alias("price"),
    F.col("s.deadline").alias("deadline"), F.col("s.is_negotiable").alias("is_negotiable"),
    F.col("s.rating").cast("double").alias("rating"), F.col("s.reviews_count").alias("reviews_count"),
    F.col("s.orders_count").alias("orders_count"), F.col("s.tags").alias("tags"),
    F.col("s.is_active").alias("is_active"), F.col("s.created_at").alias("created_at"),
    F.col("u.id").alias("executor_id"), F.col("u.name").alias("executor_name"),
    F.col("c.id").alias("category_id"), F.col("c.name").alias("category_name"),
    F.col("c.slug").alias("category_slug"),
    ]


def catalog_filter(T, category=None, search=None, min_price=None, max_price=None) -> DataFrame:
    """The catalogue's WHERE: visibility, category slug, price bounds, search."""
    text = search_cond(["s.title", "s.description"], search)
    if text is not None:
        text = text | search_tags_cond(search, "s.tags")
    conds = [visibility_cond(),
             (F.col("c.slug") == category) if category else None,
             *price_bounds("s.price", min_price, max_price),
             text]
    return where_all(_service_frame(T), conds)


def catalog(T, category=None, search=None, min_price=None, max_price=None,
            sort="newest") -> DataFrame:
    """All visible catalogue rows in the requested order (J1 without paging)."""
    return (catalog_filter(T, category, search, min_price, max_price)
            .select(*catalog_cols()).orderBy(*sort_columns(sort)))


def catalog_page(T, page=1, limit=None, sort="newest", with_total: bool = True, **filters) -> Page:
    """J1 as the handler answers it: one page (default 12, max 50) and the total."""
    df = catalog_filter(T, **filters).select(*catalog_cols())
    return paginate(df, sort_columns(sort), page, limit, 12, 50, with_total)


# ----------------------------------------------------------------------------- L3 / L4
def top_services(T, n: int = 4) -> DataFrame:
    """Home-page pick: the n best visible services by rating (a top-k report)."""
    return catalog(T, sort="rating").limit(n)


def categories_sorted(T) -> DataFrame:
    return T["categories"].orderBy("sort_order", "id")


# ----------------------------------------------------------------------------- J2 / J3
def orders_enriched(T) -> DataFrame:
    """Every order with its service title and both participants' names."""
    o = T["orders"].alias("o")
    s = T["services"].select("id", "title", "price").alias("s")
    cu = T["users"].select("id", "name", "email").alias("cu")
    ex = T["users"].select("id", "name", "email").alias("ex")
    j = (o.join(s, F.col("s.id") == F.col("o.service_id"))
         .join(cu, F.col("cu.id") == F.col("o.customer_id"))
         .join(ex, F.col("ex.id") == F.col("o.executor_id")))
    return j.select(
        "o.id", "o.service_id", "o.customer_id", "o.executor_id", "o.status",
        money("o.total_price").alias("total_price"), "o.deadline_date", "o.requirements",
        "o.created_at", "o.updated_at",
        F.col("s.title").alias("service_title"), money("s.price").alias("service_price"),
        F.col("cu.name").alias("customer_name"), F.col("cu.email").alias("customer_email"),
        F.col("ex.name").alias("executor_name"), F.col("ex.email").alias("executor_email"))


def orders_for_role(T, status: str | None = None) -> DataFrame:
    """P10: each user's order list, of one ``status`` if given (P3) — customers see orders
    they placed, all other roles the orders they execute. The orders are enriched once;
    each is offered to its two sides and joined to the viewers by id."""
    u = T["users"].select(F.col("id").alias("viewer_id"), F.col("role").alias("viewer_role"))
    o = orders_enriched(T)
    o = where_all(o, [F.col("status") == status if status else None])
    side = F.explode(F.array(F.struct(F.col("customer_id").alias("id"), F.lit(True).alias("buys")),
                             F.struct(F.col("executor_id").alias("id"), F.lit(False).alias("buys"))))
    o = o.withColumn("_side", side)
    j = u.join(o, (F.col("viewer_id") == F.col("_side.id"))
               & ((F.col("viewer_role") == "customer") == F.col("_side.buys")))
    return j.drop("_side")


def order_detail(T) -> DataFrame:
    """J3 header: J2 plus thread size, last message time and status-log size per order.

    The thread and the log themselves are ``messages_enriched`` and
    ``status_history`` rows keyed by order (not nested: one order's thread
    is unbounded, so it is never gathered into one row).
    """
    msg = T["messages"].groupBy("order_id").agg(
        F.count(F.lit(1)).alias("messages_count"), F.max("created_at").alias("last_message_at"))
    log = T["status_log"].groupBy("order_id").agg(
        F.count(F.lit(1)).alias("status_changes"), F.max("created_at").alias("last_change_at"))
    return (orders_enriched(T)
            .join(msg, F.col("id") == msg["order_id"], "left").drop("order_id")
            .join(log, F.col("id") == log["order_id"], "left").drop("order_id")
            .withColumn("messages_count", F.coalesce("messages_count", F.lit(0)))
            .withColumn("status_changes", F.coalesce("status_changes", F.lit(0))))


def status_history(T) -> DataFrame:
    """Status log rows of every order in time order (J3's log part)."""
    return T["status_log"].orderBy("order_id", "created_at", "new_status")


# ----------------------------------------------------------------------------- J4 / J5
def reviews_enriched(T, executor_id=None, service_id=None) -> DataFrame:
    r = T["reviews"].alias("r")
    u = T["users"].select("id", "name").alias("u")
    s = T["services"].select("id", "title").alias("s")
    j = (r.join(u, F.col("u.id") == F.col("r.customer_id"))
         .join(s, F.col("s.id") == F.col("r.service_id")))
    j = where_all(j, [(F.col("r.executor_id") == executor_id) if executor_id else None,
                      (F.col("r.service_id") == service_id) if service_id else None])
    return j.select("r.*", F.col("u.name").alias("customer_name"),
                    F.col("s.title").alias("service_title")).orderBy(
        F.col("created_at").desc(), F.col("id"))


def messages_enriched(T) -> DataFrame:
    """Every chat line with its sender's name, threads in ascending time."""
    m = T["messages"].alias("m")
    u = T["users"].select("id", "name", "role").alias("u")
    return (m.join(u, F.col("u.id") == F.col("m.sender_id"))
            .select("m.*", F.col("u.name").alias("sender_name"), F.col("u.role").alias("sender_role"))
            .orderBy("order_id", "created_at", "id"))


# ----------------------------------------------------------------------------- J6 / J7
def users_with_balance(T) -> DataFrame:
    """users ⟕ balances; a missing balance row reads as 0."""
    b = T["balances"].select(F.col("user_id"), F.col("amount"))
    return (T["users"].join(b, F.col("id") == F.col("user_id"), "left")
            .select("id", "name", "email", "role", "is_active", "created_at",
                    money(F.coalesce(F.col("amount"), F.lit(0))).alias("balance")))


def transactions_enriched(T) -> DataFrame:
    """Ledger rows with the user's name and e-mail, newest first (J7 without paging)."""
    t = T["transactions"].alias("t")
    u = T["users"].select("id", "name", "email").alias("u")
    return (t.join(u, F.col("u.id") == F.col("t.user_id"))
            .select("t.id", "t.user_id", "t.order_id", "t.type", money("t.amount").alias("amount"),
                    "t.created_at", F.col("u.name").alias("user_name"), F.col("u.email").alias("user_email"))
            .orderBy(F.col("created_at").desc(), F.col("id")))


# ----------------------------------------------------------------------------- J8
def list_services(T, search=None) -> DataFrame:
    """Admin service list: every service (active or not), search on title or executor name."""
    s = T["services"].alias("s")
    u = T["users"].select("id", "name", "email").alias("u")
    c = T["categories"].alias("c")
    j = (s.join(u, F.col("u.id") == F.col("s.executor_id"))
         .join(c, F.col("c.id") == F.col("s.category_id")))
    j = where_all(j, [search_cond(["s.title", "u.name"], search)])
    return j.select("s.id", "s.title", "s.description", "s.deadline", "s.tags", "s.reviews_count",
                    "s.is_negotiable", "s.category_id", money("s.price").alias("price"), "s.is_active",
                    F.col("s.rating").cast("double").alias("rating"), "s.orders_count", "s.created_at",
                    F.col("u.id").alias("executor_id"), F.col("u.name").alias("executor_name"),
                    F.col("u.email").alias("executor_email"), F.col("c.name").alias("category_name")
                    ).orderBy(F.col("created_at").desc(), F.col("id"))


# ----------------------------------------------------------------------------- J14 / A15 / P13
def user_order_counts(T) -> DataFrame:
    """Orders per user as customer **or** executor (one count per order)."""
    return order_participants(T["orders"]).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("orders_count"))


def user_service_counts(T) -> DataFrame:
    return T["services"].groupBy(F.col("executor_id").alias("user_id")).agg(
        F.count(F.lit(1)).alias("services_count"))


def list_users(T, role=None, status=None, search=None) -> DataFrame:
    """Admin user list: balance, orders and services per user; role/status/search filters."""
    u = users_with_balance(T)
    u = where_all(u, [
        (F.col("role") == role) if role else None,
        (~F.col("is_active")) if status == "blocked" else (F.col("is_active") if status == "active" else None),
        search_cond(["name", "email"], search),
    ])
    oc = user_order_counts(T).withColumnRenamed("user_id", "oc_user")
    sc = user_service_counts(T).withColumnRenamed("user_id", "sc_user")
    return (u.join(oc, F.col("id") == F.col("oc_user"), "left")
            .join(sc, F.col("id") == F.col("sc_user"), "left")
            .select("id", "name", "email", "role", "is_active", "created_at", "balance",
                    F.coalesce("orders_count", F.lit(0)).alias("orders_count"),
                    F.coalesce("services_count", F.lit(0)).alias("services_count"))
            .orderBy(F.col("created_at").desc(), F.col("id")))


# ----------------------------------------------------------------------------- J15 / A8
def executor_card(T) -> DataFrame:
    """Per executor: completed orders, reviews, average rating, active services."""
    o = T["orders"].filter(F.col("status") == "completed").groupBy("executor_id").agg(
        F.count(F.lit(1)).alias("executor_completed"))
    r = T["reviews"].groupBy(F.col("executor_id").alias("r_exec")).agg(
        F.count(F.lit(1)).alias("executor_reviews"), F.avg("rating").alias("executor_rating"))
    s = T["services"].filter(F.col("is_active")).groupBy(F.col("executor_id").alias("s_exec")).agg(
        F.count(F.lit(1)).alias("executor_services"))
    ex = T["users"].filter(F.col("role") == "executor").select(F.col("id").alias("executor_id"))
    return (ex.join(o, "executor_id", "left")
            .join(r, F.col("executor_id") == F.col("r_exec"), "left")
            .join(s, F.col("executor_id") == F.col("s_exec"), "left")
            .select("executor_id",
                    F.coalesce("executor_completed", F.lit(0)).alias("executor_completed"),
                    F.coalesce("executor_reviews", F.lit(0)).alias("executor_reviews"),
                    F.round(F.coalesce("executor_rating", F.lit(0.0)), 6).alias("executor_rating"),
                    F.coalesce("executor_services", F.lit(0)).alias("executor_services")))


def service_detail(T) -> DataFrame:
    """Service page rows: catalogue columns, description, executor bio/since, A8, profile."""
    card = executor_card(T).withColumnRenamed("executor_id", "card_exec")
    base = _service_frame(T).select(
        *catalog_cols(), F.col("s.description").alias("description"),
        F.col("u.bio").alias("executor_bio"), F.col("u.created_at").alias("executor_since"),
        F.col("ep.availability").alias("availability"), F.col("ep.specialization").alias("specialization"),
        money("ep.hourly_rate").alias("hourly_rate"), F.col("ep.response_time").alias("response_time"))
    return base.join(card, F.col("executor_id") == F.col("card_exec"), "left").drop("card_exec")


# ----------------------------------------------------------------------------- J16
def user_full(T) -> DataFrame:
    """User + executor profile (with derived level, skills, socials) + A7 numbers."""
    from souk.operators.changes import TEXT
    from souk.operators.reports import executor_stats
    from souk.functions.predicates import (availability_label, executor_level, known_socials,
                                           skill_percents)
    p = T["profiles"].alias("p")
    st = executor_stats(T).withColumnRenamed("executor_id", "st_exec")
    u = T["users"].select("id", "name", "email", "role", "bio", "is_active", "created_at")
    j = (u.join(p, F.col("id") == F.col("p.user_id"), "left")
         .join(st, F.col("id") == F.col("st_exec"), "left"))
    return j.select(
        "id", "name", "role", "bio", "is_active", "created_at",
        F.when(F.col("role") == "executor", availability_label(F.coalesce("p.availability", F.lit("available"))))
        .alias("availability"),
        F.col("p.specialization").alias("specialization"),
        money("p.hourly_rate").alias("hourly_rate"),
        F.coalesce(F.col("p.response_time"), F.lit(TEXT["default_response_time"])).alias("response_time"),
        F.array_join(F.transform(skill_percents("p.skills"),
                                 lambda k: F.concat_ws(":", k["name"], k["pct"].cast("string"))), ",")
        .alias("skills_text"),
        F.array_join(known_socials("p.socials"), ",").alias("socials_text"),
        F.col("services_count"), F.col("completed_orders"), F.col("avg_rating"), F.col("reviews_count"),
        F.when(F.col("role") == "executor", executor_level(F.coalesce("completed_orders", F.lit(0))))
        .alias("level"))


"""Column predicates and scalar rules.

Everything here returns a ``Column`` (or applies one) built from
``pyspark.sql.functions``: it stays inside whole-stage codegen and pushes
down to the parquet scan wherever the predicate allows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order states the reference treats as "in flight" / "closed".
ACTIVE_ORDER_STATES = ("created", "in_progress", "review")
CLOSED_ORDER_STATES = ("completed", "cancelled")


def ts_lit(ts) -> Column:
    """A timestamp literal (``as_of`` may be a string or a datetime)."""
    if isinstance(ts, Column):
        return ts
    return F.lit(ts).cast("timestamp") if isinstance(ts, str) else F.lit(ts)


# ----------------------------------------------------------------------------- P3
def where_all(df: DataFrame, conds: Iterable[Column | None]) -> DataFrame:
    """AND the given conditions; ``None`` entries (absent parameters) are skipped."""
    present = [c for c in conds if c is not None]
    if not present:
        return df
    return df.filter(functools.reduce(lambda a, b: a & b, present))


# ----------------------------------------------------------------------------- P5 / D7
def price_bounds(col: str | Column, lo=None, hi=None) -> list[Column | None]:
    """Inclusive bounds; ``None`` or 0 means no bound (the reference's truthiness test)."""
    c = F.col(col) if isinstance(col, str) else col
    return [c >= F.lit(lo) if lo else None, c <= F.lit(hi) if hi else None]


def price_between(df: DataFrame, lo=None, hi=None, col: str = "price") -> DataFrame:
    return where_all(df, price_bounds(col, lo, hi))


# ----------------------------------------------------------------------------- P6 / P7
def like_pattern(text: str) -> str:
    """``%text%`` with ``%`` and ``_`` in the text left as wildcards."""
    return f"%{text}%"


def search_cond(cols: Iterable[str], text: str | None, accent_insensitive: bool = False) -> Column | None:
    """OR of case-insensitive LIKE over ``cols`` (D1). ``None`` when no text."""
    if not text:
        return None
    if accent_insensitive:
        # wildcards are literal in this variant (contains on a CI_AI collation)
        conds = [F.contains(F.collate(F.col(c), "UNICODE_CI_AI"), F.lit(text)) for c in cols]
    else:
        conds = [F.col(c).ilike(like_pattern(text)) for c in cols]
    return functools.reduce(lambda a, b: a | b, conds)


def search(df: DataFrame, cols: Iterable[str], text: str | None) -> DataFrame:
    return where_all(df, [search_cond(cols, text)])


def tags_array(col: str | Column = "tags") -> Column:
    """JSON text array → array<string>; malformed text gives null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.from_json(c, "array<string>")


def search_tags_cond(text: str | None, col: str = "tags") -> Column | None:
    """Some tag matches ``%text%`` case-sensitively (D3: JSON text compares as binary)."""
    if not text:
        return None
    pat = like_pattern(text)
    return F.coalesce(F.exists(tags_array(col), lambda t: t.like(pat)), F.lit(False))


# ----------------------------------------------------------------------------- P8
def active_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status").isin(*ACTIVE_ORDER_STATES))


def open_orders(orders: DataFrame) -> DataFrame:
    """Orders a chat may still be written in (not completed/cancelled)."""
    return orders.filter(~F.col("status").isin(*CLOSED_ORDER_STATES))


# ----------------------------------------------------------------------------- P9
def orders_of_user(orders: DataFrame, user_id: str) -> DataFrame:
    return orders.filter((F.col("customer_id") == user_id) | (F.col("executor_id") == user_id))


def order_participants(orders: DataFrame) -> DataFrame:
    """One row per (order, participant): the all-users form of P9.

    ``array_distinct`` keeps a self-order (customer = executor) from
    counting twice; the result joins on ``user_id`` as an equi-join.
    """
    return orders.withColumn(
        "user_id", F.explode(F.array_distinct(F.array("customer_id", "executor_id"))))


# ----------------------------------------------------------------------------- P11 / P12 / F11 / F12
def since(col: str, as_of, n: int, unit: str = "DAY") -> Column:
    """``col >= as_of - INTERVAL n unit``."""
    return F.col(col) >= ts_lit(as_of) - F.expr(f"INTERVAL {int(n)} {unit}")


def older_than(col: str, as_of, n: int, unit: str = "DAY") -> Column:
    """``col < as_of - INTERVAL n unit`` (strict: the cut-off instant is kept)."""
    return F.col(col) < ts_lit(as_of) - F.expr(f"INTERVAL {int(n)} {unit}")


def on_day(col: str, as_of) -> Column:
    """Same calendar day as ``as_of``, as a half-open range so it pushes down."""
    day = F.to_date(ts_lit(as_of)).cast("timestamp")
    return (F.col(col) >= day) & (F.col(col) < day + F.expr("INTERVAL 1 DAY"))


# ----------------------------------------------------------------------------- F1 / F13 / F14
def collated(c: Column) -> Column:
    """A text as the original's tables compare it: without regard to case and accents."""
    return F.collate(c, "UNICODE_CI_AI")


def email_domain(col: str = "email") -> Column:
    """Text after the last ``@``; no ``@`` → the whole text."""
    return F.substring_index(F.col(col), "@", -1)


def deadline_date(ts: Column, days: Column) -> Column:
    return F.date_add(F.to_date(ts), days)


# ----------------------------------------------------------------------------- F15 / F22
def stars(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(F.coalesce(c.cast("double"), F.lit(0.0))).cast("int")


def money(col: str | Column) -> Column:
    """Money in query results: double rounded to 2 places."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 2)


# ----------------------------------------------------------------------------- F16
def ru_number(col: str | Column) -> Column:
    """ru-RU number text: no-break-space grouping, decimal comma, ≤ 3 decimals."""
    c = F.col(col) if isinstance(col, str) else col
    return F.translate(F.call_function("format_number", c.cast("double"), F.lit("#,##0.###")), ",.", " ,")


# ----------------------------------------------------------------------------- F18
def parse_number(col: str | Column, default=None, dtype: str = "double") -> Column:
    """Number from text; unparsable or empty → ``default`` (``try_cast``, never an error)."""
    c = F.col(col) if isinstance(col, str) else col
    v = F.trim(c.cast("string")).try_cast(dtype)
    return v if default is None else F.coalesce(v, F.lit(default).cast(dtype))


# ----------------------------------------------------------------------------- F19 / F21
# Executor level thresholds (completed orders) and labels.
LEVELS = ((100, "master"), (30, "expert"), (10, "pro"))
LEVEL_DEFAULT = "novice"
# Availability states; unknown values read as available.
AVAILABILITY = ("available", "busy", "vacation")


def executor_level(col: str | Column) -> Column:
    c = F.coalesce((F.col(col) if isinstance(col, str) else col).cast("bigint"), F.lit(0))
    out = F.lit(LEVEL_DEFAULT)
    for threshold, label in reversed(LEVELS):
        out = F.when(c >= threshold, label).otherwise(out)
    return out


def availability_label(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(*AVAILABILITY), c).otherwise(F.lit("available"))


# ----------------------------------------------------------------------------- F20 / F23
# Social links shown, in display order.
SOCIAL_KEYS = ("github", "behance", "dribbble", "telegram", "linkedin", "website")
SKILLS_SCHEMA = "array<struct<name:string,level:int>>"
PORTFOLIO_SCHEMA = "array<struct<url:string,title:string,description:string>>"


def skill_percents(col: str = "skills") -> Column:
    """First 5 skills as ``struct(name, pct)``; missing level counts as 3."""
    skills = F.from_json(F.col(col), SKILLS_SCHEMA)
    return F.transform(
        F.slice(F.coalesce(skills, F.array().cast(SKILLS_SCHEMA)), 1, 5),
        lambda s: F.struct(
            s["name"].alias("name"),
            F.round(F.coalesce(s["level"], F.lit(3)) / 5 * 100).cast("int").alias("pct")))


def known_socials(col: str = "socials") -> Column:
    """Keys of SOCIAL_KEYS present (non-empty) in the socials map, in fixed order."""
    m = F.from_json(F.col(col), "map<string,string>")
    keys = F.array(*[F.lit(k) for k in SOCIAL_KEYS])
    return F.filter(keys, lambda k: F.coalesce(F.length(F.element_at(m, k)) > 0, F.lit(False)))


def first_portfolio(col: str = "portfolio", n: int = 4) -> Column:
    items = F.from_json(F.col(col), PORTFOLIO_SCHEMA)
    return F.slice(F.coalesce(items, F.array().cast(PORTFOLIO_SCHEMA)), 1, n)


# ----------------------------------------------------------------------------- F24 / F25
def request_uuid(*cols: str) -> Column:
    """Deterministic id of a new row from its request id: a retry gives the same id."""
    h = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def client_key(forwarded: str, socket: str) -> Column:
    """First address of a forwarded list, else the socket address, else 'unknown'."""
    first = F.trim(F.split(F.col(forwarded), ",").getItem(0))
    nonempty = lambda c: F.when(F.length(c) > 0, c)
    return F.coalesce(nonempty(first), nonempty(F.col(socket)), F.lit("unknown"))

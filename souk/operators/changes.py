"""Change application, re-aimed from the write handlers.

Input: a table of requests (``request_id``, ``ts``, actor, payload).
Output: per-request outcomes (accepted / rejected with a reason) and the
effects — new snapshot rows, appended ledger rows, notifications.
Requests for the same key apply in (``ts``, ``request_id``) order.

Rules whose checks read state left by earlier requests of the same key
(balance, order status) work on segments, so a busy key is many tasks. Balance events are
scanned where they are dealt (``sorted_scan``); of users in several ranges only the rows
after the first refused one are scanned (``ordered_fold``).
Everything else is joins, filters and aggregations. "First/last request per key wins" uses the
``min_by``/``max_by`` aggregates, which combine map-side, so a hot key does
not land in one task. New ids are derived from the request id (F24): a
re-run of the same requests produces the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.predicates import CLOSED_ORDER_STATES, collated, request_uuid
from souk.functions.text import js_trim
from souk.operators.folds import ordered_fold, ordered_scan, sorted_scan
from souk.operators.ordering import running_totals, stored
from souk.operators.segments import PART, Segments, crossing_keys, previous, running, segments

CENT = Decimal("0.01")

# Texts written into ledger rows, notifications, chat lines and
# profiles (they must read as the original application writes them).
TEXT = {
    "payment_description": "Оплата заказа: ",
    "order_created_title": "📦 Новый заказ!",
    "order_created_body": ("Заказ на «", "»"),
    "admin_message_prefix": "🛡️ [Администратор]: ",
    "deleted_name_suffix": " (удалён)",
    "default_response_time": "< 24 часов",
    "status_changed_title": "Статус заказа изменён",
    "payout_title": "💰 Оплата получена!",
    "payout_body": "Зачислено ",
    "refund_title": "↩️ Возврат средств",
    "refund_body": "Возвращено ",
    "currency": " ₽",
    "price_changed_title": "💰 Цена изменена",
    "price_changed_body": "Исполнитель изменил цену на ",
    "price_changed_chat": "💰 Исполнитель изменил цену: ",
    "new_review_title": "Новый отзыв! ⭐",
    "new_message_title": "Новое сообщение",
    "payout_description": "Оплата за выполненный заказ",
    "refund_description": "Возврат за отменённый заказ",
    "forced_payout_description": "выплата по решению администратора",
    "forced_refund_description": "возврат по решению администратора",
    "forced_title": "⚠️ Статус заказа изменён администратором",
    "forced_body": ("Статус изменён с «", "» на «", "»"),
    "forced_reason": ". Причина: ",
    "forced_note": "принудительно изменено администратором",
    "default_category_icon": "📁",
    "deposit_description": "Пополнение баланса",
    "adjust_description": "корректировка администратором",
}

# Who may move an order from which state to which.
TRANSITIONS = {
    "customer": {"created": ("cancelled",), "in_progress": ("review",), "review": ("completed",),
                 "completed": (), "cancelled": ()},
    "executor": {"created": ("in_progress", "cancelled"), "in_progress": ("review",), "review": (),
                 "completed": (), "cancelled": ()},
}


def _order_key(*extra: str) -> list[str]:
    return ["ts", "request_id", *extra]


# ----------------------------------------------------------------------------- C14 / C15
def upsert(df: DataFrame, changes: DataFrame, key: str, value: str, mode: str = "add") -> DataFrame:
    """Add-or-set upsert keyed by ``key`` (one change row per key).

    ``add``: existing + change (absent → change); ``set``: change replaces.
    A full outer join keeps untouched rows and inserts new keys.
    """
    ch = changes.groupBy(key).agg(F.sum(value).alias("_chg")) if mode == "add" else \
        changes.select(key, F.col(value).alias("_chg"))
    j = df.join(ch, key, "full_outer")
    if mode == "add":
        newv = F.coalesce(F.col(value), F.lit(0)) + F.coalesce(F.col("_chg"), F.lit(0))
    else:
        newv = F.coalesce(F.col("_chg"), F.col(value))
    dtype = dict(df.dtypes)[value]
    return j.withColumn(value, newv.cast(dtype)).drop("_chg")


def first_per_key(df: DataFrame, key: str | list[str], order: list[str] | None = None,
                  last: bool = False) -> DataFrame:
    """The first (or last) row per key in ``order`` — a map-side-combinable aggregate."""
    keys = [key] if isinstance(key, str) else list(key)
    order = order or ["ts", "request_id"]
    payload = F.struct(*[F.col(c) for c in df.columns])
    ordkey = F.struct(*[F.col(c) for c in order])
    pick = F.max_by(payload, ordkey) if last else F.min_by(payload, ordkey)
    return df.groupBy(*keys).agg(pick.alias("_r")).select("_r.*")


def insert_ignore(df: DataFrame, rows: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Insert rows whose key is absent (first row per key wins); existing rows stay.

    Without an ``order`` the smallest whole row wins, so a retried task picks the
    same row (``dropDuplicates`` may keep a different one on each attempt).
    """
    new = first_per_key(rows, key, order or list(rows.columns))
    new = new.join(df.select(key), key, "left_anti").select(*df.columns)
    return df.unionByName(new)


# ----------------------------------------------------------------------------- C1 / C7
def _settle_step(bal, r):
    if r["pre"] is not None:
        return bal, _out(r, "rejected", r["pre"], bal)
    if r["checked"] and bal + r["change"] < 0:
        return bal, _out(r, "rejected", "funds", bal)
    bal = bal + r["change"]
    return bal, _out(r, "accepted", None, bal)


def _out(r, status, reason, bal):
    # a tuple in FOLD_SCHEMA order
    return (r["request_id"], r["kind"], r["user_id"], status, reason, r["amount"], Decimal(bal).quantize(CENT))


FOLD_SCHEMA = ("request_id string, kind string, user_id string, status string, reason string, "
               "amount decimal(12,2), balance_after decimal(14,2)")


def settle(events: DataFrame, balances: DataFrame | None = None, carry: list[str] | None = None,
           made: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """Outcomes of balance events (request_id, ts, user_id, kind, amount, pre, start, change) in each user's order.

    ``pre`` is a reason known beforehand. An order, and a manual change below zero, is
    refused if it would leave less than nothing. With ``balances`` (user_id, amount; a user once)
    an event without ``start`` starts from there. Outcomes keep the columns of ``carry``
    (``ts`` and texts), so that nobody has to join them with the requests again. Columns in ``made``
    follow from the others: they are neither exchanged nor stored. ``partitions`` is the number
    of ranges, if the session's isn't enough.

    1. Events and balances are dealt over ranges of (user, ts, request_id), sorted and scanned in
       the same stage; the balances come first, so that no join has to exchange the events before.
       What is written is the outcome of every user in one range. This is the only exchange of all events.
    2. Users in several ranges (at most two a range, among them the busy ones) are settled by segments.

    A null user is the user with the empty id, but has no balance.
    """
    made, carry = made or {}, list(carry or [])
    kept = [c for c in ("request_id", "ts", "kind", "user_id", "amount", "pre", "start", "change") if c not in made]
    ev = events.select(*kept, *[c for c in carry if c not in kept], F.lit(1).alias("_row"))
    if balances is not None:
        ev = ev.unionByName(balances.filter("user_id is not null").select(
            "user_id", F.coalesce("amount", F.lit(0)).cast("decimal(14,2)").alias("start"), F.lit(0).alias("_row")), allowMissingColumns=True)
    user = F.coalesce("user_id", F.lit(""))
    order = [user, F.col("_row"), F.col("ts"), F.col("request_id")]
    ranged = ev.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    # of the made columns only what the scan needs
    kind, pre, change = (made.get(c, F.col(c)) for c in ("kind", "pre", "change"))
    checked = F.coalesce(pre.isNull() & ((kind == "order") | ((kind == "adjust") & (change < 0))), F.lit(False))
    move = F.when(pre.isNull(), F.coalesce(change, F.lit(0))).otherwise(F.lit(0)).cast("decimal(14,2)")
    scanned = sorted_scan(ranged, {"user": F.col("user_id"), "row": F.col("_row"), "start": _cents(F.col("start")),
                                   "move": _cents(move), "checked": checked}, _balance_scan, "_left bigint, _short boolean")
    after = (F.col("_left") * F.lit(CENT)).cast("decimal(14,2)")
    rows = stored(scanned.withColumn("_left", after).withColumn(PART, F.spark_partition_id()), "settle", tight=True)
    rows = rows.withColumns({"_user": user, **made})
    crossing = crossing_keys(rows, "_user", "settle")
    asked = rows.filter("_row = 1")
    lone = crossing.isEmpty()
    whole = (asked if lone else asked.join(F.broadcast(crossing), "_user", "left_anti")).select(
        "request_id", "kind", "user_id", F.when(F.col("pre").isNull() & ~F.col("_short"), "accepted").otherwise("rejected").alias("status"),
        F.coalesce("pre", F.when(F.col("_short"), "funds")).alias("reason"), "amount", F.col("_left").alias("balance_after"), *carry)
    if lone:
        return whole
    own = rows.filter("_row = 0").join(F.broadcast(crossing), "_user").groupBy("user_id").agg(F.max("start").alias("_own"))   # a row a user
    busy = asked.join(F.broadcast(crossing), "_user").join(F.broadcast(own), "user_id", "left")
    busy = busy.withColumn("start", F.coalesce("start", "_own", F.lit(0)).cast("decimal(14,2)")).withColumn("checked", checked)
    busy = stored(busy.withColumns({"_move": move, "change": move}).drop("_own", "_row", "_left", "_short"), "settle-busy")
    return whole.unionByName(_settle_segments(Segments(busy, "_user", ["ts", "request_id"], crossing), carry))


def _cents(amount: Column) -> Column:
    return (amount.cast("decimal(14,2)") * 100).cast("bigint")


def _balance_scan():
    """Settle rows in their order, all in cents: the balance after each, and whether it was refused for want of funds.

    ``row`` is 0 for a balance. Up to the first refusal a row starts from its own ``start``
    and all moves before it, from there on from what the row before has left.
    """
    current, known, moved, left, tight = None, 0, 0, 0, False

    def advance(users, rows, starts, moves, checks):
        nonlocal current, known, moved, left, tight
        after, short = [], []
        for user, row, start, move, check in zip(users, rows, starts, moves, checks):
            if (user or "") != current:
                current, known, moved, tight = user or "", 0, 0, False
            if not row:
                known = start
                after.append(None)
                short.append(False)
                continue
            if not tight:
                left = moved + (start if start is not None else 0 if user is None else known)
            refused = check and left + move < 0
            if refused:
                tight = True
            else:
                left += move
                moved += move
            after.append(left)
            short.append(refused)
        return after, short

    return advance


def _settle_segments(s: Segments, carry: list[str]) -> DataFrame:
    """Outcomes of users whose events lie in several segments (with ``_user``, ``_move``, ``checked`` and a start each).

    1. A running sum over segments gives the balance if every event went through. Up to a
       user's first event that this leaves below zero that is the true balance: no scan.
    2. Rows from there on are scanned segment by segment, all segments at once, each from an
       assumed balance (nothing; a user who is refused has little left). A segment whose true
       balance, the end of the one before, differs is scanned again from that, until none
       differs. Every round settles at least one more segment of a user, mostly all.
    """
    valid = F.col("pre").isNull()
    after = running(s, _sum=F.col("_move")).withColumn("_after", (F.col("start") + F.col("_sum")).cast("decimal(14,2)")).drop("_sum")
    short = F.when(F.col("checked") & (F.col("_after") < 0), 1).otherwise(0)
    before = (F.col("_after") - F.col("_move")).cast("decimal(14,2)")
    rows = stored(running(s.derive(after), "max", _short=short).withColumn("_from", before), "settle-rows")
    easy = rows.filter("_short = 0").select(
        "request_id", "kind", "user_id", F.when(valid, "accepted").otherwise("rejected").alias("status"), F.col("pre").alias("reason"),
        "amount", F.col("_after").alias("balance_after"), *carry)
    tight = rows.filter("_short = 1").drop("_short", "_after")
    if tight.isEmpty():
        return easy
    # times pass the scan as texts, which keep nulls and any year
    passed = ["_at" if c == "ts" else c for c in carry]
    tight = tight.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")).cast("string")) if "ts" in carry else tight

    def step(bal, r):
        bal, out = _settle_step(bal, r)
        return bal, out + tuple(r[c] for c in passed)

    scanned = ordered_fold(_with_starts(s.derive(tight)), ["_user", PART], _order_key(), lambda r: r["_from"], step,
                           FOLD_SCHEMA + "".join(f", {c} string" for c in passed), sort_only=["ts"])
    if "ts" in carry:
        scanned = scanned.withColumn("ts", F.timestamp_micros(F.col("_at").cast("bigint")).cast(s.rows.schema["ts"].dataType)).drop("_at")
    return easy.unionByName(scanned)


def _with_starts(s) -> DataFrame:
    """The rows to scan, those of a user's second and later segments with the balance that enters the segment in ``_from``."""
    ends = "_user string, _part int, _end decimal(14,2)"
    w = Window.partitionBy("_user").orderBy(PART)
    chunks = s.carry([F.min_by("_from", F.struct("ts", "request_id")).alias("_from")])         # users in several partitions
    chunks = chunks.withColumn("_n", F.row_number().over(w)).withColumn(
        "_from", F.when(F.col("_n") == 1, F.col("_from")).otherwise(F.lit(0).cast("decimal(14,2)")))
    todo = chunks = stored(chunks, "settle-chunks")
    done = None
    while not todo.isEmpty():
        again = s.rows.drop("_from").join(F.broadcast(todo.select("_user", PART, "_from")), ["_user", PART])
        found = ordered_fold(again, ["_user", PART], _order_key(), lambda r: r["_from"],
                             lambda bal, r: (_settle_step(bal, r)[0], None), ends,
                             finish=lambda bal, last: (last["_user"], last[PART], bal), sort_only=["ts"])
        new = todo.join(found, ["_user", PART])
        done = new if done is None else done.join(todo.select("_user", PART), ["_user", PART], "left_anti").unionByName(new)
        done = stored(done, "settle-chunks")
        true = F.lag("_end").over(w)
        wrong = done.withColumn("_true", true).filter((F.col("_n") > 1) & (F.col("_true") != F.col("_from")))
        todo = stored(wrong.select("_user", PART, F.col("_true").alias("_from"), "_n"), "settle-chunks")
    if done is None:
        return s.rows
    given = done.filter("_n > 1").select("_user", PART, F.col("_from").alias("_given"))
    return s.rows.join(F.broadcast(given), ["_user", PART], "left").withColumn("_from", F.coalesce("_given", "_from")).drop("_given")


def _start_balance(T, events: DataFrame) -> DataFrame:
    b = T["balances"].select(F.col("user_id").alias("_bu"), F.col("amount").alias("start"))
    return (events.join(b, F.col("user_id") == F.col("_bu"), "left").drop("_bu")
            .withColumn("start", F.coalesce(F.col("start"), F.lit(0)).cast("decimal(14,2)")))


def order_checks(T, requests: DataFrame) -> DataFrame:
    """Order requests with price and the reason known before any balance is read."""
    s = T["services"].select(F.col("id").alias("_sid"), F.col("price"), F.col("executor_id"),
                             F.col("is_active").alias("_sact"), F.col("title"), F.col("deadline"))
    j = requests.join(s, F.col("service_id") == F.col("_sid"), "left")
    pre = (F.when(F.col("_sid").isNull() | ~F.col("_sact"), "service")
           .when(F.col("executor_id") == F.col("customer_id"), "own"))
    return j.withColumn("pre", pre).drop("_sid", "_sact")


def place_orders(T, requests: DataFrame, deposits: DataFrame | None = None) -> DataFrame:
    """C1 outcomes: one row per order (and deposit) request, in per-customer order.

    Checks in order: unknown/inactive service, own service, balance < price.
    A rejected order does not use up funds; deposits (C6 requests) join the
    same event list so an order can spend money deposited before it.
    """
    o = order_checks(T, requests).select(
        "request_id", "ts", F.col("customer_id").alias("user_id"), F.lit("order").alias("kind"),
        F.col("price").cast("decimal(12,2)").alias("amount"), "pre")
    ev = o
    if deposits is not None:
        d = deposits.select("request_id", "ts", "user_id", F.lit("deposit").alias("kind"),
                            F.col("amount").cast("decimal(12,2)").alias("amount"),
                            F.when(~F.coalesce(F.col("amount") > 99, F.lit(False)), "amount").alias("pre"))
        ev = ev.unionByName(d)
    signed = F.when(F.col("kind") == "deposit", F.col("amount")).otherwise(-F.col("amount"))
    return settle(_start_balance(T, ev).withColumn("change", signed))


def place_orders_effects(T, requests: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    """Rows the accepted orders add: orders, payments, notifications; new balances and counters."""
    ok = outcomes.filter((F.col("status") == "accepted") & (F.col("kind") == "order")).select("request_id")
    acc = order_checks(T, requests).join(ok, "request_id")
    order_id = request_uuid("request_id")
    orders = acc.select(
        order_id.alias("id"), "service_id", "customer_id", "executor_id", F.lit("created").alias("status"),
        F.col("price").alias("total_price"), F.date_add(F.to_date("ts"), F.col("deadline")).alias("deadline_date"),
        "requirements", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    payments = acc.select(
        F.concat(F.lit("tx-"), order_id).alias("id"),
        F.col("customer_id").alias("user_id"), F.lit(None).cast("string").alias("order_id"),
        F.lit("payment").alias("type"), F.col("price").alias("amount"),
        F.concat(F.lit(TEXT["payment_description"]), F.col("title")).alias("description"), F.col("ts").alias("created_at"))
    notes = acc.select(
        F.concat(F.lit("nt-"), order_id).alias("id"), F.col("executor_id").alias("user_id"),
        F.lit("order_created").alias("type"), F.lit(TEXT["order_created_title"]).alias("title"),
        F.concat(F.lit(TEXT["order_created_body"][0]), F.col("title"), F.lit(TEXT["order_created_body"][1])).alias("body"),
        F.to_json(F.struct(order_id.alias("order_id"))).alias("data"), F.lit(False).alias("is_read"),
        F.col("ts").alias("created_at"))
    spent = acc.groupBy(F.col("customer_id").alias("user_id")).agg((-F.sum("price")).alias("amount"))
    balances = upsert(T["balances"].select("user_id", "amount"), spent, "user_id", "amount", "add")
    counts = acc.groupBy(F.col("service_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    services = (T["services"].join(counts, "id", "left")
                .withColumn("orders_count", (F.col("orders_count") + F.coalesce("_n", F.lit(0))).cast("int"))
                .drop("_n"))
    return {"orders": orders, "transactions": payments, "notifications": notes,
            "balances": balances, "services": services}


# ----------------------------------------------------------------------------- C2 / C5
# Order states, in a fixed order (the index of a state in a chunk map).
STATES = ("created", "in_progress", "review", "completed", "cancelled")


def _moved(state: str, role: str | None, new_status: str | None) -> str:
    """The state after a request of ``role`` for ``new_status``."""
    return new_status if new_status in TRANSITIONS.get(role, {}).get(state, ()) else state


def _remembered(fn: Callable) -> Callable:
    """``fn`` with its results kept: states, roles and statuses are few."""
    known = {}

    def get(*args):
        if args not in known:
            known[args] = fn(*args)
        return known[args]
    return get


def _chunk_scan():
    """Advance all five possible runs of a chunk by each of its requests."""
    after = _remembered(lambda ends, role, new: ",".join(_moved(s, role, new) for s in ends.split(",")))
    ends = ""

    def advance(first, pdf):
        nonlocal ends
        out = []
        for f, role, new in zip(first, pdf["role"].tolist(), pdf["new_status"].tolist()):
            ends = after(",".join(STATES) if f else ends, role, new)
            out.append(ends)
        return [out]

    return advance


def _incoming_scan():
    """Carry an order's state across its chunks: the state entering each of them."""
    after = _remembered(lambda state, ends: ends.split(",")[STATES.index(state)])
    state = ""

    def advance(first, pdf):
        nonlocal state
        out = []
        for f, start, ends in zip(first, pdf["start"].tolist(), pdf["ends"].tolist()):
            state = start if f else state
            out.append(state)
            state = after(state, ends)
        return [out]

    return advance


def _status_scan():
    """The state before each request, and whether the request moves the order."""
    allowed = _remembered(lambda state, role, new: new in TRANSITIONS.get(role, {}).get(state, ()))
    state = ""

    def advance(first, pdf):
        nonlocal state
        old, done = [], []
        for f, start, role, new in zip(first, *[pdf[c].tolist() for c in ("start", "role", "new_status")]):
            state = start if f else state
            ok = allowed(state, role, new)
            old.append(state)
            done.append(ok)
            if ok:
                state = new
        return old, done

    return advance


def _scan_status(ev: DataFrame, key: list[str]) -> DataFrame:
    """Outcomes of the rows of each key in order, from the key's ``start``."""
    out = ordered_scan(ev, key, _order_key(), _status_scan, "old_status string, _ok boolean",
                       ["request_id", "order_id", "actor_id", "role", "new_status"])
    return out.select(
        "request_id", "order_id", "actor_id", "role", "old_status", "new_status",
        F.when(F.col("_ok"), "accepted").otherwise("rejected").alias("status"),
        F.when(F.col("role").isNull(), "participant").when(~F.col("_ok"), "transition").alias("reason"))


def _split_status_changes(ev: DataFrame, split: str) -> DataFrame:
    """C2 with every order cut into time chunks, exactly (the state space is finite).

    1. per (order, chunk), in parallel: the end state for each of the five possible
       start states (a five-entry map);
    2. per order, over its small list of chunk maps in time order: the state that
       enters each chunk, starting from the stored status;
    3. per (order, chunk), in parallel again: the usual fold from that state.
    A hot order is spread over its chunks instead of one task.
    """
    ev = ev.withColumn("_b", F.date_trunc(split, F.col("ts").cast("timestamp")))
    maps = ordered_scan(ev.drop("actor_id"), ["order_id", "_b"], _order_key(), _chunk_scan, "ends string",
                        ["order_id", "_b", "start"], ends=True)
    incoming = ordered_scan(maps, ["order_id"], ["_b"], _incoming_scan, "incoming string", ["order_id", "_b"])
    ev = ev.join(incoming, ["order_id", "_b"]).withColumn("start", F.col("incoming")).drop("incoming")
    return _scan_status(ev, ["order_id", "_b"])


def apply_status_changes(T, requests: DataFrame, orders: DataFrame | None = None,
                         split: str | None = None) -> DataFrame:
    """C2 outcomes: each request checked against the order's status at that point.

    The actor must be the order's customer or executor; the transition table is
    read with the actor's account role (a participant with another role has no
    allowed transition). A busy order is cut into segments. ``split`` (a ``date_trunc``
    unit) is the older form by chunk maps and folds, for rules that may lead back;
    "scan" is one ordered scan an order, for a micro-batch, whose rows the trigger bounds.
    """
    o = (orders if orders is not None else T["orders"]).select(
        F.col("id").alias("_oid"), "customer_id", "executor_id", F.col("status").alias("start"))
    u = T["users"].select(F.col("id").alias("_uid"), F.col("role").alias("_urole"))
    participant = (F.col("actor_id") == F.col("customer_id")) | (F.col("actor_id") == F.col("executor_id"))
    ev = (requests.join(o, F.col("order_id") == F.col("_oid"), "left")
          .join(u, F.col("actor_id") == F.col("_uid"), "left")
          .withColumn("role", F.when(F.coalesce(participant, F.lit(False)), F.col("_urole")))
          .withColumn("start", F.coalesce("start", F.lit("created")))
          .select("request_id", "ts", "order_id", "actor_id", "new_status", "role", "start"))
    if split == "scan":
        return _scan_status(ev, ["order_id"])
    if split:
        return _split_status_changes(ev, split)
    return _moves(ev)


def _longest_path(edges: dict[str, set[str]], state: str, seen: tuple = ()) -> int:
    if state in seen:
        raise ValueError("the transitions have a cycle")
    return max((1 + _longest_path(edges, s, (*seen, state)) for s in edges.get(state, ())), default=0)


def _moves(ev: DataFrame) -> DataFrame:
    """C2 by first moves: no transition leads back, so an order has at most as many accepted
    requests as the longest path has steps. The next one is the first request after the last
    accepted one that its state allows: a minimum over the order's segments.
    """
    edges: dict[str, set[str]] = {}
    for per_role in TRANSITIONS.values():
        for old, targets in per_role.items():
            edges.setdefault(old, set()).update(targets)
    steps = max(_longest_path(edges, s) for s in edges)
    at = F.struct("ts", "request_id")

    def allowed(state: Column) -> Column:
        ok = F.lit(False)
        for role, per_state in TRANSITIONS.items():
            for old, targets in per_state.items():
                if targets:
                    ok = ok | ((F.col("role") == role) & (state == old) & F.col("new_status").isin(*targets))
        return F.coalesce(ok, F.lit(False))

    def candidate(state: Column, since: Column) -> Column:
        later = since.isNull() | (at > since)
        return F.when(allowed(state) & later, F.struct(at.alias("at"), F.col("new_status").alias("to")))

    ev = ev.withColumn("_order", F.coalesce("order_id", F.lit("")))
    s = segments(ev, "_order", ["ts", "request_id"], "moves")
    # orders in several partitions: one aggregate a step, combined before the shuffle
    busy = s.rows.join(F.broadcast(s.crossing), "_order")
    firsts = s.crossing
    state, since = F.col("start"), F.lit(None).cast(ev.select(at.alias("x")).schema["x"].dataType)
    busy_state, busy_since = state, since
    for i in range(steps):
        found = busy.join(F.broadcast(firsts), "_order").groupBy("_order").agg(F.min(candidate(busy_state, busy_since)).alias(f"_b{i}"))
        firsts = stored(firsts.join(found, "_order", "left"), "moves-first")       # at most two orders a partition
        busy_state, busy_since = F.coalesce(f"_b{i}.to", busy_state), F.coalesce(f"_b{i}.at", busy_since)
    rows = s.rows.join(F.broadcast(firsts.withColumn("_busy", F.lit(True))), "_order", "left")
    whole = Window.partitionBy(PART, "_order")
    old, accepted = F.col("start"), F.lit(False)
    for i in range(steps):
        rows = rows.withColumn(f"_m{i}", F.min(candidate(state, since)).over(whole))
        rows = rows.withColumn(f"_m{i}", F.when(F.col("_busy"), F.col(f"_b{i}")).otherwise(F.col(f"_m{i}")))
        state, since = F.coalesce(f"_m{i}.to", state), F.coalesce(f"_m{i}.at", since)
        old = F.when(F.col(f"_m{i}.at") < at, F.col(f"_m{i}.to")).otherwise(old)
        accepted = accepted | F.coalesce(F.col(f"_m{i}.at") == at, F.lit(False))
    return rows.select(
        "request_id", "order_id", "actor_id", "role", old.alias("old_status"), "new_status",
        F.when(accepted, "accepted").otherwise("rejected").alias("status"),
        F.when(F.col("role").isNull(), "participant").when(~accepted, "transition").alias("reason"))


def forced_status_effects(T, outcomes: DataFrame, requests: DataFrame,
                          orders: DataFrame | None = None) -> dict[str, DataFrame]:
    """What accepted forced changes write: log rows with a note, one notification to each
    side with the old and the new status and the reason, payout or refund rows with the
    admin's description (and no payment notification), balances, new statuses."""
    eff = status_effects(T, outcomes, requests, forced=True, orders=orders)
    acc = (outcomes.filter(F.col("status") == "accepted").join(requests.select("request_id", "ts", "note"), "request_id")
           .join((orders if orders is not None else T["orders"]).select(
               F.col("id").alias("order_id"), "customer_id", "executor_id"), "order_id"))
    head, middle, tail = TEXT["forced_body"]
    reason = F.when(F.length("note") > 0, F.concat(F.lit(TEXT["forced_reason"]), "note")).otherwise("")
    sides = F.explode(F.array(F.struct(F.lit("c").alias("side"), F.col("customer_id").alias("user_id")),
                              F.struct(F.lit("e").alias("side"), F.col("executor_id").alias("user_id"))))
    notes = acc.withColumn("to", sides).select(
        F.concat(F.lit("nf-"), F.col("to.side"), request_uuid("request_id")).alias("id"), F.col("to.user_id").alias("user_id"),
        F.lit("admin").alias("type"), F.lit(TEXT["forced_title"]).alias("title"),
        F.concat(F.lit(head), "old_status", F.lit(middle), "new_status", F.lit(tail), reason).alias("body"),
        F.to_json(F.struct("order_id")).alias("data"), F.col("ts").alias("created_at"))
    note = F.when(F.length("note") > 0, F.col("note")).otherwise(F.lit(TEXT["forced_note"]))
    log = eff["status_log"].withColumn("note", note)
    return {**eff, "status_log": log, "notifications": notes}


def status_effects(T, outcomes: DataFrame, requests: DataFrame, forced: bool = False,
                   orders: DataFrame | None = None, keep: bool = False) -> dict[str, DataFrame]:
    """Log rows, payouts (completed) and refunds (cancelled), notifications, new statuses.
    With ``keep`` the accepted requests and their orders are joined once and written, for readers of all effects."""
    orders = orders if orders is not None else T["orders"]
    acc = (outcomes.filter(F.col("status") == "accepted")
           .join(requests.select("request_id", "ts", "note"), "request_id"))
    o = orders.select(F.col("id").alias("order_id"), "customer_id", "executor_id", "total_price")
    acc = acc.join(o, "order_id")
    if keep:
        acc = stored(acc, "status-accepted")
    log = acc.select("order_id", "old_status", "new_status", F.col("actor_id").alias("changed_by"),
                     "note", F.col("ts").alias("created_at"))
    pay = acc.filter((F.col("new_status") == "completed") & (F.col("old_status") != "completed"))
    if forced:
        refund = acc.filter((F.col("new_status") == "cancelled") & ~F.col("old_status").isin(*CLOSED_ORDER_STATES))
    else:
        refund = acc.filter((F.col("new_status") == "cancelled") & (F.col("old_status") != "completed"))
    about = lambda key: F.lit(TEXT[f"forced_{key}" if forced else key]).alias("description")
    money_rows = (pay.select("request_id", "order_id", F.col("executor_id").alias("user_id"), "total_price", "ts",
                             about("payout_description"))
                  .unionByName(refund.select("request_id", "order_id", F.col("customer_id").alias("user_id"),
                                             "total_price", "ts", about("refund_description"))))
    tx = money_rows.select(F.concat(F.lit("tx-"), request_uuid("request_id")).alias("id"), "user_id", "order_id",
                           F.lit("deposit").alias("type"), F.col("total_price").alias("amount"), "description",
                           F.col("ts").alias("created_at"))
    credit = money_rows.groupBy("user_id").agg(F.sum("total_price").alias("amount"))
    balances = upsert(T["balances"].select("user_id", "amount"), credit, "user_id", "amount", "add")
    last = first_per_key(acc.select("order_id", "ts", "request_id", "new_status"), "order_id", last=True)
    orders = (orders.join(last.select(F.col("order_id").alias("id"), F.col("new_status"),
                                      F.col("ts").alias("_ts")), "id", "left")
              .withColumn("status", F.coalesce("new_status", "status"))
              .withColumn("updated_at", F.coalesce(F.col("_ts").cast("timestamp"), F.col("updated_at").cast("timestamp")))
              .drop("new_status", "_ts"))
    from souk.functions.predicates import ru_number
    other = F.when(F.col("actor_id") == F.col("customer_id"), F.col("executor_id")).otherwise(F.col("customer_id"))
    data = F.to_json(F.struct("order_id")).alias("data")
    notes = acc.select(F.concat(F.lit("ns-"), request_uuid("request_id")).alias("id"), other.alias("user_id"),
                       F.lit("order_accepted").alias("type"), F.lit(TEXT["status_changed_title"]).alias("title"),
                       F.concat(F.lit("«"), "old_status", F.lit("» → «"), "new_status", F.lit("»")).alias("body"),
                       data, F.col("ts").alias("created_at"))

    def money_note(df: DataFrame, prefix: str, title: str, body: str) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), request_uuid("request_id")).alias("id"), "user_id",
                         F.lit("payment_received").alias("type"), F.lit(TEXT[title]).alias("title"),
                         F.concat(F.lit(TEXT[body]), ru_number("total_price"), F.lit(TEXT["currency"])).alias("body"),
                         data, F.col("ts").alias("created_at"))
    paid = money_note(pay.select("request_id", "order_id", F.col("executor_id").alias("user_id"), "total_price", "ts"),
                      "np-", "payout_title", "payout_body")
    back = money_note(refund.select("request_id", "order_id", F.col("customer_id").alias("user_id"), "total_price",
                                    "ts"), "nr-", "refund_title", "refund_body")
    return {"status_log": log, "transactions": tx, "balances": balances, "orders": orders,
            "notifications": notes.unionByName(paid).unionByName(back)}


# States an admin may set.
ORDER_STATES = ("created", "in_progress", "review", "completed", "cancelled")


def force_status(T, requests: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """An admin moves an order to any valid state. Rejection depends only on the
    request (unknown order, invalid state), so the state before an accepted request
    is the previous accepted target, or the stored status: no fold, and a busy order's
    rows are cut into segments."""
    o = (orders if orders is not None else T["orders"]).select(F.col("id").alias("_oid"),
                                                               F.col("status").alias("start"))
    ev = requests.join(o, F.col("order_id") == F.col("_oid"), "left")
    reason = (F.when(F.col("_oid").isNull(), "order")
              .when(~F.coalesce(F.col("new_status").isin(*ORDER_STATES), F.lit(False)), "status"))
    ev = ev.withColumn("reason", reason)
    ok = ev.filter(F.col("reason").isNull())
    ok = previous(segments(ok, "order_id", ["ts", "request_id"], "forced"), "new_status").drop(PART)
    ok = ok.withColumn("old_status", F.coalesce("previous_new_status", "start")).drop("previous_new_status")
    bad = ev.filter(F.col("reason").isNotNull()).withColumn("old_status", F.lit(None).cast("string"))
    out = ok.unionByName(bad)
    accepted = F.col("reason").isNull()
    return out.select(
        "request_id", "order_id", "actor_id", F.lit("admin").alias("role"), "old_status", "new_status",
        F.when(accepted, "accepted").otherwise("rejected").alias("status"), "reason",
        (accepted & (F.col("new_status") == "completed") & (F.col("old_status") != "completed")).alias("pays_executor"),
        (accepted & (F.col("new_status") == "cancelled") & ~F.col("old_status").isin(*CLOSED_ORDER_STATES))
        .alias("refunds_customer"))


# ----------------------------------------------------------------------------- C3
def apply_price_changes(T, requests: DataFrame) -> DataFrame:
    """C3 outcomes: executor only, order created/in_progress, price > 0; last valid wins."""
    o = T["orders"].select(F.col("id").alias("_oid"), "executor_id", "customer_id",
                           F.col("status").alias("order_status"))
    j = requests.join(o, F.col("order_id") == F.col("_oid"), "left")
    participant = (F.col("actor_id") == F.col("customer_id")) | (F.col("actor_id") == F.col("executor_id"))
    # the handler's order: price, participant, open order, executor
    reason = (F.when(~F.coalesce(F.col("price") > 0, F.lit(False)), "price")
              .when(F.col("_oid").isNull() | ~F.coalesce(participant, F.lit(False)), "order")
              .when(~F.col("order_status").isin("created", "in_progress"), "status")
              .when(F.col("actor_id") != F.col("executor_id"), "executor"))
    j = j.withColumn("reason", reason)
    ok = j.filter(F.col("reason").isNull())
    last = first_per_key(ok.select("order_id", "ts", "request_id"), "order_id", last=True) \
        .select(F.col("request_id").alias("_win"))
    return (j.join(last, F.col("request_id") == F.col("_win"), "left")
            .select("request_id", "order_id", "actor_id", F.col("price").cast("double").alias("price"),
                    F.when(F.col("reason").isNotNull(), "rejected")
                    .when(F.col("_win").isNotNull(), "applied").otherwise("superseded").alias("status"),
                    "reason"))


def price_change_effects(T, requests: DataFrame) -> dict[str, DataFrame]:
    """Every accepted price change notifies the customer (X1's intent) and writes a chat
    line with the previous and the new price; the order keeps the last price. The
    previous price of a change is the one before it (over segments), or the stored price."""
    from souk.functions.predicates import ru_number
    out = apply_price_changes(T, requests).filter(F.col("status") != "rejected").select("request_id")
    o = T["orders"].select(F.col("id").alias("order_id"), "customer_id", "total_price")
    acc = requests.join(out, "request_id").join(o, "order_id")
    acc = previous(segments(acc, "order_id", ["ts", "request_id"], "prices"), "price").drop(PART)
    acc = acc.withColumn("old_price", F.coalesce("previous_price", "total_price")).drop("previous_price")
    note = F.coalesce(F.col("note"), F.lit(""))
    notes = acc.select(
        F.concat(F.lit("npc-"), request_uuid("request_id")).alias("id"), F.col("customer_id").alias("user_id"),
        F.lit("price_changed").alias("type"), F.lit(TEXT["price_changed_title"]).alias("title"),
        F.concat(F.lit(TEXT["price_changed_body"]), ru_number("price"), F.lit(TEXT["currency"]),
                 F.when(F.length(note) > 0, F.concat(F.lit(" — "), note)).otherwise(F.lit(""))).alias("body"),
        F.to_json(F.struct("order_id")).alias("data"), F.col("ts").alias("created_at"))
    chat = acc.select(
        F.concat(F.lit("mpc-"), request_uuid("request_id")).alias("id"), "order_id",
        F.col("actor_id").alias("sender_id"),
        F.concat(F.lit(TEXT["price_changed_chat"]), ru_number("old_price"), F.lit(" → "), ru_number("price"),
                 F.lit(TEXT["currency"]),
                 F.when(F.length(note) > 0, F.concat(F.lit(" ("), note, F.lit(")"))).otherwise(F.lit("")))
        .alias("message"), F.lit(False).alias("is_read"), F.col("ts").alias("created_at"))
    last = first_per_key(acc.select("order_id", "ts", "request_id", "price"), "order_id", last=True)
    orders = (T["orders"].join(last.select(F.col("order_id").alias("id"), F.col("price").alias("_p")), "id", "left")
              .withColumn("total_price", F.coalesce(F.col("_p"), F.col("total_price")).cast("decimal(12,2)"))
              .drop("_p"))
    return {"orders": orders, "notifications": notes, "messages": chat}


# ----------------------------------------------------------------------------- C4
def apply_reviews(T, requests: DataFrame) -> DataFrame:
    """C4 outcomes: rating 1..5 and comment ≤ 1000 (trimmed), the order is the
    customer's and completed, no stored review; the first valid request per order wins."""
    o = T["orders"].select(F.col("id").alias("_oid"), F.col("customer_id").alias("_cust"),
                           F.col("status").alias("_st"))
    have = T["reviews"].select(F.col("order_id").alias("_rev"))
    j = (requests.join(o, F.col("order_id") == F.col("_oid"), "left")
         .join(have, F.col("order_id") == F.col("_rev"), "left"))
    # input rules first, then the order, then an existing review (the handler's order)
    reason = (F.when(~F.coalesce(F.col("rating").between(1, 5), F.lit(False)), "rating")
              .when(F.coalesce(F.length(js_trim(F.col("comment"))), F.lit(0)) > 1000, "comment")
              .when(F.col("_oid").isNull() | (F.col("_cust") != F.col("customer_id")), "order")
              .when(F.col("_st") != "completed", "status")
              .when(F.col("_rev").isNotNull(), "exists"))
    j = j.withColumn("reason", reason)
    first = first_per_key(j.filter(F.col("reason").isNull()).select("order_id", "ts", "request_id"), "order_id") \
        .select(F.col("request_id").alias("_win"))
    return (j.join(first, F.col("request_id") == F.col("_win"), "left")
            .select("request_id", "order_id", "customer_id", "rating", stored_comment().alias("comment"),
                    F.when(F.col("reason").isNotNull(), "rejected")
                    .when(F.col("_win").isNotNull(), "accepted").otherwise("rejected").alias("status"),
                    F.coalesce(F.col("reason"), F.when(F.col("_win").isNull(), "duplicate")).alias("reason")))


def stored_comment() -> Column:
    """A review's comment as it is stored: trimmed, none instead of an empty one."""
    text = js_trim(F.col("comment"))
    return F.when(F.length(text) > 0, text)


def review_rows(T, requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """New review rows of accepted requests (then A9 gives the new ratings)."""
    acc = outcomes.filter(F.col("status") == "accepted").select("request_id")
    o = T["orders"].select(F.col("id").alias("order_id"), "service_id", "executor_id")
    return (requests.join(acc, "request_id").join(o, "order_id")
            .select(request_uuid("request_id").alias("id"), "order_id", "service_id", "customer_id",
                    "executor_id", "rating", stored_comment().alias("comment"), F.col("ts").alias("created_at")))


def review_effects(T, requests: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    """Accepted reviews: the new rows, the executor's notification, and the services'
    rating and review count recomputed from all reviews (A9, what the trigger kept)."""
    from souk.operators.reports import service_ratings
    new = review_rows(T, requests, outcomes)
    notes = new.select(F.concat(F.lit("nrv-"), F.col("id")).alias("id"), F.col("executor_id").alias("user_id"),
                       F.lit("new_review").alias("type"), F.lit(TEXT["new_review_title"]).alias("title"),
                       F.to_json(F.struct("order_id", "rating")).alias("data"), "created_at")
    reviews = T["reviews"].unionByName(new.select(*T["reviews"].columns))
    return {"reviews": reviews, "notifications": notes,
            "ratings": service_ratings({"reviews": reviews, "services": T["services"]})}


# ----------------------------------------------------------------------------- C6 / C7
def apply_deposits(T, requests: DataFrame) -> dict[str, DataFrame]:
    """Deposits above 99 add to the balance and append a deposit row."""
    ok = requests.filter(F.col("amount") > 99)
    tx = ok.select(F.concat(F.lit("tx-"), request_uuid("request_id")).alias("id"), "user_id",
                   F.lit(None).cast("string").alias("order_id"), F.lit("deposit").alias("type"),
                   "amount", F.lit(TEXT["deposit_description"]).alias("description"), F.col("ts").alias("created_at"))
    balances = upsert(T["balances"].select("user_id", "amount"), ok.select("user_id", "amount"),
                      "user_id", "amount", "add")
    rejects = requests.filter(~F.coalesce(F.col("amount") > 99, F.lit(False))).withColumn("reason", F.lit("amount"))
    return {"balances": balances, "transactions": tx, "rejects": rejects}


EVENTS_PER_TASK = 1_000_000     # events that one task sorts (about 250 MB)


def adjust_balances(T, requests: DataFrame) -> DataFrame:
    """C7 outcomes: manual change ≠ 0; a negative one needs balance ≥ its size.
    They carry the request's time and, as ``note``, its reason, so that the effects need no join."""
    note = [F.col("reason").alias("note")] if "reason" in requests.columns else []
    ev = requests.select("request_id", "ts", "user_id", F.col("amount").cast("decimal(12,2)").alias("amount"), *note)
    balances = T["balances"].select("user_id", "amount")
    again = _held_again(balances, "user_id", "adjust-balances").select(
        F.col("user_id").alias("_bu"), F.coalesce("amount", F.lit(0)).cast("decimal(14,2)").alias("start"))
    ev = _met_again(ev, again, "user_id", "_bu").drop("_bu")              # an event comes once per balance of its user
    made = {"kind": F.lit("adjust"), "pre": F.when(F.coalesce("amount", F.lit(0)) == 0, "amount"), "change": F.col("amount")}
    ranges = -(-requests.count() // EVENTS_PER_TASK)
    enough = ranges <= int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(ev, balances, ["ts", "note"] if note else ["ts"], made, None if enough else ranges)


def adjust_effects(T, requests: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    """Accepted manual changes: a deposit (positive) or withdrawal (negative) row with
    the absolute amount and the request's reason, and the balances moved by it.
    An outcome has the values of all requests with its id; only ids that come again are joined for that."""
    acc = outcomes.filter((F.col("status") == "accepted") & F.col("request_id").isNotNull())
    asked = requests.select("request_id", "ts", "user_id", "amount", "reason")
    if {"ts", "note"} <= set(outcomes.columns) and dict(requests.dtypes)["amount"] == "decimal(12,2)":
        values = ["ts", "user_id", "amount", "reason"]
        again = _held_again(asked, "request_id", "adjust-again").select(
            F.col("request_id").alias("_again"), *[F.col(c).alias(f"_{c}") for c in values])
        acc = _met_again(acc.drop("reason").withColumnRenamed("note", "reason"), again, "request_id", "_again").select(
            "request_id", *[F.when(F.col("_again").isNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in values])
    else:
        acc = acc.select("request_id").join(asked, "request_id")
    tx = acc.select(F.concat(F.lit("tx-"), request_uuid("request_id")).alias("id"), "user_id",
                    F.lit(None).cast("string").alias("order_id"),
                    F.when(F.col("amount") > 0, "deposit").otherwise("withdrawal").alias("type"),
                    F.abs("amount").cast("decimal(12,2)").alias("amount"),
                    F.when(F.length("reason") > 0, F.col("reason")).otherwise(F.lit(TEXT["adjust_description"]))
                    .alias("description"), F.col("ts").alias("created_at"))
    balances = upsert(T["balances"].select("user_id", "amount"), acc.select("user_id", "amount"),
                      "user_id", "amount", "add")
    return {"transactions": tx, "balances": balances}


def _held_again(df: DataFrame, key: str, name: str) -> DataFrame:
    """The rows whose ``key`` other rows hold too, none with a null one. Keys are counted by their hash, which is all
    that is exchanged; a key that only shares its hash may be among them."""
    keyed = df.filter(F.col(key).isNotNull()).withColumn("_hash", F.xxhash64(key))
    twice = stored(keyed.groupBy("_hash").count().filter("count > 1").select("_hash"), f"{name}-hashes")
    if twice.isEmpty():
        return df.filter(F.lit(False))
    return stored(keyed.join(twice, "_hash", "left_semi").drop("_hash"), name)


# ----------------------------------------------------------------------------- C8 / C9
ADMIN_PREFIX = TEXT["admin_message_prefix"]


def _judged_messages(T, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chat lines as C8 stores them, with their time, the notification and the verdict: those whose
    verdict needs their order, and the rest (admin lines, empty and long ones).

    Texts can be megabytes long. Lines that need their order have at most 2000 characters; they are
    written and joined with the orders that the requests name. The rest meets orders only where an
    id is held by several of them (a line comes once per order), so long texts aren't exchanged.
    """
    named = requests.select(F.col("order_id").alias("_oid")).distinct()
    o = T["orders"].select(F.col("id").alias("_oid"), "customer_id", "executor_id", F.col("status").alias("_st"))
    o = stored(o.join(named, "_oid", "left_semi"), "message-orders")
    # a generated column: filters on it aren't pushed below it, so a text is made and trimmed once a pass
    lines = requests.select("request_id", "ts", "order_id", "sender_id", "is_admin", F.explode(F.array(js_trim(F.col("message")))).alias("_text"))
    text, admin = F.col("_text"), F.coalesce(F.col("is_admin"), F.lit(False))
    size = F.coalesce(F.length(text), F.lit(0))
    asks = ~admin & size.between(1, 2000)
    other = F.when(F.col("sender_id") == F.col("customer_id"), F.col("executor_id")).otherwise(F.col("customer_id"))
    told = F.col("reason").isNull() & ~F.col("is_admin")

    def judged(j: DataFrame, reason: Column, to: Column) -> DataFrame:
        return j.withColumn("reason", reason).select(
            "request_id", "ts", "order_id", "sender_id",
            F.when(F.col("is_admin"), F.concat(F.lit(ADMIN_PREFIX), text)).otherwise(text).alias("stored"),
            F.when(told, to).alias("notify_user"), F.when(told, F.substring(text, 1, 100)).alias("notify_body"),
            F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("status"), "reason")

    short = stored(lines.filter(asks), "message-short").join(o, F.col("order_id") == F.col("_oid"), "left")
    short = judged(short, F.when(F.col("_oid").isNull() | ~((F.col("sender_id") == F.col("customer_id"))
                                                           | (F.col("sender_id") == F.col("executor_id"))), "participant")
                   .when(F.col("_st").isin(*CLOSED_ORDER_STATES), "closed"), other)
    again = o.groupBy("_oid").count().filter("count > 1").select("_oid")
    again = stored(o.select("_oid").join(again, "_oid", "left_semi"), "message-again")
    rest = _met_again(lines.filter(~asks), again, "order_id", "_oid")
    return short, judged(rest, F.when(~admin | (size < 1), "message"), F.lit(None).cast("string"))


def _met_again(lines: DataFrame, again: DataFrame, key: str, other: str) -> DataFrame:
    """``lines`` left-joined with the rows of ``again`` (of keys that come several times); without any, nothing is joined."""
    if again.isEmpty():
        return lines.withColumns({c: F.lit(None).cast(t) for c, t in again.dtypes})
    return lines.join(again, F.col(key) == F.col(other), "left")


def post_messages(T, requests: DataFrame) -> DataFrame:
    """Accepted chat lines (participant, order open, 1..2000 chars) and the
    notification body for the other side; admin lines skip the checks and get a prefix.
    The line is trimmed first; length, stored text and body are of the trimmed one."""
    short, rest = _judged_messages(T, requests)
    return short.unionByName(rest).drop("ts")


def message_effects(T, requests: DataFrame) -> dict[str, DataFrame]:
    """Accepted chat lines as message rows, and the other side's notification
    (admin lines carry the prefix and notify nobody). A line has the times of all requests with its id."""
    # a line carries its own time; only ids that come again meet the other requests' times
    again = requests.groupBy("request_id").count().filter("count > 1").select("request_id")
    times = stored(requests.select("request_id", "ts").join(again, "request_id", "left_semi").select(
        F.col("request_id").alias("_again"), F.col("ts").alias("_ts")), "message-times")
    acc = []
    for out in _judged_messages(T, requests):
        out = out.filter((F.col("status") == "accepted") & F.col("request_id").isNotNull())
        acc.append(_met_again(out, times, "request_id", "_again").withColumn(
            "ts", F.when(F.col("_again").isNull(), F.col("ts")).otherwise(F.col("_ts"))))
    messages = acc[0].unionByName(acc[1]).select(
        request_uuid("request_id").alias("id"), "order_id", "sender_id", F.col("stored").alias("message"),
        F.lit(False).alias("is_read"), F.col("ts").alias("created_at"))
    # the rest notifies nobody
    notes = acc[0].filter(F.col("notify_user").isNotNull()).select(
        F.concat(F.lit("nm-"), request_uuid("request_id")).alias("id"), F.col("notify_user").alias("user_id"),
        F.lit("new_message").alias("type"), F.lit(TEXT["new_message_title"]).alias("title"),
        F.col("notify_body").alias("body"), F.to_json(F.struct("order_id")).alias("data"),
        F.col("ts").alias("created_at"))
    return {"messages": messages, "notifications": notes}


def mark_read(T, requests: DataFrame) -> dict[str, DataFrame]:
    """A reader marks an order's messages from others read; order_id null = all notifications."""
    # the smallest and the largest reader of an order tell whether anyone but the sender has read
    readers = requests.filter(F.col("order_id").isNotNull()).groupBy(F.col("order_id").alias("_o")).agg(
        F.min("user_id").alias("_lo"), F.max("user_id").alias("_hi"))
    other = (F.col("_lo") != F.col("sender_id")) | (F.col("_hi") != F.col("sender_id"))
    messages = (T["messages"].join(readers, F.col("order_id") == F.col("_o"), "left")
                .withColumn("is_read", F.col("is_read") | F.coalesce(other, F.lit(False))).drop("_o", "_lo", "_hi"))
    users = requests.filter(F.col("order_id").isNull()).select(F.col("user_id").alias("_u")).distinct()
    n = T["notifications"].join(users, F.col("user_id") == F.col("_u"), "left")
    notifications = n.withColumn("is_read", F.col("is_read") | F.col("_u").isNotNull()).drop("_u")
    return {"messages": messages, "notifications": notifications}


# ----------------------------------------------------------------------------- C10
def create_services(T, requests: DataFrame) -> DataFrame:
    """Service rows of requests that pass Q5; tags default to '[]', counters 0."""
    from souk.operators.audits import service_errors
    errs = service_errors(F.col("title"), F.col("description"), F.col("price"), F.col("deadline"),
                          F.col("category_id"))
    return requests.withColumn("errors", F.array_join(errs, ",")).select(
        "request_id", request_uuid("request_id").alias("id"), F.col("actor_id").alias("executor_id"), "category_id",
        js_trim(F.col("title")).alias("title"), js_trim(F.col("description")).alias("description"), "price", "deadline",
        F.lit(True).alias("is_active"), F.coalesce(F.col("tags"), F.lit("[]")).alias("tags"),
        F.coalesce(F.col("is_negotiable"), F.lit(False)).alias("is_negotiable"),
        F.lit(0).cast("decimal(3,2)").alias("rating"), F.lit(0).alias("reviews_count"),
        F.lit(0).alias("orders_count"), F.col("ts").alias("created_at"),
        F.when(F.col("errors") == "", "accepted").otherwise("rejected").alias("status"), "errors")


def update_services(T, requests: DataFrame) -> DataFrame:
    """The last request per service replaces its fields.

    Owners only (admins: any). An owner's price must be in (0, 500000] and deadline in
    (0, 180]; an admin's missing or zero price/deadline becomes 1. Title, description
    and category are required (the columns are NOT NULL); tags default to '[]',
    ``is_negotiable`` to false, and ``is_active`` is kept when absent.
    """
    s = T["services"]
    last = first_per_key(requests, "service_id", last=True)
    j = s.join(last.withColumnRenamed("service_id", "id"), "id", "left")
    admin = F.coalesce(F.col("is_admin"), F.lit(False))
    price = F.when(admin, F.when(F.coalesce(F.col("new_price"), F.lit(0)) != 0, F.col("new_price"))
                   .otherwise(F.lit(1))).otherwise(F.col("new_price"))
    deadline = F.when(admin, F.when(F.coalesce(F.col("new_deadline"), F.lit(0)) != 0, F.col("new_deadline"))
                      .otherwise(F.lit(1))).otherwise(F.col("new_deadline"))
    reason = (F.when(F.col("request_id").isNull(), F.lit(None))
              .when(~admin & (F.col("actor_id") != F.col("executor_id")), "owner")
              .when(F.col("new_title").isNull() | F.col("new_description").isNull()
                    | F.col("new_category_id").isNull(), "fields")
              .when(~admin & ~F.coalesce((F.col("new_price") > 0) & (F.col("new_price") <= 500000), F.lit(False)),
                    "price")
              .when(~admin & ~F.coalesce((F.col("new_deadline") > 0) & (F.col("new_deadline") <= 180), F.lit(False)),
                    "deadline"))
    j = j.withColumn("_reason", reason)
    apply = F.col("request_id").isNotNull() & F.col("_reason").isNull()

    def pick(new: Column, old: str) -> Column:
        return F.when(apply, new).otherwise(F.col(old))
    return j.select(
        "id", "executor_id",
        pick(F.col("new_category_id"), "category_id").alias("category_id"),
        pick(F.col("new_title"), "title").alias("title"),
        pick(F.col("new_description"), "description").alias("description"),
        pick(price.cast("decimal(12,2)"), "price").alias("price"),
        pick(deadline.cast("int"), "deadline").alias("deadline"),
        pick(F.coalesce(F.col("new_is_active"), F.col("is_active")), "is_active").alias("is_active"),
        pick(F.coalesce(F.col("new_tags"), F.lit("[]")), "tags").alias("tags"),
        pick(F.coalesce(F.col("new_is_negotiable"), F.lit(False)), "is_negotiable").alias("is_negotiable"),
        "rating", "reviews_count", "orders_count", "created_at",
        F.col("request_id").alias("applied_request"), F.col("_reason").alias("reason"))


def toggle_flags(df: DataFrame, requests: DataFrame, key: str, flag: str,
                 allowed: Column | None = None) -> DataFrame:
    """An odd number of accepted toggles flips the flag (C10c, C11d)."""
    req = requests if allowed is None else requests.filter(allowed)
    n = req.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    j = df.join(n, F.col("id") == F.col("_k"), "left")
    return j.withColumn(flag, F.when(F.coalesce(F.col("_n"), F.lit(0)) % 2 == 1, ~F.col(flag))
                        .otherwise(F.col(flag))).drop("_k", "_n")


def toggle_services(T, requests: DataFrame) -> DataFrame:
    """Admins only; an odd number of toggles flips a service."""
    return toggle_flags(T["services"], requests.filter("is_admin"), "service_id", "is_active")


def delete_services(T, requests: DataFrame) -> dict[str, DataFrame]:
    """C10d: own services only (admins: any); services an order refers to are refused."""
    s = T["services"].select(F.col("id").alias("_sid"), F.col("executor_id").alias("_ex"))
    used = T["orders"].select(F.col("service_id").alias("_used")).distinct()
    j = (requests.join(s, F.col("service_id") == F.col("_sid"), "left")
         .join(used, F.col("service_id") == F.col("_used"), "left"))
    reason = (F.when(F.col("_sid").isNull(), "service")
              .when(~(F.col("is_admin") | (F.col("actor_id") == F.col("_ex"))), "owner")
              .when(F.col("_used").isNotNull(), "referenced"))
    out = j.select("request_id", "service_id", "actor_id",
                   F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"),
                   reason.alias("reason"))
    gone = out.filter(F.col("status") == "accepted").select(F.col("service_id").alias("id")).distinct()
    return {"outcomes": out, "services": T["services"].join(gone, "id", "left_anti")}


# ----------------------------------------------------------------------------- C11
def register_users(T, requests: DataFrame) -> DataFrame:
    """C11a outcomes: input rules, lower-cased e-mail not taken, first request per e-mail wins;
    e-mails are compared as the tables do (D1)."""
    from souk.operators.audits import request_reason
    from souk.functions.text import normalized_email
    r = requests.withColumn("email_n", normalized_email("email"))
    r = r.withColumn("reason", request_reason("register", r))
    r = r.withColumn("_key", collated(F.col("email_n")))
    taken = T["users"].select(collated(F.col("email")).alias("_taken")).distinct()
    r = r.join(taken, F.col("_key") == F.col("_taken"), "left")
    r = r.withColumn("reason", F.coalesce("reason", F.when(F.col("_taken").isNotNull(), "taken")))
    first = first_per_key(r.filter(F.col("reason").isNull()).select("_key", "ts", "request_id"), "_key") \
        .select(F.col("request_id").alias("_win"))
    r = r.join(first, F.col("request_id") == F.col("_win"), "left")
    return r.select("request_id", js_trim(F.col("name")).alias("name"), F.col("email_n").alias("email"), "role",
                    F.when(F.col("_win").isNotNull(), "accepted").otherwise("rejected").alias("status"),
                    F.coalesce(F.col("reason"), F.when(F.col("_win").isNull(), "duplicate")).alias("reason"),
                    F.when(F.col("_win").isNotNull(), request_uuid("request_id")).alias("user_id"))


def register_effects(T, requests: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    """New user rows of accepted registrations, made at the request's time, and their zero balances (insert-ignore)."""
    acc = outcomes.filter(F.col("status") == "accepted").join(requests.select("request_id", "ts"), "request_id")
    users = acc.select(F.col("user_id").alias("id"), "name", "email", "role", F.lit(True).alias("is_active"),
                       F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    zero = acc.select("user_id", F.lit(0).cast("decimal(12,2)").alias("amount"))
    balances = insert_ignore(T["balances"].select("user_id", "amount"), zero, "user_id")
    return {"users": users, "balances": balances}


def update_users(T, requests: DataFrame) -> DataFrame:
    """Last valid request per user; a name that is given is trimmed and has two
    characters at least, else the whole request is refused; the bio is replaced unless null."""
    name = js_trim(F.col("name"))
    ok = requests.filter(F.col("name").isNull() | (F.length(name) >= 2))
    last = first_per_key(ok, "user_id", last=True).select(
        F.col("user_id").alias("id"), name.alias("_n"), F.col("bio").alias("_b"))
    j = T["users"].join(last, "id", "left")
    return (j.withColumn("name", F.coalesce("_n", "name"))
            .withColumn("bio", F.coalesce("_b", "bio")).drop("_n", "_b"))


def _json_array_or(col: str, empty_ok: bool = True) -> Column:
    n = F.json_array_length(F.col(col))
    ok = n.isNotNull() if empty_ok else F.coalesce(n > 0, F.lit(False))
    return F.when(ok, F.col(col)).otherwise(F.lit("[]"))


def upsert_profiles(T, requests: DataFrame) -> DataFrame:
    """The last request per user. Executors set every profile field (defaults:
    available, '< 24 часов', empty lists); other users set only their socials. A
    profile row is created when missing."""
    last = first_per_key(requests, "actor_id", last=True)
    role = T["users"].select(F.col("id").alias("actor_id"), "role")
    r = last.join(role, "actor_id")
    is_exec = F.col("role") == "executor"
    nonempty = lambda c: F.when(F.length(F.col(c)) > 0, F.col(c))
    socials = F.when(F.json_object_keys(F.col("socials")).isNotNull(), F.col("socials")).otherwise(F.lit("{}"))
    new = r.select(
        F.col("actor_id").alias("user_id"), is_exec.alias("_exec"),
        F.coalesce(nonempty("availability"), F.lit("available")).alias("n_availability"),
        nonempty("specialization").alias("n_specialization"),
        F.when(F.coalesce(F.col("hourly_rate"), F.lit(0)) != 0, F.col("hourly_rate"))
        .cast("decimal(10,2)").alias("n_hourly_rate"),
        F.coalesce(nonempty("response_time"), F.lit(TEXT["default_response_time"])).alias("n_response_time"),
        _json_array_or("languages", empty_ok=False).alias("n_languages"),
        _json_array_or("skills").alias("n_skills"), _json_array_or("portfolio").alias("n_portfolio"),
        socials.alias("n_socials"))
    p = T["profiles"]
    j = p.join(new, "user_id", "full_outer")
    ex = F.coalesce(F.col("_exec"), F.lit(False))
    cols = [F.col("user_id")]
    for c in ("availability", "specialization", "hourly_rate", "response_time", "languages", "skills",
              "portfolio"):
        cols.append(F.when(ex, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c))
    cols.append(F.coalesce(F.col("n_socials"), F.col("socials")).alias("socials"))
    return j.select(*cols)


def change_roles(T, requests: DataFrame) -> DataFrame:
    """C11e: valid role, not oneself; the last such request per user wins."""
    ok = requests.filter(F.col("role").isin("customer", "executor", "admin")
                         & (F.col("actor_id") != F.col("user_id")))
    last = first_per_key(ok, "user_id", last=True).select(F.col("user_id").alias("id"), F.col("role").alias("_r"))
    return T["users"].join(last, "id", "left").withColumn("role", F.coalesce("_r", "role")).drop("_r")


def toggle_users(T, requests: DataFrame) -> DataFrame:
    """C11d: block/unblock, never oneself."""
    return toggle_flags(T["users"], requests, "user_id", "is_active", F.col("actor_id") != F.col("user_id"))


def soft_delete_users(T, requests: DataFrame, as_of) -> DataFrame:
    """C11f: users delete themselves with a ``confirmed`` request (the caller has checked the password; null is no):
    deactivated, e-mail gets ``_deleted_<unix time>``, name a suffix."""
    from souk.functions.predicates import ts_lit
    own = requests.filter((F.col("actor_id") == F.col("user_id")) & F.col("confirmed"))
    ids = own.select(F.col("user_id").alias("_d")).distinct()
    j = T["users"].join(ids, F.col("id") == F.col("_d"), "left")
    hit = F.col("_d").isNotNull()
    stamp = F.unix_timestamp(ts_lit(as_of)).cast("string")
    return (j.withColumn("email", F.when(hit, F.concat("email", F.lit("_deleted_"), stamp)).otherwise(F.col("email")))
            .withColumn("name", F.when(hit, F.concat("name", F.lit(TEXT["deleted_name_suffix"]))).otherwise(F.col("name")))
            .withColumn("is_active", F.when(hit, F.lit(False)).otherwise(F.col("is_active")))
            .drop("_d"))


# ----------------------------------------------------------------------------- C12 / C13
def notify_all(T, requests: DataFrame, salts: int = 64) -> DataFrame:
    """One notification per active user (of the request's role, when given).

    A role has few values and most users share one, so joining on the role alone
    would send nearly every user to one task. Users get a salt ``hash(id) % salts``
    and every request is copied once per salt; the equi-join on (role, salt) spreads
    each role over ``salts`` tasks. No cartesian product: a request without a role
    expands over the role list first.
    """
    roles = F.array(F.lit("customer"), F.lit("executor"), F.lit("admin"))
    r = (requests.filter(F.col("title").isNotNull() & (F.length("title") > 0))
         .withColumn("_role", F.explode(F.when(F.col("role").isNotNull(), F.array(F.col("role"))).otherwise(roles)))
         .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    u = T["users"].filter(F.col("is_active")).select(
        F.col("id").alias("user_id"), F.col("role").alias("_urole"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("_usalt"))
    return (r.join(u, (F.col("_role") == F.col("_urole")) & (F.col("_salt") == F.col("_usalt")))
            .select(F.concat(F.lit("nb-"), request_uuid("request_id", "user_id")).alias("id"), "user_id",
                    F.lit("admin").alias("type"), "title", "body", F.col("ts").alias("created_at")))


def add_categories(T, requests: DataFrame) -> DataFrame:
    """Name and slug present, slug new (first request wins); defaults for icon,
    description and place. New ids follow the largest one in request order."""
    ok = requests.filter(F.col("name").isNotNull() & (F.length("name") > 0)
                         & F.col("slug").isNotNull() & (F.length("slug") > 0))
    cats = T["categories"].select("id", "name", "slug", "icon", "description", "sort_order")
    maxid = cats.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_m"))
    first = first_per_key(ok.select("slug", "name", "icon", "description", "sort_order", "ts", "request_id"), "slug")
    new = first.join(cats.select(F.col("slug")), "slug", "left_anti")
    nonempty = lambda c, d: F.when(F.length(c) > 0, F.col(c)).otherwise(F.lit(d)).alias(c)
    new = running_totals(new, [F.col("ts"), F.col("request_id")], {"_before": F.lit(1)}, "new-categories")
    new = (new.crossJoin(F.broadcast(maxid))                     # one row
           .select((F.col("_m") + F.col("_before") + 1).cast("int").alias("id"), "name", "slug",
                   nonempty("icon", TEXT["default_category_icon"]), nonempty("description", ""),
                   F.coalesce(F.col("sort_order"), F.lit(99)).cast("int").alias("sort_order")))
    return cats.unionByName(new)


def delete_by_id(df: DataFrame, requests: DataFrame, owner_col: str | None = None) -> DataFrame:
    """Drop rows named by id (and, for own rows, by the owner too)."""
    if owner_col is None:
        return df.join(requests.select("id").distinct(), "id", "left_anti")
    ids = requests.select("id", F.col("actor_id").alias(owner_col)).distinct()
    return df.join(ids, ["id", owner_col], "left_anti")

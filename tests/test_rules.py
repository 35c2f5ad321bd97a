"""Rule tests on hand-written frames: the edge rows of FIXTURES.md section 4."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from souk.functions import predicates as P
from souk.functions import text as X
from souk.operators import changes as C
from souk.operators import history as H
from souk.operators import reports as R
from souk.operators import retention as RT
from souk.operators import views as V
from souk.streaming import streams as S

D = Decimal
ts = dt.datetime


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


USERS = "id string, name string, email string, role string, bio string, is_active boolean, " \
        "created_at timestamp, updated_at timestamp"
SERVICES = "id string, executor_id string, category_id int, title string, description string, " \
           "price decimal(12,2), deadline int, is_active boolean, tags string, is_negotiable boolean, " \
           "rating decimal(3,2), reviews_count int, orders_count int, created_at timestamp"
ORDERS = "id string, service_id string, customer_id string, executor_id string, status string, " \
         "total_price decimal(12,2), deadline_date date, requirements string, created_at timestamp, " \
         "updated_at timestamp"
T0 = ts(2001, 8, 1)


@pytest.fixture(scope="module")
def base(spark):
    users = df(spark, [
        ("c1", "Ann", "ann@gmail.com", "customer", None, True, T0, T0),
        ("c2", "Bob", "bob@mail.ru", "customer", None, True, T0, T0),
        ("s1", "Eve", "eve@yandex.ru", "executor", None, True, T0, T0),
        ("s2", "Max", "max@ya.ru", "executor", None, True, T0, T0),
    ], USERS)
    services = df(spark, [
        ("p1", "s1", 1, "Logo design pro", "x" * 40, D("100.00"), 3, True, '["logo","Дизайн"]', False,
         D("0"), 0, 0, T0),
        ("p2", "s2", 2, "Sales 50%_off", "y" * 40, D("50.00"), 3, False, '["sale"]', False, D("0"), 0, 0, T0),
        ("p3", "c1", 1, "Own service!", "z" * 40, D("10.00"), 3, True, "not json", False, D("0"), 0, 0, T0),
    ], SERVICES)
    cats = df(spark, [(1, "Design", "design", 1), (2, "Other", "other", 2)], "id int, name string, slug string, sort_order int")
    profiles = df(spark, [("s1", None), ("s2", "busy")], "user_id string, availability string")
    balances = df(spark, [("c1", D("100.00")), ("c2", D("30.00"))], "user_id string, amount decimal(12,2)")
    orders = df(spark, [
        ("o1", "p1", "c1", "s1", "created", D("100.00"), None, None, T0, T0),
        ("o2", "p1", "c2", "s1", "completed", D("100.00"), None, None, T0, T0),
        ("o3", "p1", "c2", "s1", "cancelled", D("100.00"), None, None, T0, ts(2001, 5, 4)),
    ], ORDERS)
    reviews = df(spark, [], "id string, order_id string, service_id string, customer_id string, "
                            "executor_id string, rating int, comment string, created_at timestamp")
    return {"users": users, "services": services, "categories": cats, "profiles": profiles,
            "balances": balances, "orders": orders, "reviews": reviews}


# ----------------------------------------------------------------------------- C1
def test_place_orders_edges(spark, base):
    req = df(spark, [
        ("r1", ts(2001, 8, 2, 1), "c1", "p1", None),      # balance == price → accepted
        ("r2", ts(2001, 8, 2, 2), "c1", "p1", None),      # nothing left → funds
        ("r3", ts(2001, 8, 2, 3), "c1", "p3", None),      # own service
        ("r4", ts(2001, 8, 2, 4), "c2", "p2", None),      # inactive service
        ("r5", ts(2001, 8, 2, 5), "c2", "zz", None),      # unknown service
        ("r7", ts(2001, 8, 2, 7), "c2", "p1", None),      # covered by the deposit before it
    ], "request_id string, ts timestamp, customer_id string, service_id string, requirements string")
    dep = df(spark, [("r6", ts(2001, 8, 2, 6), "c2", D("180.00")), ("r8", ts(2001, 8, 2, 8), "c2", D("5.00"))],
             "request_id string, ts timestamp, user_id string, amount decimal(12,2)")
    out = {r.request_id: r for r in C.place_orders(base, req, dep).collect()}
    assert (out["r1"].status, out["r1"].balance_after) == ("accepted", D("0.00"))
    assert out["r2"].reason == "funds"
    assert out["r3"].reason == "own"
    assert out["r4"].reason == "service" and out["r5"].reason == "service"
    assert out["r6"].status == "accepted" and out["r6"].balance_after == D("210.00")
    assert out["r7"].status == "accepted" and out["r7"].balance_after == D("110.00")
    assert out["r8"].reason == "amount"


def test_place_orders_independent_of_input_layout(spark, base):
    req = df(spark, [(f"r{i:03d}", ts(2001, 8, 2, i % 24, i // 24), "c1" if i % 2 else "c2", "p1", None)
                     for i in range(60)],
             "request_id string, ts timestamp, customer_id string, service_id string, requirements string")
    a = sorted(C.place_orders(base, req).collect())
    b = sorted(C.place_orders(base, req.repartition(7).orderBy(F.rand(3))).collect())
    assert a == b


# ----------------------------------------------------------------------------- C2 / C5
def test_status_changes(spark, base):
    req = df(spark, [
        ("a", ts(2001, 8, 2, 1), "o2", "c2", "cancelled", None),    # completed → cancelled refused
        ("b", ts(2001, 8, 2, 1), "o1", "c2", "cancelled", None),    # not a participant
        ("c", ts(2001, 8, 2, 2), "o1", "s1", "review", None),       # created → review refused
        ("d", ts(2001, 8, 2, 3), "o1", "s1", "in_progress", None),
        ("e", ts(2001, 8, 2, 4), "o1", "s1", "review", None),
        ("f", ts(2001, 8, 2, 5), "o1", "c1", "completed", None),
    ], "request_id string, ts timestamp, order_id string, actor_id string, new_status string, note string")
    out = {r.request_id: r for r in C.apply_status_changes(base, req).collect()}
    assert out["a"].reason == "transition" and out["b"].reason == "participant"
    assert out["c"].reason == "transition"
    assert [out[k].status for k in "def"] == ["accepted"] * 3
    eff = C.status_effects(base, C.apply_status_changes(base, req), req)
    tx = eff["transactions"].collect()
    assert len(tx) == 1 and tx[0].user_id == "s1" and tx[0].amount == D("100.00")
    bal = {r.user_id: r.amount for r in eff["balances"].collect()}
    assert bal["s1"] == D("100.00")
    assert {r.id: r.status for r in eff["orders"].collect()}["o1"] == "completed"
    notes = eff["notifications"].collect()
    assert sorted(n.body for n in notes if n.type == "order_accepted") == [
        "«created» → «in_progress»", "«in_progress» → «review»", "«review» → «completed»"]
    paid = [n for n in notes if n.type == "payment_received"]
    assert len(paid) == 1 and paid[0].user_id == "s1" and paid[0].body == "Зачислено 100 ₽"


def test_force_status_pays_once(spark, base):
    req = df(spark, [("a", ts(2001, 8, 2, 1), "o2", "a0", "in_progress", None),
                     ("a2", ts(2001, 8, 2, 1, 30), "o2", "a0", "bogus", None),
                     ("b", ts(2001, 8, 2, 2), "o2", "a0", "completed", None),
                     ("c", ts(2001, 8, 2, 3), "o1", "a0", "cancelled", None),
                     ("z", ts(2001, 8, 2, 3), "o404", "a0", "cancelled", None)],
             "request_id string, ts timestamp, order_id string, actor_id string, new_status string, note string")
    out = {r.request_id: r for r in C.force_status(base, req).collect()}
    assert out["a"].old_status == "completed" and not out["a"].pays_executor
    assert out["b"].old_status == "in_progress" and out["b"].pays_executor      # X11 kept
    assert out["c"].refunds_customer
    assert (out["a2"].status, out["a2"].reason) == ("rejected", "status")
    assert (out["z"].status, out["z"].reason) == ("rejected", "order") and not out["z"].refunds_customer


def test_forced_status_effects_tell_both_sides(spark, base):
    req = df(spark, [("a", ts(2001, 8, 2, 1), "o2", "a0", "in_progress", "mistake"),
                     ("b", ts(2001, 8, 2, 2), "o2", "a0", "completed", None),
                     ("c", ts(2001, 8, 2, 3), "o1", "a0", "cancelled", "")],
             "request_id string, ts timestamp, order_id string, actor_id string, new_status string, note string")
    eff = C.forced_status_effects(base, C.force_status(base, req), req)
    notes = eff["notifications"].collect()
    assert len(notes) == 6 and len({n.id for n in notes}) == 6 and {n.type for n in notes} == {"admin"}
    said = {(n.user_id, n.body) for n in notes}
    assert ("c2", "Статус изменён с «completed» на «in_progress». Причина: mistake") in said
    assert ("s1", "Статус изменён с «created» на «cancelled»") in said and ("c1", "Статус изменён с «created» на «cancelled»") in said
    assert sorted((t.user_id, t.description) for t in eff["transactions"].collect()) == [
        ("c1", "возврат по решению администратора"), ("s1", "выплата по решению администратора")]
    assert sorted(r.note for r in eff["status_log"].collect()) == ["mistake"] + ["принудительно изменено администратором"] * 2


def test_chat_lines_are_trimmed_first(spark, base):
    req = df(spark, [("a", ts(2001, 8, 2, 1), "o1", "c1", "  hi \n", False), ("b", ts(2001, 8, 2, 2), "o1", "c1", " \t\n", False),
                     ("c", ts(2001, 8, 2, 3), "o1", "c1", " " * 50 + "x" * 2000 + "\n", False),
                     ("d", ts(2001, 8, 2, 4), "o1", "c1", "x" * 2001, False)],
             "request_id string, ts timestamp, order_id string, sender_id string, message string, is_admin boolean")
    out = {r.request_id: r for r in C.post_messages(base, req).collect()}
    assert (out["a"].stored, out["a"].notify_body, out["a"].status) == ("hi", "hi", "accepted")
    assert [out[k].reason for k in "bcd"] == ["message", None, "message"] and out["c"].notify_body == "x" * 100


def test_profile_names_have_two_letters(spark, base):
    req = df(spark, [("a", ts(2001, 8, 2, 1), "c1", " x ", "lost"), ("b", ts(2001, 8, 2, 1), "c2", "  Bo ", None),
                     ("c", ts(2001, 8, 2, 2), "s1", "", "lost"), ("d", ts(2001, 8, 2, 1), "s1", None, "kept")],
             "request_id string, ts timestamp, user_id string, name string, bio string")
    before = {r.id: r for r in base["users"].collect()}
    out = {r.id: r for r in C.update_users(base, req).collect()}
    assert (out["c1"].name, out["c1"].bio) == (before["c1"].name, before["c1"].bio)
    assert out["c2"].name == "Bo" and (out["s1"].name, out["s1"].bio) == (before["s1"].name, "kept")


def test_stored_comment(spark, base):
    req = df(spark, [("x", ts(2001, 8, 2, 1), "c2", "o2", 5, " \n ")],
             "request_id string, ts timestamp, customer_id string, order_id string, rating int, comment string")
    out = C.apply_reviews(base, req)
    assert out.first().comment is None and C.review_rows(base, req, out).first().comment is None


# ----------------------------------------------------------------------------- C4
def test_two_reviews_for_one_order(spark, base):
    req = df(spark, [("x1", ts(2001, 8, 2, 1), "c2", "o2", 5, None),
                     ("x2", ts(2001, 8, 2, 2), "c2", "o2", 4, None),
                     ("x3", ts(2001, 8, 2, 3), "c1", "o1", 5, None),
                     ("x4", ts(2001, 8, 2, 4), "c2", "o2", 9, None)],
             "request_id string, ts timestamp, customer_id string, order_id string, rating int, comment string")
    out = {r.request_id: (r.status, r.reason) for r in C.apply_reviews(base, req).collect()}
    assert out == {"x1": ("accepted", None), "x2": ("rejected", "duplicate"),
                   "x3": ("rejected", "status"), "x4": ("rejected", "rating")}


# ----------------------------------------------------------------------------- C14 / C15
def test_upsert_and_insert_ignore(spark):
    bal = df(spark, [("a", D("1.00")), ("b", D("2.00"))], "user_id string, amount decimal(12,2)")
    ch = df(spark, [("b", D("3.00")), ("b", D("1.00")), ("c", D("5.00"))], "user_id string, amount decimal(12,2)")
    assert dict(C.upsert(bal, ch, "user_id", "amount", "add").collect()) == \
        {"a": D("1.00"), "b": D("6.00"), "c": D("5.00")}
    one = df(spark, [("b", D("9.00"))], "user_id string, amount decimal(12,2)")
    assert dict(C.upsert(bal, one, "user_id", "amount", "set").collect()) == {"a": D("1.00"), "b": D("9.00")}
    new = df(spark, [("b", D("7.00")), ("d", D("4.00"))], "user_id string, amount decimal(12,2)")
    assert dict(C.insert_ignore(bal, new, "user_id").collect()) == {"a": D("1.00"), "b": D("2.00"), "d": D("4.00")}


# ----------------------------------------------------------------------------- P / J
def test_catalog_visibility_and_search(spark, base):
    rows = V.catalog(base).collect()
    assert {r.id for r in rows} == {"p1", "p3"}          # s2 busy and p2 inactive; c1 has no profile
    assert [r.id for r in V.catalog(base, search="LOGO").collect()] == ["p1"]            # title, any case
    assert [r.id for r in V.catalog(base, search="ДИЗАЙН").collect()] == []              # tags compare case-sensitively
    assert [r.id for r in V.catalog(base, search="Дизайн").collect()] == ["p1"]
    assert [r.id for r in V.catalog(base, search="l_go").collect()] == ["p1"]             # _ is a wildcard
    assert [r.id for r in V.catalog(base, min_price=0, max_price=10).collect()] == ["p3"]  # 0 = no bound, inclusive


# ----------------------------------------------------------------------------- R
def test_retention_cutoff_is_strict(spark, base):
    t = dict(base)
    t["orders"] = base["orders"].withColumn(
        "updated_at", F.when(F.col("id") == "o3", F.lit(ts(2001, 5, 4))).otherwise(F.col("updated_at")))
    for name in ("messages", "status_log", "transactions", "notifications"):
        t[name] = spark.createDataFrame([], "id string, order_id string, user_id string")
    step = RT.retire_cancelled_orders(t, ts(2001, 8, 2), days=90)     # 2001-05-04 is exactly 90 days back
    assert step.removed.count() == 0
    step = RT.retire_cancelled_orders(t, ts(2001, 8, 2, 0, 0, 1), days=90)
    assert [r.id for r in step.removed.collect()] == ["o3"]


# ----------------------------------------------------------------------------- T1
def test_limiter_window_edge(spark):
    a = df(spark, [(1, "k", ts(2024, 1, 1, 0)), (2, "k", ts(2024, 1, 1, 1)), (3, "k", ts(2024, 1, 1, 12)),
                   (4, "k", ts(2024, 1, 1, 12, 0, 1)), (5, "k", ts(2024, 1, 2, 0, 0, 2))],
           "attempt_id long, attempt_key string, ts timestamp")
    out = {r.attempt_id: (r.attempt_count, r.blocked) for r in S.limit_attempts(a, S.Policy(2, 12 * 3600)).collect()}
    # exactly at the window length stays inside (reset needs strictly more)
    assert out == {1: (1, False), 2: (2, False), 3: (3, True), 4: (1, False), 5: (1, False)}


# ----------------------------------------------------------------------------- Q6 / Q7
@pytest.mark.parametrize("email,ok", [
    ("user@gmail.com", True), ("  USER@Mail.RU ", True), ("a@sub.mail.ru", True), ("x@corp.mail.ru", True),
    ("no-at-sign.gmail.com", False), ("a@b@gmail.com", False), ("123@123.ru", False),
    ("u@corp.example.org", False), ("u@gmail.c", False), ("u@gmail.com\n", True),
])
def test_email_rules(spark, email, ok):
    got = spark.createDataFrame([(email,)], "email string").select(X.email_ok("email")).first()[0]
    assert got is ok


@pytest.mark.parametrize("text,field,reason", [
    ("x" * 201, "title", "too_long"), ("Ааааааа", "message", "repeat"), ("see http://a.bc now", "message", "link"),
    ("Buy CASINO now", "message", "stop_word"), ("яcrypto", "message", "stop_word"),
    ("cryptography", "message", None), ("".join(chr(0x430 + i % 32) for i in range(50)), "message", "non_ascii"),
    ("я" * 50, "message", "repeat"), ("fine text", "title", None),
    ("", "title", None), ("aaaaaa\naaaaaa", "message", None),
])
def test_screening(spark, text, field, reason):
    got = spark.createDataFrame([(text, field)], "t string, f string").select(
        X.screen_reason(F.col("t"), F.col("f"))).first()[0]
    assert got == reason


# ----------------------------------------------------------------------------- W building blocks
def test_skew_safe_windows_match_plain_windows(spark):
    from pyspark.sql import Window
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", ts(2024, 1, 1) + dt.timedelta(minutes=37 * i), float(i % 11 - 5))
            for i in range(600)]
    d = df(spark, rows, "id long, key string, t timestamp, v double")
    w = Window.partitionBy("key").orderBy(F.col("t").desc(), "id")
    plain = d.withColumn("rn", F.row_number().over(w).cast("bigint")).filter("rn <= 7")
    top = H.top_k_per_key(d, "key", [F.col("t").desc(), F.col("id")], 7)
    assert sorted(plain.collect()) == sorted(top.select(*plain.columns).collect())
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange hashpartitioning") == 1
    w2 = Window.partitionBy("key").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    a = {r.id: r.s for r in d.withColumn("s", F.sum("v").over(w2)).collect()}
    b = {r.id: r.running for r in H.running_sum(d, "key", "t", "id", F.col("v")).collect()}
    assert a == b
    brute = {}
    for i, k, t, _ in rows:
        brute[i] = sum(1 for j, k2, t2, _ in rows if k2 == k and j != i and t - dt.timedelta(hours=5) <= t2 <= t)
    got = {r.id: r.earlier for r in H.trailing_count(d, "key", "t", 5 * 3600).collect()}
    assert got == brute


def test_executor_stats_fanout_literal(spark, base):
    out = {r.executor_id: r for r in R.executor_stats(base, fanout=True).collect()}
    assert out["s1"].completed_orders == 1 and out["s1"].services_count == 1
    assert out["s1"].completed_orders_fanout == 1


def test_predicates(spark):
    d = df(spark, [(ts(2001, 8, 2, 5),), (ts(2001, 8, 3),), (ts(2001, 7, 3),)], "t timestamp")
    assert d.filter(P.on_day("t", "2001-08-02 10:00:00")).count() == 1
    assert d.filter(P.since("t", "2001-08-02 00:00:00", 30)).count() == 3
    assert d.filter(P.older_than("t", "2001-08-02 00:00:00", 30)).count() == 0
    lv = spark.createDataFrame([(150,), (30,), (10,), (9,), (None,)], "n int").select(P.executor_level("n")).collect()
    assert [r[0] for r in lv] == ["master", "expert", "pro", "novice", "novice"]


def test_orphans_and_duplicates_are_found(spark, base):
    from souk.operators import audits as Q
    t = dict(base)
    t["orders"] = base["orders"].unionByName(spark.createDataFrame(
        [("o9", "p404", "c1", "ghost", "created", D("1.00"), None, None, T0, T0),
         ("o1", "p1", "c1", "s1", "created", D("1.00"), None, None, T0, T0)], ORDERS))
    empty = "id string, order_id string, sender_id string, user_id string, new_status string, " \
            "customer_id string, executor_id string, service_id string"
    for name in ("status_log", "messages", "transactions", "notifications"):
        t[name] = spark.createDataFrame([], empty)
    t["reviews"] = spark.createDataFrame([("r1", "o404", "p1", "c1", "s1")],
                                         "id string, order_id string, service_id string, customer_id string, "
                                         "executor_id string")
    t["profiles"] = spark.createDataFrame([("zz", None)], "user_id string, availability string")
    got = {(r.fk, r.row_key, r.ref) for r in Q.orphans(t).collect()}
    assert got == {("fk_ord_svc", "o9", "p404"), ("fk_ord_exec", "o9", "ghost"),
                   ("fk_rev_order", "r1", "o404"), ("fk_profile_user", "zz", "zz")}
    dup = {(r.table_name, r.key_value, r.n) for r in Q.duplicate_keys(t["orders"], ["id"]).select(
        F.lit("orders").alias("table_name"), F.col("id").alias("key_value"), "n").collect()}
    assert dup == {("orders", "o1", 2)}


def test_duplicate_keys_bound_the_rows_of_a_task(spark, monkeypatch):
    from souk.operators import audits as Q
    monkeypatch.setattr(Q, "ROWS_PER_TASK", 500, raising=False)
    d = spark.range(4000).selectExpr("concat('k', id % 2000) AS id", "cast(null as string) AS other")
    found = Q.duplicate_keys(d, ["id"])
    assert found.columns == ["id", "n"] and {r.n for r in found.select("n").distinct().collect()} == {2}
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 2000 and max(tasks) <= 500
    # rows without a key are counted before they meet in one task
    assert [tuple(r) for r in Q.duplicate_keys(d, ["other"]).collect()] == [(None, 4000)]
    assert Q.duplicate_keys(d.limit(1), ["lower(id)"]).columns == ["lower(id)", "n"]


def test_duplicates_of_every_declared_key(spark, monkeypatch):
    from souk.operators import audits as Q
    monkeypatch.setattr(Q, "ROWS_PER_TASK", 3, raising=False)
    rows = {"users": ([("u1", "A@x.org"), ("u1", "a@X.org"), ("u2", None), (None, "b@x.org"), (None, None)],
                      "id string, email string"),
            "categories": ([("art",), ("art",), ("Art",)], "slug string"),
            "reviews": ([("r1", "o1"), ("r2", "o1"), ("r3", None)], "id string, order_id string"),
            "balances": ([(7,), (7,), (8,), (None,)], "user_id int"), "profiles": ([("p",)], "user_id string")}
    t = {name: spark.createDataFrame(*rows.get(name, ([("x",)], "id string"))) for name, _ in Q.UNIQUE_KEYS}
    found = Q.all_duplicate_keys(t)
    assert found.dtypes == [("table_name", "string"), ("key_name", "string"), ("key_value", "string"), ("n", "bigint")]
    assert sorted((tuple(r) for r in found.collect()), key=str) == [
        ("balances", "user_id", "7", 2), ("categories", "slug", "art", 2), ("reviews", "order_id", "o1", 2),
        ("users", "id", "u1", 2), ("users", "id", None, 2), ("users", "lower(email)", "a@x.org", 2),
        ("users", "lower(email)", None, 2)]
    # every key in the same exchange, dealt by the number of rows: 25 rows, three of them a task
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()


def test_accent_insensitive_search_and_pages(spark, base):
    from souk.functions.predicates import search_cond
    d = spark.createDataFrame([("Дизайн логотипа",), ("Café crème",), ("plain",)], "t string")
    got = [r.t for r in d.filter(search_cond(["t"], "ДИЗАЙН", accent_insensitive=True)).collect()]
    assert got == ["Дизайн логотипа"]
    got = [r.t for r in d.filter(search_cond(["t"], "CAFE", accent_insensitive=True)).collect()]
    assert got == ["Café crème"]
    assert d.filter(search_cond(["t"], "CAFE")).count() == 0          # the default ignores case only
    page = V.catalog_page(base, page=1, limit=1, sort="price_asc")
    assert page.total == 2 and page.pages == 2 and [r.id for r in page.rows.collect()] == ["p3"]


def test_registration_rules(spark, base):
    req = df(spark, [("g1", ts(2001, 8, 2, 1), "New One", "NEW@gmail.com", "customer"),
                     ("g2", ts(2001, 8, 2, 2), "New Two", "new@GMAIL.com", "executor"),   # same e-mail, later
                     ("g3", ts(2001, 8, 2, 3), "Ann Again", "ANN@gmail.com", "customer"),  # taken (any case)
                     ("g4", ts(2001, 8, 2, 4), "Spaced", " sp@gmail.com", "customer"),    # blanks fail the check
                     ("g5", ts(2001, 8, 2, 5), "X", "x@gmail.com", "customer"),           # name too short
                     ("g6", ts(2001, 8, 2, 6), "Boss", "boss@gmail.com", "admin")],       # role not allowed
             "request_id string, ts timestamp, name string, email string, role string")
    out = C.register_users(base, req)
    got = {r.request_id: (r.status, r.reason) for r in out.collect()}
    assert got == {"g1": ("accepted", None), "g2": ("rejected", "duplicate"), "g3": ("rejected", "taken"),
                   "g4": ("rejected", "email"), "g5": ("rejected", "name"), "g6": ("rejected", "role")}
    eff = C.register_effects(base, req, out)
    new = eff["users"].collect()
    assert len(new) == 1 and new[0].email == "new@gmail.com"
    bal = dict(eff["balances"].collect())
    assert bal[new[0].id] == D("0.00") and bal["c1"] == D("100.00")


def test_refund_anomalies_and_ledger_gaps(spark, base):
    from souk.operators import audits as Q
    t = dict(base)
    t["orders"] = base["orders"].unionByName(df(spark, [
        ("o4", "p1", "c1", "s1", "cancelled", D("40.00"), None, None, T0, T0),
        ("o5", "p1", "c1", "s1", "cancelled", D("0.00"), None, None, T0, T0)], ORDERS))
    t["transactions"] = df(spark, [
        ("t1", "c2", "o3", "deposit", D("100.00"), T0),          # o3 was refunded
        ("t2", "c1", None, "payment", D("30.00"), T0),
        ("t3", "c1", None, "deposit", D("130.00"), T0),
        ("t4", "s2", None, "deposit", D("5.00"), T0)],           # s2 has no balance row
        "id string, user_id string, order_id string, type string, amount decimal(12,2), created_at timestamp")
    flagged = [r.id for r in Q.refund_anomalies(t).collect()]
    assert flagged == ["o4"]                                     # o3 refunded, o5 has no price
    gaps = {r.user_id: (r.calculated, r.actual, r.corrected) for r in Q.balance_discrepancies(t).collect()}
    assert gaps == {"c2": (D("100.00"), D("30.00"), D("100.00")), "s2": (D("5.00"), 0, D("5.00"))}
    fixed = dict(Q.fix_balances(t).collect())
    assert fixed == {"c1": D("100.00"), "c2": D("100.00"), "s2": D("5.00")}


def test_price_changes_and_effects(spark, base):
    req = df(spark, [("p1", ts(2001, 8, 2, 1), "o1", "s1", D("120.00"), None),
                     ("p2", ts(2001, 8, 2, 2), "o1", "s1", D("1500.50"), "more work"),
                     ("p3", ts(2001, 8, 2, 3), "o1", "c1", D("90.00"), None),      # customer: not allowed
                     ("p4", ts(2001, 8, 2, 4), "o2", "s1", D("90.00"), None),      # completed order
                     ("p5", ts(2001, 8, 2, 5), "o1", "c2", D("90.00"), None),      # not a participant
                     ("p6", ts(2001, 8, 2, 6), "o1", "s1", D("0.00"), None)],      # no price
             "request_id string, ts timestamp, order_id string, actor_id string, price decimal(12,2), note string")
    out = {r.request_id: (r.status, r.reason) for r in C.apply_price_changes(base, req).collect()}
    assert out == {"p1": ("superseded", None), "p2": ("applied", None), "p3": ("rejected", "executor"),
                   "p4": ("rejected", "status"), "p5": ("rejected", "order"), "p6": ("rejected", "price")}
    eff = C.price_change_effects(base, req)
    assert {r.id: r.total_price for r in eff["orders"].collect()}["o1"] == D("1500.50")
    chat = sorted(r.message for r in eff["messages"].collect())
    assert chat == ["💰 Исполнитель изменил цену: 100 → 120 ₽",
                    "💰 Исполнитель изменил цену: 120 → 1\u00a0500,5 ₽ (more work)"]   # no-break space
    assert {r.user_id for r in eff["notifications"].collect()} == {"c1"}



def test_review_effects_update_ratings(spark, base):
    req = df(spark, [("x1", ts(2001, 8, 2, 1), "c2", "o2", 4, " ok ")],
             "request_id string, ts timestamp, customer_id string, order_id string, rating int, comment string")
    eff = C.review_effects(base, req, C.apply_reviews(base, req))
    assert {r.service_id: (r.rating, r.reviews_count) for r in eff["ratings"].collect()}["p1"] == (4.0, 1)
    note = eff["notifications"].first()
    assert note.user_id == "s1" and note.data == '{"order_id":"o2","rating":4}'



def test_message_effects(spark, base):
    req = df(spark, [("m1", ts(2001, 8, 2, 1), "o1", "c1", "hello " + "x" * 150, False),
                     ("m2", ts(2001, 8, 2, 2), "o2", "c2", "late", False),           # completed order
                     ("m3", ts(2001, 8, 2, 3), "o1", "a0", "  watch it ", True),     # admin line
                     ("m4", ts(2001, 8, 2, 4), "o1", "c2", "hi", False)],            # not a participant
             "request_id string, ts timestamp, order_id string, sender_id string, message string, "
             "is_admin boolean")
    out = {r.request_id: (r.status, r.reason) for r in C.post_messages(base, req).collect()}
    assert out == {"m1": ("accepted", None), "m2": ("rejected", "closed"), "m3": ("accepted", None),
                   "m4": ("rejected", "participant")}
    eff = C.message_effects(base, req)
    msgs = sorted(r.message for r in eff["messages"].collect())
    assert msgs[0].startswith("hello") and msgs[1] == "🛡️ [Администратор]: watch it"
    notes = eff["notifications"].collect()
    assert len(notes) == 1 and notes[0].user_id == "s1" and len(notes[0].body) == 100



def test_deposits_and_manual_changes(spark, base):
    dep = df(spark, [("d1", ts(2001, 8, 2, 1), "c1", D("150.00"), "topup"), ("d2", ts(2001, 8, 2, 2), "c2", D("99.00"), "x"),
                     ("d3", ts(2001, 8, 2, 3), "s9", D("200.00"), "new")],
             "request_id string, ts timestamp, user_id string, amount decimal(12,2), reason string")
    eff = C.apply_deposits(base, dep)
    assert dict(eff["balances"].collect()) == {"c1": D("250.00"), "c2": D("30.00"), "s9": D("200.00")}
    assert [r.request_id for r in eff["rejects"].collect()] == ["d2"] and eff["transactions"].count() == 2
    adj = df(spark, [("a1", ts(2001, 8, 2, 1), "c2", D("-40.00"), "fee"),     # more than the balance
                     ("a2", ts(2001, 8, 2, 2), "c2", D("-30.00"), "fee"),     # exactly the balance
                     ("a3", ts(2001, 8, 2, 3), "c2", D("0.00"), "none"),
                     ("a4", ts(2001, 8, 2, 4), "c2", D("5.00"), "bonus")],
             "request_id string, ts timestamp, user_id string, amount decimal(12,2), reason string")
    out = C.adjust_balances(base, adj)
    got = {r.request_id: (r.status, r.reason, r.balance_after) for r in out.collect()}
    assert got == {"a1": ("rejected", "funds", D("30.00")), "a2": ("accepted", None, D("0.00")),
                   "a3": ("rejected", "amount", D("0.00")), "a4": ("accepted", None, D("5.00"))}
    e2 = C.adjust_effects(base, adj, out)
    assert sorted((r.type, r.amount) for r in e2["transactions"].collect()) == [
        ("deposit", D("5.00")), ("withdrawal", D("30.00"))]
    assert dict(e2["balances"].collect())["c2"] == D("5.00")


def test_place_orders_effects(spark, base):
    req = df(spark, [("r1", ts(2001, 8, 2, 1), "c1", "p1", "asap"), ("r2", ts(2001, 8, 2, 2), "c2", "p1", None)],
             "request_id string, ts timestamp, customer_id string, service_id string, requirements string")
    out = C.place_orders(base, req)
    eff = C.place_orders_effects(base, req, out)
    orders = eff["orders"].collect()
    assert len(orders) == 1 and orders[0].customer_id == "c1" and orders[0].executor_id == "s1"
    assert orders[0].deadline_date == dt.date(2001, 8, 5) and orders[0].total_price == D("100.00")
    pay = eff["transactions"].first()
    assert pay.type == "payment" and pay.order_id is None and pay.description == "Оплата заказа: Logo design pro"
    note = eff["notifications"].first()
    assert note.user_id == "s1" and note.body == "Заказ на «Logo design pro»"
    assert dict(eff["balances"].collect()) == {"c1": D("0.00"), "c2": D("30.00")}
    assert {r.id: r.orders_count for r in eff["services"].collect()}["p1"] == 1


def test_registration_compares_emails_as_the_tables_do(spark, base):
    """Case and accents don't make another e-mail."""
    from souk.operators import audits
    taken = "mail1@gmail.com"
    base = {**base, "users": base["users"].withColumn("email", F.lit(taken))}
    odd = taken.replace("e", "é", 1) if "e" in taken else taken.upper()
    rows = [("r1", ts(2024, 1, 1), "Anna Lind", taken.upper(), "secret12", "customer"),
            ("r2", ts(2024, 1, 2), "Anna Lind", "Zoe.New@gmail.com", "secret12", "customer"),
            ("r3", ts(2024, 1, 3), "Anna Lind", "zoe.new@GMAIL.com", "secret12", "customer")]
    req = df(spark, rows, "request_id string, ts timestamp, name string, email string, password string, role string")
    out = {r.request_id: (r.status, r.reason) for r in C.register_users(dict(base), req).collect()}
    assert out["r1"] == ("rejected", "taken")
    assert out["r2"][0] == "accepted" and out["r3"] == ("rejected", "duplicate")
    dup = {r.key_value: (r.n, r.spellings) for r in audits.duplicate_texts(df(spark, [(taken,), (odd,), ("other@x.ru",)], "email string"), "email").collect()}
    assert list(dup.values()) == [(2, 2)]


def test_soft_delete_needs_the_users_own_confirmed_request(spark):
    T0_ = dt.datetime(2024, 1, 1)
    users = spark.createDataFrame([(i, f"{i}@x.ru", i.upper(), True) for i in "abcd"], "id string, email string, name string, is_active boolean")
    asked = spark.createDataFrame([("r1", "a", "a", True), ("r2", "b", "b", False), ("r3", "z", "c", True), ("r4", "d", "d", None), ("r5", "a", "a", True)],
                                  "request_id string, actor_id string, user_id string, confirmed boolean")
    got = {r.id: (r.email, r.name, r.is_active) for r in C.soft_delete_users({"users": users}, asked, T0_).collect()}
    assert got["a"] == ("a@x.ru_deleted_1704067200", "A" + C.TEXT["deleted_name_suffix"], False)
    assert all(got[i] == (f"{i}@x.ru", i.upper(), True) for i in "bcd")


@pytest.mark.parametrize("name, column, wanted", [
    ("update_services", "reason", {None, "owner", "fields", "deadline", "price"}),
    ("create_services", "status", {"accepted", "rejected"})])
def test_registered_requests_meet_every_answer(spark, sf_dir, name, column, wanted):
    from souk.plans.registry import spark_query
    assert {r[0] for r in spark_query(name)(spark, sf_dir).select(column).distinct().collect()} == wanted


def test_message_times_of_repeated_ids(spark, base):
    """A line meets every request with its id (also itself); a line without an id has no effects."""
    req = df(spark, [("m1", ts(2001, 8, 2, 1), "o1", "c1", "one", False), ("m1", ts(2001, 8, 2, 2), "o9", "c1", "two", False),
                     ("m2", ts(2001, 8, 2, 3), "o1", "c1", "three", False), (None, ts(2001, 8, 2, 4), "o1", "c1", "four", False)],
             "request_id string, ts timestamp, order_id string, sender_id string, message string, is_admin boolean")
    eff = C.message_effects(base, req)
    assert sorted((r.message, r.created_at.hour) for r in eff["messages"].collect()) == [("one", 1), ("one", 2), ("three", 3)]
    assert sorted((r.body, r.created_at.hour) for r in eff["notifications"].collect()) == [("one", 1), ("one", 2), ("three", 3)]


def test_chat_texts_are_not_exchanged(spark, base):
    req = df(spark, [("m1", ts(2001, 8, 2, 1), "o1", "c1", "hello", False)],
             "request_id string, ts timestamp, order_id string, sender_id string, message string, is_admin boolean")
    eff = C.message_effects(base, req)
    for out in (C.post_messages(base, req), eff["messages"], eff["notifications"]):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_scans_carry_their_state_over_batches_and_null_keys(spark):
    """A running count per key, and its last row, with Arrow batches of two rows; nulls are one key."""
    from souk.operators.folds import ordered_scan

    def make():
        n = 0

        def advance(first, pdf):
            nonlocal n
            out = []
            for f in first:
                n = 1 if f else n + 1
                out.append(n)
            return [out]
        return advance

    rows = df(spark, [(k, i) for k, m in (("a", 5), (None, 3), ("b", 1)) for i in range(m)], "k string, i int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = sorted(((r.k or "", r.i, r.n) for r in ordered_scan(rows, ["k"], ["i"], make, "n int", ["k", "i"]).collect()))
        ends = sorted(((r.k or "", r.n) for r in ordered_scan(rows, ["k"], ["i"], make, "n int", ["k"], ends=True).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(k, i, i + 1) for k, m in (("", 3), ("a", 5), ("b", 1)) for i in range(m)]
    assert ends == [("", 3), ("a", 5), ("b", 1)]


def test_stream_files_follow_the_bytes(spark, monkeypatch):
    """Long texts take more files than their number of rows asks for."""
    from souk.plans import q_streams
    monkeypatch.setattr(q_streams, "FILE_BYTES", 1000)
    rows = spark.range(40).select("id", F.repeat(F.lit("x"), 300).alias("t"))
    stream = q_streams._as_stream(rows, files=3)
    path = stream._jdf.queryExecution().analyzed().toString()
    import glob
    import re
    found = glob.glob(re.search(r"(/[^\s,\]]*stream_in/\w+)", path).group(1) + "/*.parquet")
    assert len(found) >= 12


def test_long_chat_texts_meet_no_exchange_whatever_is_broadcast(spark, base):
    """Lines whose verdict needs no order stay where they are; of an order held twice every line still comes twice."""
    long = "x" * 3000
    req = df(spark, [("m1", ts(2001, 8, 2, 1), "o1", "c1", " short ", False), ("m2", ts(2001, 8, 2, 2), "o1", "a0", long, True),
                     ("m3", ts(2001, 8, 2, 3), "o1", "c1", long, False), ("m4", ts(2001, 8, 2, 4), "o1", "c1", "  ", None),
                     ("m5", ts(2001, 8, 2, 5), None, "a0", "note", True), ("m6", ts(2001, 8, 2, 6), "o9", "c1", "lost", None)],
             "request_id string, ts timestamp, order_id string, sender_id string, message string, is_admin boolean")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        plan = C.message_effects(base, req)["messages"]._jdf.queryExecution().executedPlan().toString()
        heavy = [i for i, line in enumerate(plan.splitlines()) if "message#" in line and "trim(" in line]
        assert heavy and not any("Exchange" in line for line in plan.splitlines()[heavy[0] - 3:])
        twice = dict(base, orders=base["orders"].unionByName(base["orders"].filter("id = 'o1'")))
        for T, n in ((base, 1), (twice, 2)):
            got = sorted((r.request_id, r.stored, r.status, r.reason, r.notify_user) for r in C.post_messages(T, req).collect())
            other = T["orders"].filter("id = 'o1'").first().executor_id
            assert got == sorted(n * [("m1", "short", "accepted", None, other), ("m2", C.ADMIN_PREFIX + long, "accepted", None, None),
                                      ("m3", long, "rejected", "message", None), ("m4", "", "rejected", "message", None)]
                                 + [("m5", C.ADMIN_PREFIX + "note", "accepted", None, None), ("m6", "lost", "rejected", "participant", None)],
                                 key=lambda r: r[0])
            eff = C.message_effects(T, req)
            assert sorted(r.message for r in eff["messages"].collect()) == sorted(
                n * ["short", C.ADMIN_PREFIX + long] + [C.ADMIN_PREFIX + "note"])
            assert [r.body for r in eff["notifications"].collect()] == n * ["short"]
    finally:
        spark.conf.set(limit, before)

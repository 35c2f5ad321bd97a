"""Ordered rules on a key that holds a third of all rows and lies in several range partitions:
equal to a plain sequential simulation, and no task reads the whole key."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from souk.operators import changes as C
from souk.operators import segments as SG
from souk.operators.history import running_sum, trailing_count
from souk.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables keep their eight range partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def hot_rows(n, seed, width=40_000):
    rng = random.Random(seed)
    return [(f"r{i:05d}", "hot" if i % 3 == 0 else f"k{rng.randrange(60):02d}", T0 + dt.timedelta(seconds=rng.randrange(width)), rng.randrange(-50, 60))
            for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, key string, ts timestamp, v long").repartition(5)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_a_busy_key_is_cut_and_stays_in_order(spark):
    rows = hot_rows(1500, 1)
    s = SG.segments(frame(spark, rows), "key", ["ts", "id"], "t")
    parts = {(r.key, r[SG.PART]): r for r in s.rows.groupBy("key", SG.PART).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()}
    hot = sorted((p, r) for (k, p), r in parts.items() if k == "hot")
    assert len(hot) >= 3 and max(r.n for _, r in hot) < 300
    assert all(a.hi <= b.lo for (_, a), (_, b) in zip(hot, hot[1:]))
    assert {r.key for r in s.crossing.collect()} == {k for k, _ in parts if sum(k == q for q, _ in parts) > 1}


def test_running_previous_and_trailing(spark):
    rows = hot_rows(1500, 2, width=3000)          # many equal times
    df = frame(spark, rows)
    total, top, before, near = {}, {}, {}, {}
    for rs in by_key(rows).values():
        t, m = 0, None
        for i, r in enumerate(rs):
            t += r[3]
            m = r[3] if m is None else max(m, r[3])
            total[r[0]], top[r[0]] = t, m
            before[r[0]] = rs[i - 1][3] if i else None
            near[r[0]] = sum(r[2] - dt.timedelta(seconds=600) <= x[2] <= r[2] for x in rs) - 1
    assert {r.id: r.running for r in running_sum(df, "key", "ts", "id", F.col("v")).collect()} == total
    s = SG.segments(df, "key", ["ts", "id"], "t")
    assert {r.id: r.m for r in SG.running(s, "max", m=F.col("v")).collect()} == top
    assert {r.id: r.previous_v for r in SG.previous(s, "v").collect()} == before
    got = trailing_count(df, "key", "ts", 600)
    assert got.columns == ["id", "key", "ts", "v", "earlier"] and {r.id: r.earlier for r in got.collect()} == near


def test_rows_without_key_are_left_out_and_empty_tables_work(spark):
    df = frame(spark, [("a", None, T0, 1), ("b", "x", T0, 2)])
    assert [r.id for r in trailing_count(df, "key", "ts", 5).collect()] == ["b"]
    none = df.filter("false")
    assert running_sum(none, "key", "ts", "id", F.col("v")).collect() == [] == trailing_count(none, "key", "ts", 5).collect()


def test_pointer_doubling_visits_the_chain(spark):
    rng = random.Random(4)
    links, want = [], set()
    for k in range(6):
        n = rng.randrange(1, 200)
        nxt = sorted(rng.randrange(i + 1, i + 9) for i in range(1, n + 1))
        nxt = [max(x, i + 1) for i, x in enumerate(nxt, 1)]
        links += [(f"k{k}", i, x) for i, x in enumerate(nxt, 1)]
        at = 1
        while at <= n:
            want.add((f"k{k}", at))
            at = nxt[at - 1]
    got = SG.reached(spark.createDataFrame(links, "key string, rank long, next long"), "key").collect()
    assert len(got) == len(want) and {(r.key, r["rank"]) for r in got} == want


@pytest.mark.parametrize("policy", [S.Policy(3, 600), S.Policy(2, 7), S.Policy(50, 30_000)])
def test_limiter_with_a_busy_key(spark, policy):
    rows = [(i, r[1], r[2]) for i, r in enumerate(hot_rows(1200, 5))]
    rows += [(5000 + i, "hot", T0 + dt.timedelta(seconds=10 * i)) for i in range(300)]      # a regular beat
    df = spark.createDataFrame(rows, "attempt_id long, attempt_key string, ts timestamp")
    want, state = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        count, first = state.get(k, (0, None))
        count, first = (1, t) if first is None or t - first > dt.timedelta(seconds=policy.window_seconds) else (count + 1, first)
        state[k] = count, first
        want[i] = (k, t, count, count > policy.limit)
    got = S.limit_attempts(df.repartition(4), policy).collect()
    assert len(got) == len(rows) and {r.attempt_id: (r.attempt_key, r.ts, r.attempt_count, r.blocked) for r in got} == want


def events(n, seed, rich):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        user = "hot" if i % 3 == 0 else f"u{rng.randrange(25):02d}"
        kind = rng.choice(["order", "order", "deposit", "adjust"])
        change = {"order": -rng.randrange(0, 300), "deposit": rng.randrange(100, 400), "adjust": rng.randrange(-200, 200)}[kind]
        pre = rng.choice([None] * 6 + ["service"])
        out.append((f"r{i:05d}", T0 + dt.timedelta(seconds=rng.randrange(5000)), user, kind, Decimal(abs(change)), pre, Decimal(rich), Decimal(change)))
    return out


@pytest.mark.parametrize("rich", [0, 40, 10 ** 6])
def test_balance_rules_with_a_busy_user(spark, rich):
    rows = events(1500, rich, rich)
    want, bal = {}, {}
    for rid, t, user, kind, amount, pre, start, change in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        b = bal.get(user, start)
        checked = kind == "order" or kind == "adjust" and change < 0
        reason = pre or ("funds" if checked and b + change < 0 else None)
        bal[user] = b if reason else b + change
        want[rid] = ("rejected" if reason else "accepted", reason, bal[user])
    df = spark.createDataFrame(rows, "request_id string, ts timestamp, user_id string, kind string, amount decimal(12,2), pre string, "
                                     "start decimal(14,2), change decimal(14,2)").repartition(4)
    out = C.settle(df)
    got = out.collect()
    assert len(got) == len(rows) and {r.request_id: (r.status, r.reason, r.balance_after) for r in got} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("MapInPandas" in plan) == (rich < 10 ** 6) and (rich == 10 ** 6 or any(w[1] == "funds" for w in want.values()))


def adjustments(n, seed):
    """Changes of 25 users and a busy one; some without user, id, time or amount, ids that come again."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        user = "hot" if i % 3 == 0 else rng.choice([f"u{rng.randrange(25):02d}"] * 9 + [None, ""])
        out.append((None if i % 97 == 0 else f"a{i % (n - 40):05d}", None if i % 89 == 0 else T0 + dt.timedelta(seconds=i * 7919 % 5000 + i), user,
                    rng.choice([None, Decimal(0), *[Decimal(rng.randrange(-30000, 25000)) / 100] * 9]), rng.choice([None, "", "fee"])))
    return out


def test_manual_changes_by_one_exchange(spark, monkeypatch):
    """Outcomes equal a sequential run, effects the join of outcomes and requests; only one table of all events is written."""
    rows = adjustments(1500, 3)
    purse = [("hot", Decimal(40)), ("u01", Decimal(30)), ("u02", Decimal(500)), ("u02", Decimal(500)), ("u03", None), (None, Decimal(900)), ("idle", Decimal(7))]
    req = spark.createDataFrame(rows, "request_id string, ts timestamp, user_id string, amount decimal(12,2), reason string").repartition(4)
    T = {"balances": spark.createDataFrame(purse, "user_id string, amount decimal(12,2)")}
    want, bal, sizes, parts, write = [], {}, {}, {}, C.stored

    def counted(df, name, *a, **b):
        out = write(df, name, *a, **b)
        sizes[name], parts[name] = out.count(), out.select(SG.PART).distinct().count() if SG.PART in out.columns else 0
        return out

    monkeypatch.setattr(C, "stored", counted)
    monkeypatch.setattr(SG, "stored", counted)
    monkeypatch.setattr(C, "EVENTS_PER_TASK", 100, raising=False)                   # more ranges than the session's eight
    at = lambda t: (t is not None, t)                                               # noqa: E731
    order = lambda r: (r[2] or "", at(r[1]), at(r[0]))                              # noqa: E731
    assert len({order(r) for r in rows}) == len(rows)                               # no ties
    for rid, t, user, amount, note in sorted(rows, key=order):
        for start in [b or 0 for u, b in purse if user is not None and u == user] or [0]:   # once per balance
            b = bal.get(user or "", start)
            reason = "amount" if not amount else "funds" if amount < 0 and b + amount < 0 else None
            bal[user or ""] = b if reason else b + amount
            want.append((rid, user, "rejected" if reason else "accepted", reason, amount, bal[user or ""]))
    out = C.adjust_balances(T, req)
    got = [(r.request_id, r.user_id, r.status, r.reason, r.amount, r.balance_after) for r in out.collect()]
    own, joined = C.adjust_effects(T, req, out), C.adjust_effects(T, req, out.select("request_id", "status"))
    key = lambda r: tuple(map(str, r))                                              # noqa: E731
    for name in own:
        assert sorted(own[name].collect(), key=key) == sorted(joined[name].collect(), key=key)
    assert own["transactions"].filter("user_id is null").count() and {r[3] for r in want} == {None, "amount", "funds"}
    assert sorted(got, key=str) == sorted(want, key=str)
    # those of users in several ranges are written again, nobody else's
    busy = sum(r[2] == "hot" for r in rows)
    assert parts["settle"] > 8 and sizes["settle"] >= len(want) and busy <= sizes["settle-rows"] < 0.8 * len(want)


def test_effects_of_changes_exchange_no_request(spark):
    """Ids that come once: ledger rows are a projection of the outcomes."""
    rows = [(f"a{i}", T0, f"u{i % 9}", Decimal(i - 20), "fee") for i in range(60)]
    req = spark.createDataFrame(rows, "request_id string, ts timestamp, user_id string, amount decimal(12,2), reason string")
    T = {"balances": spark.createDataFrame([("u1", Decimal(30))], "user_id string, amount decimal(12,2)")}
    tx = C.adjust_effects(T, req, C.adjust_balances(T, req))["transactions"]
    plan = tx._jdf.queryExecution().executedPlan().toString()
    assert "request_id" in plan and "SortMergeJoin" not in plan and "hashpartitioning(request_id" not in plan
    assert {r.user_id for r in tx.collect()} and all(r.created_at == T0 and r.description == "fee" for r in tx.collect())


def test_status_rules_with_a_busy_order(spark):
    rng = random.Random(6)
    users = spark.createDataFrame([("c1", "customer"), ("s1", "executor"), ("x9", "customer")], "id string, role string")
    rows = [(f"r{i:05d}", T0 + dt.timedelta(seconds=rng.randrange(2000)), "hot" if i % 3 == 0 else f"o{rng.randrange(80)}", rng.choice(["c1", "s1", "x9"]),
             rng.choice(["in_progress", "review", "completed", "cancelled", "created", "odd"]), None) for i in range(900)]
    rows = [r for r in rows if not (r[2] == "hot" and r[4] != "cancelled" and r[1] < T0 + dt.timedelta(seconds=1500)) and not (r[2] == "hot" and r[4] == "cancelled")
            ] + [(f"s{i:04d}", T0 + dt.timedelta(seconds=i), "hot", "x9", "review", None) for i in range(400)]
    orders = spark.createDataFrame([(o, "c1", "s1", "created", Decimal(5)) for o in ["hot", *[f"o{i}" for i in range(70)]]],
                                   "id string, customer_id string, executor_id string, status string, total_price decimal(12,2)")
    req = spark.createDataFrame(rows, "request_id string, ts timestamp, order_id string, actor_id string, new_status string, note string")
    known = {"hot", *[f"o{i}" for i in range(70)]}
    state, want, role = {}, {}, {"c1": "customer", "s1": "executor"}
    for rid, t, o, a, new, _ in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        old, r = state.get(o, "created"), role.get(a) if o in known else None
        ok = new in C.TRANSITIONS.get(r, {}).get(old, ())
        state[o] = new if ok else old
        want[rid] = (r, old, "accepted" if ok else "rejected", "participant" if r is None else None if ok else "transition")
    out = C.apply_status_changes({"users": users, "orders": orders}, req.repartition(5))
    assert {r.request_id: (r.role, r.old_status, r.status, r.reason) for r in out.collect()} == want
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString().replace("MapInPandas", "Python")
    assert sum(w[2] == "accepted" and o == "hot" for w, o in ((want[r[0]], r[2]) for r in rows)) >= 2
    # forced changes: the state before is the previous valid target
    forced = C.force_status({"orders": orders}, req.repartition(3)).collect()
    last = {}
    for rid, t, o, a, new, _ in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        if o in known and new in C.ORDER_STATES:
            want[rid] = last.get(o, "created")
            last[o] = new
        else:
            want[rid] = None
    assert {r.request_id: r.old_status for r in forced} == {r[0]: want[r[0]] for r in rows}

"""Sources, sinks, pages, nested exports and the remaining scalar rules."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from souk.functions import predicates as P
from souk.operators import history as H
from souk.operators import retention as RT
from souk.operators import views as V
from souk.sources import schemas, sinks, tables


def _scratch():
    return tempfile.mkdtemp(prefix="souk-test-", dir="/tmp")


def test_jdbc_options_partitioned():
    o = tables.jdbc_options("jdbc:mysql://db/x", "orders", "created", (0, 1000), 32, {"user": "u"})
    assert o["partitionColumn"] == "created" and o["numPartitions"] == "32"
    assert o["lowerBound"] == "0" and o["upperBound"] == "1000" and o["user"] == "u"
    assert "partitionColumn" not in tables.jdbc_options("jdbc:mysql://db/x", "orders")


def test_cast_types(spark):
    raw = spark.createDataFrame([("p1", 1, "12.50", '["a","b"]'), ("p2", 0, "3", "oops")],
                                "id string, is_active int, price string, tags string")
    out = schemas.cast_types(raw, "services", parse_json=True).collect()
    assert out[0].is_active is True and out[1].is_active is False
    assert out[0].price == Decimal("12.50")
    assert out[0].tags_parsed == ["a", "b"] and out[1].tags_parsed is None and out[1].tags == "oops"


def test_seed_categories_keeps_existing(spark):
    cats = spark.createDataFrame([(1, "Mine", "design", 5), (40, "X", "x", 1)],
                                 "id int, name string, slug string, sort_order int")
    out = {r.slug: r for r in tables.seed_categories(cats).collect()}
    assert out["design"].name == "Mine" and out["design"].id == 1
    assert len(out) == 16 and out["programming"].id == 41 and out["other"].id == 54


def test_load_tables_with_declared_schema(spark):
    d = _scratch()
    spark.createDataFrame([("u1", "A", "a@gmail.com", "customer", True, dt.datetime(2001, 1, 1),
                            dt.datetime(2001, 1, 1))],
                          "id string, name string, email string, role string, is_active boolean, "
                          "created_at timestamp, updated_at timestamp").write.parquet(f"{d}/users")
    t = tables.load_tables(spark, d, ["users"])
    assert [(f.name, f.dataType) for f in t["users"].schema] == \
        [(f.name, f.dataType) for f in schemas.SCHEMAS["users"]]
    assert t["users"].first().avatar is None


def test_snapshot_versions_and_manifest(spark):
    d = _scratch()
    a = spark.range(3).withColumnRenamed("id", "k")
    v1 = sinks.write_snapshot({"t": a}, d, "1")
    assert sinks.read_snapshot(spark, d, "t").count() == 3
    sinks.write_snapshot({"t": a.filter("k > 0")}, d, "2")
    assert sinks.current_version(spark, d)["version"] == "2" and v1 == "1"
    assert sinks.read_snapshot(spark, d, "t").count() == 2
    assert spark.read.text(f"{d}/_manifests").count() == 2          # the older manifest stays
    names = {sinks.write_snapshot({"t": a}, d) for _ in range(3)}    # three versions in one second
    assert len(names) == 3 and sinks.current_version(spark, d)["version"] in names
    sinks.append(a, f"{d}/log")
    sinks.append(a, f"{d}/log")
    assert spark.read.parquet(f"{d}/log").count() == 6


def test_export_json_nests_bounded_lists(spark):
    d = _scratch()
    users = spark.createDataFrame([("u1",), ("u2",)], "id string")
    items = spark.createDataFrame([("u1", 2, "b"), ("u1", 1, "a")], "user_id string, rn int, item string")
    sinks.export_json(users, f"{d}/out", {"items": (items, "user_id", ["rn"])})
    got = {r.id: r["items"] for r in spark.read.json(f"{d}/out").collect()}
    assert [i.item for i in got["u1"]] == ["a", "b"] and got["u2"] is None


def test_cleanup_log_row(spark):
    counts = spark.createDataFrame([(3, 1)], "cancelled_orders long, inactive_users long")
    row = RT.cleanup_log_row(counts, "2001-08-02 00:00:00", "cron").first()
    assert row.ran_by == "cron" and '"cancelled_orders":3' in row.results


def test_paginate(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    page = V.paginate(df, [F.col("k").desc()], page=3, limit=10, default_limit=12, max_limit=50)
    assert [r.k for r in page.rows.collect()] == [4, 3, 2, 1, 0]
    assert page.total == 25 and page.pages == 3
    assert V.clamp_page("x", 500, 12, 50) == (1, 50) and V.clamp_page(0, None, 12, 50) == (1, 12)


def test_scalar_rules(spark):
    row = spark.createDataFrame([(1234567.5, "10.0.0.1, 10.0.0.2", "9.9.9.9", '{"github":"g","website":""}',
                                  '[{"name":"a","level":5},{"name":"b"}]')],
                                "x double, fwd string, sock string, socials string, skills string").select(
        P.ru_number("x").alias("n"), P.client_key("fwd", "sock").alias("k"),
        P.known_socials("socials").alias("soc"), P.skill_percents("skills").alias("sk"),
        P.stars(F.lit(3.6)).alias("st"), P.availability_label(F.lit("weird")).alias("av")).first()
    assert row.n == "1 234 567,5" and row.k == "10.0.0.1"
    assert row.soc == ["github"] and [(s.name, s.pct) for s in row.sk] == [("a", 100), ("b", 60)]
    assert row.st == 4 and row.av == "available"
    none = spark.createDataFrame([(None, "")], "fwd string, sock string").select(P.client_key("fwd", "sock")).first()
    assert none[0] == "unknown"


def test_user_dossier_lists_are_bounded(T):
    d = H.user_dossier(T, k=3).collect()
    assert d and all(len(r.orders or []) <= 3 and len(r.transactions or []) <= 3 for r in d)


def test_fixture_store_is_versioned(spark, sf_dir):
    from souk.sources.fixtures import fixture_tables
    a = fixture_tables(spark, sf_dir, store=True)["orders"]
    b = fixture_tables(spark, sf_dir, store=False)["orders"]
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    files = a.inputFiles()
    assert files and all("m_orders-" in f for f in files)
    assert os.path.basename(os.path.dirname(files[0])).startswith("m_orders-")


def test_parse_number_and_user_views(spark):
    got = spark.createDataFrame([(" 12.5 ",), ("abc",), (None,)], "x string").select(
        P.parse_number("x", 1).alias("v")).collect()
    assert [r.v for r in got] == [12.5, 1.0, 1.0]
    u = spark.createDataFrame([("u1", "A", "a@x", "h", True, "customer"), ("u2", "B", "b@x", "h", False, "executor")],
                              "id string, name string, email string, password_hash string, is_active boolean, role string")
    assert V.private_users(u).columns == ["id", "name", "email", "is_active", "role"]
    pub = V.public_users(u)
    assert pub.columns == ["id", "name", "role"] and pub.count() == 1


def test_cascade_follows_declared_keys(spark):
    mk = lambda rows, schema: spark.createDataFrame(rows, schema)
    t = {"users": mk([("u1",), ("u2",)], "id string"),
         "services": mk([("p1", "u1"), ("p2", "u2")], "id string, executor_id string"),
         "balances": mk([("u1",), ("u2",)], "user_id string"),
         "notifications": mk([("n1", "u1")], "id string, user_id string"),
         "profiles": mk([("u1",)], "user_id string"),
         "orders": mk([("o1",), ("o2",)], "id string"),
         "status_log": mk([("o1", "x")], "order_id string, new_status string"),
         "messages": mk([("m1", "o1"), ("m2", "o2")], "id string, order_id string")}
    gone = RT.cascade(t, "users", mk([("u1",)], "id string"))
    assert [r.id for r in gone["services"].collect()] == ["p2"]
    assert gone["notifications"].count() == 0 and gone["profiles"].count() == 0
    assert [r.user_id for r in gone["balances"].collect()] == ["u2"]
    gone = RT.cascade(t, "orders", mk([("o1",)], "id string"))
    assert gone["status_log"].count() == 0 and [r.id for r in gone["messages"].collect()] == ["m2"]


def test_registered_plans_run_on_loaded_tables(spark, T):
    """Production path: stored marketplace tables read with their declared schemas."""
    from souk.plans.registry import REGISTRY
    d = _scratch()
    names = ["users", "services", "orders", "reviews", "balances", "transactions", "categories", "profiles"]
    for n in names:
        schemas.cast_types(T[n], n).write.parquet(f"{d}/{n}")
    loaded = tables.load_tables(spark, d, names)
    for q in ("top_executors", "platform_stats", "catalog", "executor_stats"):
        a = sorted(tuple(r) for r in REGISTRY[q].plan(T).collect())
        b = sorted(tuple(r) for r in REGISTRY[q].plan(loaded).collect())
        assert a == b, q


def test_every_user_has_a_toggle_and_a_role_request(T):
    from souk.plans.q_changes import _user_requests
    users = {r.id for r in T["users"].select("id").collect()}
    for tag in ("u", "r"):
        asked = [(r.user_id, r.actor_id) for r in _user_requests(T, tag, 5).collect()]
        assert len(asked) == len(users) and {u for u, _ in asked} == users
        assert {a for u, a in asked if a != u} == {"a0"} and any(a == u for u, a in asked)


def test_request_texts_are_not_stored_or_scanned(spark, sf_dir):
    """Messages repeated 2001 times come from a projection of the stored ones, row by row."""
    from souk.sources.fixtures import fixture_tables
    T = fixture_tables(spark, sf_dir, store=True)
    files = T["req_messages"].inputFiles()
    assert files and all("/m_messages-" in f for f in files)


def test_trim_cuts_what_the_pattern_matches(spark):
    """Every BMP character at the ends, against the regular expression; no pattern runs over the text."""
    from souk.functions.text import js_trim
    c = spark.range(1, 0xFFFF).filter("id < 55296 or id > 57343").selectExpr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') AS c")
    t = c.select(F.explode(F.array("c", F.concat("c", F.lit("x \n y"), "c", F.lit("\n")), F.concat(F.lit(" "), "c"))).alias("t"))
    assert t.filter(~F.regexp_replace("t", r"(?U)^\s+|\s+$", "").eqNullSafe(js_trim(F.col("t")))).count() == 0
    assert "regexp" not in t.select(js_trim(F.col("t")))._jdf.queryExecution().toString()

"""Batch = stream across several micro-batches (state carried between them)."""

import datetime as dt
import tempfile
import uuid

from pyspark.sql import functions as F

from souk.operators import changes as C
from souk.sources.buckets import BucketedTable
from souk.streaming import streams as S


def _files_in_time_order(spark, rows, schema, parts):
    """Write ``rows`` as ``parts`` successive appends (file times follow data times)."""
    d = tempfile.mkdtemp(prefix="souk-stream-", dir="/tmp")
    size = (len(rows) + parts - 1) // parts
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(d)
    return d


def test_limiter_stream_over_many_batches_equals_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, f"k{i % 4}", t0 + dt.timedelta(minutes=11 * i)) for i in range(240)]
    schema = "attempt_id long, attempt_key string, ts timestamp"
    d = _files_in_time_order(spark, rows, schema, 3)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)
    pol = S.Policy(3, 6 * 3600)
    base = S.run_available(spark, S.limit_attempts_stream(src, pol, "1 hour"))
    got = sorted(spark.read.parquet(f"{base}/out").collect())
    want = sorted(S.limit_attempts(spark.createDataFrame(rows, schema), pol).collect())
    assert got == want
    assert any(r.blocked for r in got) and any(r.attempt_count == 1 and r.attempt_id > 0 for r in got)


def test_limiter_state_falls_to_zero_after_the_window(spark):
    """A busy key's window is dropped by its timer; only the key of the last file is left."""
    t0 = dt.datetime(2024, 1, 1)
    schema = "attempt_id long, attempt_key string, ts timestamp"
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", t0 + dt.timedelta(seconds=i % 400)) for i in range(3000)]
    later = [(5000, "last", t0 + dt.timedelta(days=2)), (5001, "last", t0 + dt.timedelta(days=2, hours=5))]
    d = _files_in_time_order(spark, sorted(rows, key=lambda r: r[2]), schema, 2)
    for row in later:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(d)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)
    policy = S.Policy(5, 120)
    q = (S.limit_attempts_stream(src, policy, "1 minute").writeStream.format("parquet").option("path", f"{d}-out")
         .option("checkpointLocation", f"{d}-chk").trigger(availableNow=True).start())
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) >= 8 and held[-1] <= 2
    want = sorted(S.limit_attempts(spark.createDataFrame(rows + later, schema), policy).collect())
    assert sorted(spark.read.parquet(f"{d}-out").collect()) == want


def test_unread_alerts_stream_equals_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"n{i}", f"u{i % 3}", i % 5 == 0, t0 + dt.timedelta(seconds=5 * i)) for i in range(90)]
    schema = "id string, user_id string, is_read boolean, created_at timestamp"
    d = _files_in_time_order(spark, rows, schema, 3)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)
    out = f"{d}-out"
    S.run_available(spark, S.unread_alerts_stream(src), mode="update", foreach_batch=S.upsert_batch(out, ["user_id", "poll_at"]))
    got = sorted(S.upserted(spark, out, ["user_id", "poll_at"]).collect())
    want = sorted(S.unread_alerts(spark.createDataFrame(rows, schema)).collect())
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    first = {}
    for r in sorted(want, key=lambda r: r.poll_at):
        first.setdefault(r.user_id, r)
    assert not any(r.alert for r in first.values())      # the first poll never alerts


def test_status_changes_as_a_stream(spark, T):
    reqs = T["req_status"].limit(400)
    d = tempfile.mkdtemp(prefix="souk-stream-", dir="/tmp") + "/in"
    reqs.write.parquet(d)
    src = spark.readStream.schema(reqs.schema).parquet(d)
    out = f"{d}-out-{uuid.uuid4().hex}"
    start = T["orders"].withColumn("status", F.lit("created"))
    S.run_available(spark, src, foreach_batch=S.status_stream_batch(T, out, start))
    got = sorted(spark.read.parquet(f"{out}/outcomes").drop("epoch").collect())
    want = sorted(C.apply_status_changes(T, spark.read.parquet(d), start).collect())
    assert got == want


def test_a_poll_split_over_micro_batches(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", "u", False, t0), ("b", "u", False, t0 + dt.timedelta(seconds=9)), ("c", "u", False, t0 + dt.timedelta(seconds=10))]
    schema = "id string, user_id string, is_read boolean, created_at timestamp"
    d = _files_in_time_order(spark, rows, schema, 2)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)
    S.run_available(spark, S.unread_alerts_stream(src), mode="update", foreach_batch=S.upsert_batch(f"{d}-out", ["user_id", "poll_at"]))
    got = sorted((r.poll_at.second, r.arrived, r.unread_count, r.alert) for r in S.upserted(spark, f"{d}-out", ["user_id", "poll_at"]).collect())
    assert got == [(0, 1, 1, False), (8, 2, 3, True)]


def test_a_crashed_sink_loses_no_rows(spark):
    """A version is read once its manifest is there; a missing predecessor is an error, not an empty table."""
    import pytest
    base = tempfile.mkdtemp(prefix="souk-sink-", dir="/tmp")
    write = S.upsert_batch(base, ["k"])
    frame = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    table = lambda: sorted(tuple(r) for r in S.upserted(spark, base, ["k"]).collect())
    write(frame(("a", 1), ("b", 1)), 0)
    write(frame(("b", 2)), 1)
    write(frame(("b", 2)), 1)                                # replayed
    assert table() == [("a", 1), ("b", 2)]
    frame(("a", 99)).withColumn("_bucket", F.lit(3)).write.partitionBy("_bucket").parquet(f"{base}/data/v00000002")   # a crash before the manifest
    assert table() == [("a", 1), ("b", 2)]
    write(frame(("c", 3)), 2)
    assert table() == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(FileNotFoundError):
        write(frame(("d", 4)), 7)
    write(frame(), 3)                                        # an empty batch is a version too
    assert table() == [("a", 1), ("b", 2), ("c", 3)]


def test_bytes_written_follow_the_batch(spark):
    import os
    import random
    base = tempfile.mkdtemp(prefix="souk-sink-", dir="/tmp")
    t = BucketedTable(spark, base, ["k"], buckets=8, most=3)
    written = lambda v: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{base}/data/v{v:08d}") for f in fs if f.endswith(".parquet"))
    t.upsert(spark.range(20_000).selectExpr("id AS k", "md5(cast(id as string)) AS v"), 0)
    rng, want = random.Random(2), {}
    for version in range(1, 12):
        rows = [(rng.randrange(25_000), f"x{version}") for _ in range(5)]
        want |= dict(rows)
        t.upsert(spark.createDataFrame(list(dict(rows).items()), "k long, v string"), version)
        assert max(map(len, t.manifest(version)[1].values())) <= 3 + 1
    sizes = [written(v) for v in range(12)]
    assert sorted(sizes[1:])[3] * 20 < sizes[0]              # most versions write a few rows; some compact a bucket
    got = {r.k: r.v for r in t.read().collect()}
    assert len(got) == 20_000 + sum(k >= 20_000 for k in want) and all(got[k] == v for k, v in want.items())
    assert {r.k: r.v for r in t.read(3).collect()} != got
    only = [r[0] for r in spark.createDataFrame([(k,) for k in list(want)[:2]], "k long").select(t.bucket_of()).distinct().collect()]
    assert {r.k for r in t.read(only=only).collect()} >= set(list(want)[:2])
    assert t.expire(keep=1) > 0 and t.versions() == [11]
    assert {r.k: r.v for r in t.read().collect()} == got


def test_status_stream_writes_every_effect(spark, T):
    reqs = T["req_status"]
    d = tempfile.mkdtemp(prefix="souk-stream-", dir="/tmp") + "/in"
    half = F.expr("cast(substring(order_id, 2) as bigint) % 2 = 0")
    reqs.filter(half).coalesce(1).write.parquet(d)
    reqs.filter(~half).coalesce(1).write.mode("append").parquet(d)
    src = spark.readStream.schema(reqs.schema).option("maxFilesPerTrigger", 1).parquet(d)
    out = f"{d}-out"
    start = T["orders"].withColumn("status", F.lit("created"))
    S.run_available(spark, src, foreach_batch=S.status_stream_batch(T, out, start))
    want = C.status_effects(T, C.apply_status_changes(T, reqs, start), reqs, orders=start)
    for name in ("status_log", "transactions", "notifications"):
        assert spark.read.parquet(f"{out}/{name}").drop("epoch").count() == want[name].count() > 0
    orders, balances = S.status_tables(spark, out)
    money = lambda df: {r.user_id: r.amount for r in df.collect()}
    assert money(balances.read()) == money(want["balances"])
    state = lambda df: {r.id: r.status for r in df.collect()}
    assert state(orders.read()) == state(want["orders"])

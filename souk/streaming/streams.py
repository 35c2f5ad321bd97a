"""Structured Streaming versions of limits, alerts, ratings and screening.

Every stream function has a batch twin over the same rows, so a test can
run the stream with ``availableNow`` over a file source and compare.
Stateful operators keep per-key state in the state store (``transformWithState``) and
drop it by event-time timers once no later event can still see it, or by a TTL.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from souk.functions.text import screen_reason
from souk.operators.folds import ordered_fold
from souk.operators.ordering import stored
from souk.operators.segments import PART, next_ranks, reached, running, segments
from souk.session import checkpoint_dir, ship_package
from souk.sources.buckets import BucketedTable


# ----------------------------------------------------------------------------- T2
@dataclass(frozen=True)
class Policy:
    limit: int
    window_seconds: int


# Limiter policies (attempts allowed per window).
POLICIES = {
    "registration": Policy(3, 3600),      # by client address
    "message": Policy(20, 60),            # by user
    # Fixture policy: the raw events are too sparse for the two above.
    "fixture": Policy(2, 12 * 3600),
}
# Request limits per client (T3), count per tumbling window.
REQUEST_LIMITS = {"auth": (30, "15 minutes"), "all": (300, "1 minute")}

LIMIT_SCHEMA = "attempt_id long, attempt_key string, ts timestamp, attempt_count int, blocked boolean"


# ----------------------------------------------------------------------------- T1 (batch)
def _limit_step(policy: Policy):
    window = dt.timedelta(seconds=policy.window_seconds)

    def step(state, r):
        count, first = state
        now = r["ts"]
        if first is None or now - first > window:
            count, first = 1, now
        else:
            count += 1
        return (count, first), (r["attempt_id"], r["attempt_key"], now, count, count > policy.limit)
    return step


def limit_attempts(attempts: DataFrame, policy: Policy) -> DataFrame:
    """Anchored-window limiter over stored attempts: the window starts at the first
    attempt, resets when an attempt comes more than the window length after that start,
    and an attempt is blocked once the count in the window exceeds the limit."""
    # keys inside one range partition are scanned there; a busy key's window starts are
    # found by pointer doubling: every attempt's next window start is a rank, and the starts
    # are what the chain of these ranks visits from the first attempt.
    a = attempts.select("attempt_id", "attempt_key", F.col("ts").cast("timestamp").alias("ts"))
    s = segments(a, "attempt_key", ["ts", "attempt_id"], "attempts")
    calm = s.rows.join(F.broadcast(s.crossing), "attempt_key", "left_anti").drop(PART)
    counted = ordered_fold(calm, "attempt_key", ["ts", "attempt_id"], lambda r: (0, None), _limit_step(policy), LIMIT_SCHEMA)
    if s.crossing.isEmpty():
        return counted
    busy = s.rows.join(F.broadcast(s.crossing), "attempt_key").drop(PART)
    linked = next_ranks(busy, "attempt_key", "ts", "attempt_id", policy.window_seconds * 1_000_000)
    rows = stored(linked.rows, "attempts-linked")
    starts = reached(rows.select("attempt_key", "rank", "next"), "attempt_key").withColumn("_start", F.col("rank"))
    marked = linked.derive(rows.join(starts, ["attempt_key", "rank"], "left"))
    out = running(marked, "max", _from=F.col("_start"))
    count = (F.col("rank") - F.col("_from") + 1).cast("int")
    return counted.unionByName(out.select("attempt_id", "attempt_key", "ts", count.alias("attempt_count"), (count > policy.limit).alias("blocked")))


# ----------------------------------------------------------------------------- T1 / T4 (stream)
def state_store(spark: SparkSession) -> None:
    """``transformWithState`` keeps its state in RocksDB; it runs with no other provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LimitProcessor(StatefulProcessor):
    """The anchored-window limiter: a key's open window (its attempts, its start) and the timer that ends it.

    Of a key's rows in a micro-batch only the times and ids are held, 16 bytes a row, whose
    number the source's trigger limit bounds; a window is one search, not one step a row.
    """

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "attempts long, first long, expiry long")

    def handleInputRows(self, key, rows, timerValues):
        width, limit = self.policy.window_seconds * 1_000_000, self.policy.limit
        times, ids = [], []
        for pdf in rows:
            times.append(pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64))
            ids.append(pdf["attempt_id"].to_numpy())
        times, ids = np.concatenate(times), np.concatenate(ids)
        order = np.lexsort((ids, times))
        times, ids = times[order], ids[order]
        count, first, expiry = self.window.get() if self.window.exists() else (0, None, None)
        counts, at = np.empty(len(times), np.int64), 0
        while at < len(times):
            if first is None or times[at] - first > width:
                count, first = 0, int(times[at])
            end = int(np.searchsorted(times, first + width, "right"))       # a late row before the window counts in it
            counts[at:end] = count + np.arange(1, end - at + 1)
            count, at = int(counts[end - 1]), end
        if expiry is not None:
            self.handle.deleteTimer(expiry)
        expiry = -(-(first + width) // 1000)
        self.handle.registerTimer(expiry)
        self.window.update((count, first, expiry))
        for a in range(0, len(times), 10_000):
            part = slice(a, a + 10_000)
            yield pd.DataFrame({"attempt_id": ids[part], "attempt_key": key[0], "ts": times[part].astype("datetime64[us]"),
                                "attempt_count": counts[part].astype("int32"), "blocked": counts[part] > limit})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.window.clear()         # no later attempt can fall inside this window
        return iter(())

    def close(self) -> None:
        pass


def limit_attempts_stream(attempts: DataFrame, policy: Policy, watermark: str = "1 minute") -> DataFrame:
    """The limiter on a streaming frame (state per key, cleared by an event-time timer)."""
    ship_package(attempts.sparkSession)
    state_store(attempts.sparkSession)
    a = (attempts.select("attempt_id", "attempt_key", F.col("ts").cast("timestamp").alias("ts"))
         .withWatermark("ts", watermark))
    return a.groupBy("attempt_key").transformWithStateInPandas(LimitProcessor(policy), LIMIT_SCHEMA, "append", "eventTime")


# ----------------------------------------------------------------------------- T3
def request_rate(events: DataFrame, key: str = "client", ts: str = "ts", limit: int = 30,
                 window: str = "15 minutes", watermark: str | None = None) -> DataFrame:
    """Requests per client per tumbling window, ``limited`` when above the limit.

    Works on batch and streaming frames. On a stream give ``watermark`` and run it
    in ``update`` mode (``upsert_batch`` on (client, window_start)): windows older
    than the watermark leave the state store, so state stays bounded.
    """
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        e = e.withWatermark(ts, watermark)
    return (e.groupBy(F.window(ts, window).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(key, F.col("w.start").alias("window_start"), "requests",
                    (F.col("requests") > limit).alias("limited")))


# ----------------------------------------------------------------------------- T5
POLL_SECONDS = 8


def unread_alerts(notifications: DataFrame, poll_seconds: int = POLL_SECONDS) -> DataFrame:
    """Per user and poll tick: unread count after the tick and whether the page alerts
    (count rose and the previous count was not 0 — the first poll never alerts)."""
    from souk.operators.history import running_sum
    n = (notifications.filter(~F.col("is_read"))
         .withColumn("tick", F.floor(F.unix_seconds(F.col("created_at").cast("timestamp")) / poll_seconds)))
    per = n.groupBy("user_id", "tick").agg(F.count(F.lit(1)).alias("arrived"))
    per = per.withColumn("tick_ts", F.timestamp_seconds(F.col("tick") * poll_seconds))
    cum = running_sum(per, "user_id", "tick_ts", "tick", F.col("arrived"), "unread_count")
    return cum.select("user_id", F.col("tick_ts").alias("poll_at"), "arrived",
                      F.col("unread_count").cast("bigint").alias("unread_count"),
                      ((F.col("unread_count") - F.col("arrived")) > 0).alias("alert"))


class AlertProcessor(StatefulProcessor):
    """Unread alerts: the open poll, the count before it and its arrivals; with ``ttl_ms`` a user idle for so long is forgotten."""

    def __init__(self, poll_seconds: int, ttl_ms: int | None):
        self.poll_seconds, self.ttl_ms = poll_seconds, ttl_ms

    def init(self, handle) -> None:
        self.poll = handle.getValueState("poll", "tick long, before long, arrived long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        tick, before, arrived = self.poll.get() if self.poll.exists() else (None, 0, 0)
        seen: dict[int, int] = {}
        for pdf in rows:                             # only counts are kept of each Arrow batch
            secs = pdf["created_at"].to_numpy().astype("datetime64[s]").astype("int64")
            for t, n in zip(*np.unique(secs // self.poll_seconds, return_counts=True)):
                t = int(t) if tick is None else max(int(t), tick)     # late rows are seen at the open poll
                seen[t] = seen.get(t, 0) + int(n)
        ticks, new, old = sorted(seen), [], []
        for t in ticks:
            if t != tick:
                tick, before, arrived = t, before + arrived, 0
            arrived += seen[t]
            new.append(arrived)
            old.append(before)
        self.poll.update((tick, before, arrived))
        polls = (np.array(ticks, "int64") * self.poll_seconds).astype("datetime64[s]").astype("datetime64[us]")
        new, old = np.array(new, "int64"), np.array(old, "int64")
        yield pd.DataFrame({"user_id": key[0], "poll_at": polls, "arrived": new, "unread_count": old + new, "alert": old > 0})

    def close(self) -> None:
        pass


def unread_alerts_stream(notifications: DataFrame, poll_seconds: int = POLL_SECONDS, idle_days: int | None = None) -> DataFrame:
    """T5 in ``update`` mode: a poll that spans micro-batches is emitted again with its new
    counts, so the sink keeps the last row of each (user_id, poll_at) (``upsert_batch``).
    The state is three numbers a user, kept while the user has unread rows to count from; with
    ``idle_days`` it expires (TTL) and a user who comes back starts at a first poll."""
    ship_package(notifications.sparkSession)
    state_store(notifications.sparkSession)
    n = notifications.filter(~F.col("is_read")).select(
        "user_id", F.col("created_at").cast("timestamp").alias("created_at"))
    ttl = idle_days * 86_400_000 if idle_days else None
    return n.groupBy("user_id").transformWithStateInPandas(
        AlertProcessor(poll_seconds, ttl), "user_id string, poll_at timestamp, arrived long, unread_count long, alert boolean",
        "update", "processingTime" if ttl else "none")


# ----------------------------------------------------------------------------- T6
def streaming_ratings(reviews: DataFrame) -> DataFrame:
    """Rating and count per service, kept current (use output mode ``update``)."""
    return reviews.groupBy("service_id").agg(
        F.avg("rating").alias("avg_r"), F.count(F.lit(1)).alias("reviews_count"))


def upsert_batch(target_path: str, keys: list[str], select=None):
    """``foreachBatch`` sink for update-mode streams: the batch's rows replace the rows with the
    same key in a bucketed table (C14 set mode). An epoch writes its own rows; a replayed
    epoch is written once; an epoch whose predecessor is missing fails the batch."""
    def write(batch: DataFrame, epoch: int) -> None:
        BucketedTable(batch.sparkSession, target_path, keys).upsert(select(batch) if select else batch, epoch)
    return write


def upserted(spark: SparkSession, target_path: str, keys: list[str]) -> DataFrame:
    """The newest committed state of a table written by ``upsert_batch``."""
    return BucketedTable(spark, target_path, keys).read()


def ratings_upsert_batch(target_path: str):
    """T6 sink: service ratings (2 decimals) merged by service."""
    return upsert_batch(target_path, ["service_id"], lambda b: b.select(
        "service_id", F.col("avg_r").cast("decimal(3,2)").alias("rating"), "reviews_count"))


# ----------------------------------------------------------------------------- T7
def screen_stream(texts: DataFrame, text_col: str = "body", field_col: str = "field") -> DataFrame:
    """Stateless screening on arriving rows: the Q7 expression, unchanged."""
    return texts.withColumn("reason", screen_reason(F.col(text_col), F.col(field_col)))


# ----------------------------------------------------------------------------- T8
def status_stream_batch(T, base: str, orders: DataFrame | None = None):
    """``foreachBatch`` sink for T8: apply a micro-batch of status requests with C2
    against the current orders, write the outcomes and every effect (log, ledger and
    notification rows of the epoch), and the changed orders and balances.

    Orders and balances are bucketed tables: version 0 is the given snapshot, epoch e reads
    the buckets its requests touch from version e and writes the changed rows as version
    e + 1. Outcomes and effects are overwritten per epoch, so a replayed epoch writes the same."""
    from souk.operators.changes import apply_status_changes, status_effects

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        o, b = status_tables(spark, base)
        if epoch == 0:
            o.upsert(orders if orders is not None else T["orders"], 0)
            b.upsert(T["balances"].select("user_id", "amount"), 0)
        touched = [r[0] for r in batch.select(o.bucket_of(["order_id"]).alias("b")).distinct().collect()]       # at most a table's buckets
        # merged once, as the outcomes and every effect read it
        current = stored(o.read(epoch, touched).join(batch.select(F.col("order_id").alias("id")).distinct(), "id", "left_semi"), "status-orders")
        out = apply_status_changes(T, batch, current, split="scan")       # the trigger bounds the batch
        out.write.mode("overwrite").parquet(f"{base}/outcomes/epoch={epoch}")
        outcomes = spark.read.parquet(f"{base}/outcomes/epoch={epoch}")
        ids = outcomes.filter("status = 'accepted'").select(F.col("order_id").alias("id")).distinct()
        sides = current.join(ids, "id", "left_semi").select(F.explode(F.array("customer_id", "executor_id")).alias("u"))
        users = [r[0] for r in sides.select(b.bucket_of(["u"])).distinct().collect()]
        balances = b.read(epoch, users).join(sides.select(F.col("u").alias("user_id")).distinct(), "user_id", "left_semi")
        effects = status_effects({"balances": stored(balances, "status-balances")}, outcomes, batch, orders=current, keep=True)
        for name in ("status_log", "transactions", "notifications"):
            effects[name].write.mode("overwrite").parquet(f"{base}/{name}/epoch={epoch}")
        o.upsert(effects["orders"].join(ids, "id", "left_semi"), epoch + 1)
        paid = spark.read.parquet(f"{base}/transactions/epoch={epoch}").select("user_id").distinct()
        b.upsert(effects["balances"].join(paid, "user_id", "left_semi"), epoch + 1)
    return run


def status_tables(spark: SparkSession, base: str) -> tuple[BucketedTable, BucketedTable]:
    """The orders and the balances that ``status_stream_batch`` keeps under ``base``."""
    return BucketedTable(spark, f"{base}/orders", ["id"]), BucketedTable(spark, f"{base}/balances", ["user_id"])


# ----------------------------------------------------------------------------- running
def run_available(spark: SparkSession, stream: DataFrame, mode: str = "append",
                  foreach_batch=None) -> DataFrame:
    """Run a stream over everything available now, then return its result table.

    Results go to a parquet table (or the given ``foreachBatch``) under the
    session's checkpoint folder, so executors, not the driver, hold them.
    """
    base = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{base}/_chk").trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.outputMode(mode).foreachBatch(foreach_batch).start()
    else:
        q = w.outputMode(mode).format("parquet").option("path", f"{base}/out").start()
    q.awaitTermination()
    return base


def stream_source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A file stream over one of the driver's parquet tables."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
            .option("maxFilesPerTrigger", 1).parquet(sf_dir))

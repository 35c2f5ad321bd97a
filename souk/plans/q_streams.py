"""Registered stream operators (T rows) and their batch twins.

A stream query writes its input rows (derived from the driver's tables) as
files under the session's checkpoint folder, runs the streaming plan over
them with ``availableNow`` and returns the result table, so each stream is
checked against the same SQL as its batch twin.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from souk.plans.registry import REGISTRY, register
from souk.session import checkpoint_dir
from souk.streaming import streams as S

P = S.POLICIES["fixture"]


FILE_ROWS, FILE_BYTES = 500_000, 64 << 20


def _as_stream(df: DataFrame, files: int = 1, time_col: str | None = None) -> DataFrame:
    """Write ``df`` as ``files`` parquet files and open a file stream over them.

    With ``time_col`` the files hold consecutive time ranges and are written one
    after another, so the stream sees rows in arrival (time) order, as a live
    source would deliver them; a watermark then drops nothing that is on time.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stream_in/{uuid.uuid4().hex}"
    # files per range follow the data: about FILE_ROWS rows or FILE_BYTES each, all of a range in one trigger
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(8 * len(df.columns)).cast("long"))
    rows, volume = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    each = max(1, -(-rows // (files * FILE_ROWS)), -(-volume // (files * FILE_BYTES)))
    if time_col and files > 1:
        t = F.unix_micros(F.col(time_col).cast("timestamp"))
        cuts = df.select(t.alias("_t")).approxQuantile("_t", [i / files for i in range(1, files)], 0.01)
        bounds = [None, *cuts, None]
        for lo, hi in zip(bounds, bounds[1:]):
            part = df
            if lo is not None:
                part = part.filter(t > lo)
            if hi is not None:
                part = part.filter(t <= hi)
            part.repartition(each).write.mode("append").parquet(path)
    else:
        df.repartition(files * each).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def _run(stream: DataFrame, mode: str = "append", foreach=None) -> DataFrame:
    spark = stream.sparkSession
    base = S.run_available(spark, stream, mode, foreach)
    return spark.read.parquet(f"{base}/out")


_LIMIT_SQL = """
WITH RECURSIVE a AS (
  SELECT attempt_id, attempt_key, ts,
         row_number() OVER (PARTITION BY attempt_key ORDER BY ts, attempt_id) AS rn FROM m_attempts),
f AS (
  SELECT attempt_key, rn, attempt_id, ts, ts AS first_at, 1 AS cnt FROM a WHERE rn = 1
  UNION ALL
  SELECT a.attempt_key, a.rn, a.attempt_id, a.ts,
         CASE WHEN a.ts - f.first_at > INTERVAL 12 HOUR THEN a.ts ELSE f.first_at END,
         CASE WHEN a.ts - f.first_at > INTERVAL 12 HOUR THEN 1 ELSE f.cnt + 1 END
  FROM f JOIN a ON a.attempt_key = f.attempt_key AND a.rn = f.rn + 1)
SELECT attempt_id, attempt_key, ts, cnt AS attempt_count, cnt > 2 AS blocked FROM f"""

register("limit_attempts", _LIMIT_SQL, "T1/T2: anchored-window limiter over attempts (batch)")(
    lambda T: S.limit_attempts(T["attempts"], P))

register("limit_attempts_stream", _LIMIT_SQL, "T1/T4: the limiter as a stateful stream")(
    lambda T: _run(S.limit_attempts_stream(
        _as_stream(T["attempts"].withColumn("ts", F.col("ts").cast("timestamp")), files=3, time_col="ts"),
        P, "1 hour")))

register("request_rate", """
SELECT attempt_key AS client, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS requests,
       count(*) > 30 AS limited
FROM m_attempts GROUP BY ALL""", "T3: requests per client per 15-minute window")(
    lambda T: S.request_rate(T["attempts"].withColumnRenamed("attempt_key", "client")))


def _rate_stream(T):
    src = _as_stream(T["attempts"].withColumnRenamed("attempt_key", "client")
                     .withColumn("ts", F.col("ts").cast("timestamp")), files=4, time_col="ts")
    spark = src.sparkSession
    base = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    q = (S.request_rate(src, watermark="1 hour").writeStream.outputMode("update")
         .option("checkpointLocation", f"{base}/_chk").trigger(availableNow=True)
         .foreachBatch(S.upsert_batch(base, ["client", "window_start"])).start())
    q.awaitTermination()
    return S.upserted(spark, base, ["client", "window_start"])


register("request_rate_stream", """
SELECT attempt_key AS client, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS requests,
       count(*) > 30 AS limited
FROM m_attempts GROUP BY ALL""", "T3: the same counts from a watermarked stream")(_rate_stream)

_ALERT_SQL = """
SELECT user_id, timestamp '1970-01-01 00:00:00' + INTERVAL 1 SECOND * cast(tick * 8 as bigint) AS poll_at,
       arrived, cum AS unread_count, cum - arrived > 0 AS alert
FROM (
  SELECT user_id, tick, arrived,
         sum(arrived) OVER (PARTITION BY user_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM (SELECT user_id, cast(floor(epoch(created_at) / 8) as bigint) AS tick, count(*) AS arrived
        FROM m_notifications WHERE NOT is_read GROUP BY 1, 2) p) q"""

register("unread_alerts", _ALERT_SQL, "T5: unread count per poll and alert flag (batch)")(
    lambda T: S.unread_alerts(T["notifications"]))

def _alert_stream(T):
    n = T["notifications"].withColumn("created_at", F.col("created_at").cast("timestamp"))
    src = _as_stream(n, files=3, time_col="created_at")
    base = f"{checkpoint_dir(src.sparkSession)}/alerts/{uuid.uuid4().hex}"
    q = (S.unread_alerts_stream(src).writeStream.outputMode("update")
         .option("checkpointLocation", f"{base}/_chk").trigger(availableNow=True)
         .foreachBatch(S.upsert_batch(base, ["user_id", "poll_at"])).start())
    q.awaitTermination()
    return S.upserted(src.sparkSession, base, ["user_id", "poll_at"])


register("unread_alerts_stream", _ALERT_SQL, "T5: the alerts as a stateful stream over several micro-batches")(_alert_stream)


def _ratings_stream(T):
    src = _as_stream(T["reviews"].select("service_id", "rating"), files=4)
    spark = src.sparkSession
    base = f"{checkpoint_dir(spark)}/ratings/{uuid.uuid4().hex}"
    q = (S.streaming_ratings(src).writeStream.outputMode("update")
         .option("checkpointLocation", f"{base}/_chk").trigger(availableNow=True)
         .foreachBatch(S.ratings_upsert_batch(base)).start())
    q.awaitTermination()
    return S.upserted(spark, base, ["service_id"]).select(
        "service_id", F.col("rating").cast("double").alias("rating"), "reviews_count")


register("streaming_ratings", """
SELECT service_id, cast(cast(avg(rating) as decimal(3,2)) as double) AS rating, count(*) AS reviews_count
FROM m_reviews GROUP BY service_id""", "T6: ratings kept current by an update-mode stream")(_ratings_stream)

register("screen_stream", REGISTRY["screen_texts"].sql,
         "T7: the Q7 screening expression on arriving rows")(
    lambda T: _run(S.screen_stream(_as_stream(T["texts"], files=3))).select("doc_id", "field", "reason"))


def _status_stream(T):
    reqs = T["req_status"]
    src = _as_stream(reqs.withColumn("ts", F.col("ts").cast("timestamp")), files=3, time_col="ts")
    spark = src.sparkSession
    base = f"{checkpoint_dir(spark)}/status_stream/{uuid.uuid4().hex}"
    start = T["orders"].withColumn("status", F.lit("created"))
    q = (src.writeStream.option("checkpointLocation", f"{base}/_chk").trigger(availableNow=True)
         .foreachBatch(S.status_stream_batch(T, base, start)).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/outcomes").drop("epoch")


register("apply_status_stream", REGISTRY["apply_status_changes"].sql,
         "T8: status changes arriving as a stream, C2 per micro-batch on the current orders")(_status_stream)


_REG = S.POLICIES["registration"]
register("limit_attempts_registration", _LIMIT_SQL.replace("INTERVAL 12 HOUR", "INTERVAL 1 HOUR")
         .replace("cnt > 2 AS blocked", "cnt > 3 AS blocked"),
         "T1/T2: the limiter under the registration policy (3 per hour)")(
    lambda T: S.limit_attempts(T["attempts"], _REG))

_ALL_LIMIT, _ALL_WINDOW = S.REQUEST_LIMITS["all"]
register("request_rate_all", """
SELECT attempt_key AS client, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS requests,
       count(*) > 300 AS limited
FROM m_attempts GROUP BY ALL""", "T3: requests per client per minute against the global limit")(
    lambda T: S.request_rate(T["attempts"].withColumnRenamed("attempt_key", "client"),
                             limit=_ALL_LIMIT, window=_ALL_WINDOW))

"""Sinks (S6-S8): appends, versioned snapshots published by a manifest, JSON export.

Parquet has no in-place update, so a changed table is written as a new
version directory and made current by writing a small manifest last: a
reader that follows the manifest sees either the old or the new version,
never a half-written one, and a failed run leaves the previous version
current. A retried task rewrites the same files (deterministic ids, F24).
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows (new orders, ledger rows, notifications, ...)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_snapshot(tables: dict[str, DataFrame], base: str, version: str | None = None,
                   partition_by: dict[str, list[str]] | None = None) -> str:
    """Write every table of a run under ``base/v=<version>/<table>``, then the manifest.

    All tables of one run share a version, so a run is published as a whole.
    """
    version = version or f"{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            w = w.partitionBy(*partition_by[name])
        w.parquet(f"{base}/v={version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    manifest = json.dumps({"version": version, "tables": sorted(tables), "at": time.time_ns()})
    # a new file per version; the older ones stay, so a reader always finds a whole one
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("append").text(f"{base}/_manifests")
    return version


def current_version(spark: SparkSession, base: str) -> dict:
    """The newest manifest (one line per published version is read)."""
    newest = spark.read.text(f"{base}/_manifests").select(F.max_by(
        "value", F.get_json_object("value", "$.at").cast("long"))).first()[0]
    return json.loads(newest)


def read_snapshot(spark: SparkSession, base: str, table: str) -> DataFrame:
    v = current_version(spark, base)["version"]
    return spark.read.parquet(f"{base}/v={v}/{table}")


def export_json(df: DataFrame, path: str, nest: dict[str, tuple[DataFrame, str, list[str]]] | None = None) -> None:
    """JSON documents, optionally with nested child lists.

    ``nest`` maps a field name to (child frame, join key, order columns); the
    children are grouped per key and sorted by the order columns. Use it for
    bounded lists (top-k rows per key), never for an unbounded thread.
    """
    out = df
    for fld, (child, key, order) in (nest or {}).items():
        payload = [c for c in child.columns if c != key]
        lists = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[
            c for c in payload if c not in order]))).alias(fld))
        out = out.join(lists, out["id"] == lists[key], "left").drop(key)
    out.write.mode("overwrite").json(path)

"""Session helpers.

Jobs never create their own cluster settings: they take the session they are
given. ``get_session`` is only for tests, benchmarks and local runs.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app: str = "souk") -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SOUK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and written snapshots.

    Reads ``spark.checkpoint.dir`` from the session (a cluster names a shared
    folder there). When it is unset, a local master gets a scratch folder of
    its own; anywhere else that is an error, as executors don't share folders.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session has no local context
        sc = None
    if not d and sc is not None:
        d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        master = sc.master if sc is not None else ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="souk-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Spark drops the shuffle files of a write run in here when it ends. Otherwise they stay until
    the driver's garbage collector finds them unused, on the disk beside all that is written meanwhile."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings to start a large run with (apply them when building the session).

    Shuffle partitions are sized so one partition is about ``target_partition_bytes``
    of input (and at least two waves of tasks); AQE then coalesces small ones and
    splits skewed ones. Scans split files at the same size. Streams keep their state
    in RocksDB so large per-key state does not sit on the JVM heap.
    """
    slots = executors * cores_per_executor
    partitions = max(2 * slots, -(-int(input_bytes) // target_partition_bytes))
    return {
        **REQUIRED_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }


def ship_package(spark: SparkSession) -> None:
    """Make ``souk`` importable on the executors' Python workers (once per session).

    Operators that run Python on executors (the ordered folds, the stateful
    streams) reference functions of this package; the workers import it from a
    zip that Spark distributes with ``addPyFile`` (as ``--py-files`` would).
    """
    if spark.conf.get("souk.shipped", None):
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="souk-pkg-", dir="/tmp")
    archive = shutil.make_archive(os.path.join(out, "souk"), "zip", root_dir=os.path.dirname(pkg),
                                  base_dir=os.path.basename(pkg))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("souk.shipped", archive)

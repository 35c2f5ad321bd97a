"""A keyed table for stream sinks whose writes follow the batch, not the table.

Rows are hashed by key into a fixed number of buckets. A version writes the batch's rows
only, one folder a bucket, and a manifest (one line a bucket) that lists which versions'
folders make up the bucket. A reader takes, per key, the row of the newest version. A
bucket made of ``most`` folders is rewritten as one by the version that touches it next,
so reads stay bounded and every row is rewritten about once in ``most`` versions that touch
its bucket. ``expire`` removes folders that the newest manifests don't list.

A version is there once its manifest is (written last, with its ``_SUCCESS``): a crash before
that leaves the version before it current, and the replayed batch overwrites what the
crash left. A version that is there already isn't written again. A version whose
predecessor is missing is an error.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, MOST = 64, 8
_BUCKET, _VERSION = "_bucket", "_version"


class BucketedTable:
    def __init__(self, spark: SparkSession, base: str, keys: list[str], buckets: int = BUCKETS, most: int = MOST):
        self.spark, self.base, self.keys, self.buckets, self.most = spark, base.rstrip("/"), list(keys), buckets, most

    # ------------------------------------------------------------------ files
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.base}/_manifests/v{version:08d}"

    def _folder(self, version: int) -> str:
        return f"{self.base}/data/v{version:08d}"

    def exists(self, version: int) -> bool:
        path, fs = self._fs(f"{self._manifest(version)}/_SUCCESS")
        return fs.exists(path)

    def versions(self) -> list[int]:
        """The committed versions, oldest first."""
        path, fs = self._fs(f"{self.base}/_manifests/v*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName()[1:]) for s in fs.globStatus(path) or [])

    def manifest(self, version: int) -> tuple[T.StructType, dict[int, list[int]]]:
        """Schema and, per bucket, the versions whose folders it is made of (at most ``buckets`` lines)."""
        if not self.exists(version):
            raise FileNotFoundError(f"{self.base} has no version {version}")
        lines = [json.loads(r.value) for r in self.spark.read.text(self._manifest(version)).collect()]
        schema = next(x["schema"] for x in lines if "schema" in x)
        return T.StructType.fromJson(schema), {x["bucket"]: x["versions"] for x in lines if "bucket" in x}

    # ------------------------------------------------------------------ reads
    def bucket_of(self, columns: list[str] | None = None):
        return F.pmod(F.xxhash64(*(columns or self.keys)), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest if none is given), of some buckets or of all."""
        if version is None:
            there = self.versions()
            if not there:
                raise FileNotFoundError(f"no committed version under {self.base}")
            version = there[-1]
        schema, made = self.manifest(version)
        made = made if only is None else {b: made[b] for b in only if b in made}
        return self._merged(schema, made)

    def _merged(self, schema: T.StructType, made: dict[int, list[int]]) -> DataFrame:
        paths = [f"{self._folder(v)}/{_BUCKET}={b}" for b, vs in sorted(made.items()) for v in vs]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(_VERSION, T.IntegerType())])).parquet(*paths)
        if all(len(vs) == 1 for vs in made.values()):
            return rows.drop(_VERSION)
        whole = F.struct(*[F.col(f"`{c}`") for c in schema.names])
        newest = rows.groupBy(*self.keys).agg(F.max_by(whole, _VERSION).alias("_r"))
        return newest.select("_r.*")

    # ------------------------------------------------------------------ writes
    def upsert(self, rows: DataFrame, version: int) -> None:
        """Write ``rows`` (one a key) as ``version``; rows with the same key are replaced."""
        if self.exists(version):
            return                                        # a replayed batch
        if version == 0:
            schema, made = rows.schema, {}
        else:
            schema, made = self.manifest(version - 1)
        new = rows.select(*schema.names).withColumn(_BUCKET, self.bucket_of()).withColumn(_VERSION, F.lit(version))
        path = self._folder(version)
        full = [b for b, vs in made.items() if len(vs) >= self.most]
        if full:
            touched = [r[0] for r in new.select(_BUCKET).distinct().collect()]        # at most ``buckets``
            full = sorted(set(full) & set(touched))
        if full:
            old = self._merged(schema, {b: made[b] for b in full})
            old = old.join(new.select(*self.keys), self.keys, "left_anti").select(*schema.names)
            new = new.unionByName(old.withColumn(_BUCKET, self.bucket_of()).withColumn(_VERSION, F.lit(version)))
        new.repartition(F.col(_BUCKET)).write.mode("overwrite").partitionBy(_BUCKET).parquet(path)
        for b in self._written(path):
            made[b] = [version] if b in full else [*made.get(b, []), version]
        lines = [json.dumps({"schema": json.loads(_nullable(schema).json())})]
        lines += [json.dumps({"bucket": b, "versions": vs}) for b, vs in sorted(made.items())]
        self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(self._manifest(version))

    def _written(self, path: str) -> list[int]:
        found, fs = self._fs(f"{path}/{_BUCKET}=*")
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.globStatus(found) or [])

    def expire(self, keep: int = 2) -> int:
        """Remove manifests but for the newest ``keep``, and folders that these don't list; how many folders went."""
        there = self.versions()
        kept = there[-keep:]
        listed = {(v, b) for k in kept for b, vs in self.manifest(k)[1].items() for v in vs}
        gone = 0
        for v in range(0, (kept or [0])[-1] + 1):
            for b in self._written(self._folder(v)):
                if (v, b) not in listed:
                    path, fs = self._fs(f"{self._folder(v)}/{_BUCKET}={b}")
                    fs.delete(path, True)
                    gone += 1
        for v in there[:-keep]:
            path, fs = self._fs(self._manifest(v))
            fs.delete(path, True)
        return gone


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])

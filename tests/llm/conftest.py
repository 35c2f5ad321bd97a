import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text[, source]) as a documents table, spread over a few partitions."""
    def make(rows, extra=None):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOC).repartition(3)
        for name, value in (extra or {}).items():
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit(value))
        return df
    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


CLASH = {k: "x" for k in ("spans", "score", "evidence", "rate", "size", "target", "taken", "fingerprint", "entities", "node",
                          "root", "key", "rowkey", "bucket", "_part", "_hit_mask", "_mix_rate", "_lookup", "kept", "words", "n")}


@pytest.fixture(scope="session")
def clash():
    return CLASH

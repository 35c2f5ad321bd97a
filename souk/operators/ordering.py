"""Totals over a global order without a task that sees all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from souk.session import checkpoint_dir, shuffles_dropped


def stored(df: DataFrame, name: str, tight: bool = False) -> DataFrame:
    """``df`` written to the session's shared folder and read again: computed once, lineage cut.

    ``tight`` is for tables of the input's size: ids packed closer (zstd), no shuffle file left behind.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if tight:
        with shuffles_dropped(spark):
            df.write.option("compression", "zstd").parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``df`` plus, per entry of ``sums``, the total over all rows before this one in ``order``.

    The rows are range-partitioned and written with their partition's number;
    totals run inside a partition and start from the totals of the partitions
    before it (one row each). ``order`` and ``sums`` may use any column of ``df``.
    """
    part = "_part"
    while part.lower() in {c.lower() for c in df.columns}:
        part += "_"
    parts = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), name)
    totals = parts.groupBy(part).agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}")
                                    for k in sums])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{k}")
                              for k, c in sums.items()])
    out = out.join(offsets, part)
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      *[(F.col(f"_o_{k}") + F.col(f"_i_{k}")).alias(k) for k in sums])

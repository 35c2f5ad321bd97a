"""Pages of lists of any length (L2) and of threads nested under their order.

``offset`` makes a page dearer the deeper it lies: everything before it is sorted first.
A page index is the list written once in its order: rows get their position from one
range-partitioned count and are laid out in blocks of ``block_rows`` positions. A page is
then a range of positions in at most two neighbouring blocks (more only if a page is
larger than a block), so the first and the last page read equally many rows.

A thread has no bound, so it is never nested whole: its rows are numbered across range
partitions and gathered in pages of at most ``page_rows`` items, keyed (owner, page).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from souk.operators.ordering import running_totals
from souk.operators.segments import running, segments
from souk.operators.views import Page, clamp_page

POS, BLOCK = "_pos", "_block"


def positions(df: DataFrame, order: list[Column], name: str = "positions") -> DataFrame:
    """``df`` plus its rows' positions from 0 in ``order`` (which must be total), without a task that sees all rows."""
    taken = {c.lower() for c in df.columns} & {POS, BLOCK}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are used by the page index")
    return running_totals(df, order, {POS: F.lit(1).cast("long")}, name)


def page_boundaries(df: DataFrame, order: list[Column], limit: int, key: str = "id") -> DataFrame:
    """One row a page of ``limit`` rows: its number from 1, its rows, and the keys of its first and its last row."""
    page = (F.floor(F.col(POS) / limit) + 1).cast("long").alias("page")
    return positions(df, order).groupBy(page).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min_by(key, POS).alias("first_id"), F.max_by(key, POS).alias("last_id"))


@dataclass
class PageIndex:
    """A list in its order under ``path``: ``rows`` by block, and one row of totals and schema in ``meta`` (written last)."""
    spark: SparkSession
    path: str
    block_rows: int
    total: int
    schema: StructType

    def page(self, page=1, limit=None, default_limit: int = 12, max_limit: int = 50) -> Page:
        """One page with the true total; limits as in ``paginate``, and a page after the last is empty."""
        p, lim = clamp_page(page, limit, default_limit, max_limit)
        first, last = (p - 1) * lim, p * lim - 1
        rows = (self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
                .filter(F.col(BLOCK).between(first // self.block_rows, last // self.block_rows) & F.col(POS).between(first, last))
                .orderBy(POS).limit(lim).drop(POS, BLOCK))
        return Page(rows, self.total, p, lim)


def build_page_index(df: DataFrame, order: list[Column], path: str, block_rows: int = 10_000) -> PageIndex:
    """Write ``df`` in ``order`` under the new folder ``path``. A block is one folder, so ``block_rows`` follows the table
    (a folder per 10,000 rows suits lists of up to some 10^8; a page costs one block whatever the table)."""
    rows = positions(df, order).withColumn(BLOCK, F.floor(F.col(POS) / block_rows).cast("long"))
    rows.sortWithinPartitions(BLOCK, POS).write.partitionBy(BLOCK).parquet(f"{path}/rows")
    spark = df.sparkSession
    written = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    meta = written.agg(F.count(F.lit(1)).alias("total")).withColumn("block_rows", F.lit(block_rows))
    meta.withColumn("schema", F.lit(rows.schema.json())).write.parquet(f"{path}/meta")
    return open_page_index(spark, path)


def open_page_index(spark: SparkSession, path: str) -> PageIndex:
    """An index written before; fails if its writing didn't end."""
    m = spark.read.parquet(f"{path}/meta").first()
    return PageIndex(spark, path, m["block_rows"], m["total"], StructType.fromJson(json.loads(m["schema"])))


# ----------------------------------------------------------------------------- J3 / S8
def nested_pages(child: DataFrame, key: str, order: list[str], page_rows: int = 100) -> DataFrame:
    """(key, page, n_rows, items): the child rows of each key in pages of at most ``page_rows``, numbered from 1.

    ``order`` must be total inside a key. Rows without a key are left out. A key's rows are counted
    over range partitions, so neither a task nor a row holds a whole thread.
    """
    ranked = running(segments(child, key, order, "pages"), _n=F.lit(1))
    item = F.struct(*order, *[c for c in child.columns if c != key and c not in order])
    page = F.floor((F.col("_n") - 1) / page_rows + 1).cast("long").alias("page")
    return ranked.groupBy(key, page).agg(F.count(F.lit(1)).alias("n_rows"), F.sort_array(F.collect_list(item)).alias("items"))


def thread_pages(T, page_rows: int = 100) -> DataFrame:
    """Each order's chat lines with their senders' names, in pages."""
    u = T["users"].select(F.col("id").alias("_u"), F.col("name").alias("sender_name"))
    lines = T["messages"].join(u, F.col("sender_id") == F.col("_u")).drop("_u")
    return nested_pages(lines, "order_id", ["created_at", "id"], page_rows)


def log_pages(T, page_rows: int = 100) -> DataFrame:
    """Each order's status changes, in pages."""
    return nested_pages(T["status_log"], "order_id", ["created_at", "new_status"], page_rows)


def export_orders(T, path: str, page_rows: int = 100) -> None:
    """JSON lines of every order's header (J3), thread pages and log pages under ``path``; a line is bounded by a page."""
    from souk.operators.views import order_detail
    for name, df in (("messages", thread_pages(T, page_rows)), ("status_log", log_pages(T, page_rows)), ("orders", order_detail(T))):
        df.write.mode("overwrite").json(f"{path}/{name}")

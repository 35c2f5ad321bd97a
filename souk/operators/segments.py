"""Ordered work per key without a task that holds a whole key.

Rows are range-partitioned on (key, order) and written with the number of their
partition, so a busy key is spread over as many partitions as its rows need and
no bucket width has to be guessed. A key's rows in one partition are a *segment*.
Windows run inside segments; what a segment needs from the ones before it is
carried by a table with one row per segment of the keys that cross a partition
border. A partition has at most two such keys (its first and its last), so
this table is bounded by twice the number of partitions, and only it is broadcast.

Equal order values stay together, as the range is cut on values: rows that tie
in (key, order) are in one segment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.operators.ordering import stored

PART = "_part"


@dataclass
class Segments:
    """Rows in range partitions (numbered in ``PART``) by key and order, and the keys in several of them."""
    rows: DataFrame
    key: str
    order: list[str]
    crossing: DataFrame

    def inside(self, frame: str = "rows") -> Window:
        """The window of a segment up to and with the current row (``range``: and its ties)."""
        w = Window.partitionBy(PART, self.key).orderBy(*self.order)
        if frame == "range":
            return w.rangeBetween(Window.unboundedPreceding, 0)
        return w.rowsBetween(Window.unboundedPreceding, 0)

    def derive(self, rows: DataFrame) -> Segments:
        """The same segments with other columns or fewer rows."""
        return Segments(rows, self.key, self.order, self.crossing)

    def carry(self, aggregates: list[Column]) -> DataFrame:
        """Aggregates of each segment of a crossing key: key, PART and the aggregates."""
        busy = self.rows.join(F.broadcast(self.crossing), self.key)
        return busy.groupBy(self.key, PART).agg(*aggregates)

    def attach(self, carried: DataFrame) -> DataFrame:
        """The rows with their segment's carried columns (null for keys in one segment)."""
        carried = carried.withColumnRenamed(self.key, "_ck").withColumnRenamed(PART, "_cp")
        on = (F.col(self.key) == F.col("_ck")) & (F.col(PART) == F.col("_cp"))
        return self.rows.join(F.broadcast(carried), on, "left").drop("_ck", "_cp")


def segments(df: DataFrame, key: str, order: list[str], name: str) -> Segments:
    """Cut ``df`` (rows with a null key are left out) into segments; written once to the shared folder."""
    ranged = df.filter(F.col(key).isNotNull()).repartitionByRange(F.col(key), *[F.col(c) for c in order])
    rows = stored(ranged.withColumn(PART, F.spark_partition_id()), name)
    return Segments(rows, key, list(order), crossing_keys(rows, key, name))


def crossing_keys(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The keys in several of the range partitions numbered in ``PART`` (written to the shared folder)."""
    ends = rows.groupBy(PART).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ends = ends.select(PART, F.explode(F.array_distinct(F.array("low", "high"))).alias(key))
    crossing = ends.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
    return stored(crossing, f"{name}-crossing")


def _before(s: Segments) -> Window:
    return Window.partitionBy(s.key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def running(s: Segments, how: str = "sum", frame: str = "rows", **columns: Column) -> DataFrame:
    """The rows plus, per entry of ``columns``, its sum (or maximum) over the key's rows up to and with
    this one; with ``frame="range"`` over all rows whose order value isn't larger."""
    fn = {"sum": F.sum, "max": F.max}[how]
    carried = s.carry([fn(c).alias(f"_c_{n}") for n, c in columns.items()])
    carried = carried.select(s.key, PART, *[fn(f"_c_{n}").over(_before(s)).alias(f"_o_{n}") for n in columns])
    rows = s.attach(carried).select("*", *[fn(c).over(s.inside(frame)).alias(f"_i_{n}") for n, c in columns.items()])
    # greatest skips nulls: a maximum of nothing before leaves the inner one
    both = {n: F.coalesce(f"_o_{n}", F.lit(0)) + F.coalesce(f"_i_{n}", F.lit(0)) if how == "sum" else F.greatest(f"_o_{n}", f"_i_{n}")
            for n in columns}
    return rows.select(*s.rows.columns, *[c.alias(n) for n, c in both.items()])


def previous(s: Segments, *columns: str) -> DataFrame:
    """The rows plus ``previous_<column>`` of the key's row before each (null for its first)."""
    at = F.struct(*s.order)
    last = s.carry([F.max_by(F.struct(*columns), at).alias("_last")])
    w = Window.partitionBy(s.key).orderBy(PART)
    last = last.select(s.key, PART, F.lag("_last").over(w).alias("_carried"))
    inside = Window.partitionBy(PART, s.key).orderBy(*s.order)
    rows = s.attach(last).withColumn("_lag", F.lag(F.struct(*columns)).over(inside))
    before = F.coalesce("_lag", "_carried")
    return rows.select(*s.rows.columns, *[before[c].alias(f"previous_{c}") for c in columns])


def trailing(df: DataFrame, key: str, ts: str, seconds: int, out: str = "earlier") -> DataFrame:
    """Rows of the same key with ``ts`` in ``[ts - seconds, ts]``, this row excluded, as a difference of ranks:
    how many rows are not later than this one, less how many are before its window.

    Each row asks for the second rank with a probe at the start of its window; rows and
    probes are ranked together, so neither a window nor a key has to fit in a task.
    Rows with a null key are left out.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))              # NTZ columns read as UTC wall time
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    asked = df.select(F.col(key).alias("_k"), t.alias("_t"), whole.alias("_r"), F.monotonically_increasing_id().alias("_id"))
    none = F.lit(None).cast(asked.schema["_r"].dataType)
    events = asked.select("_k", "_id", F.explode(F.array(
        F.struct(F.col("_t").alias("_t"), F.lit(1).alias("_row"), F.col("_r").alias("_r")),
        F.struct((F.col("_t") - int(seconds) * 1_000_000).alias("_t"), F.lit(0).alias("_row"), none.alias("_r")))).alias("e")).select("_k", "_id", "e.*")
    s = segments(events, "_k", ["_t"], "trailing")
    upto = running(s, frame="range", _upto=F.col("_row"))
    same = F.sum("_row").over(Window.partitionBy(PART, "_k", "_t"))      # ties are in one segment
    ranked = upto.withColumn("_rank", F.when(F.col("_row") == 1, F.col("_upto")).otherwise(same - F.col("_upto")))
    counted = ranked.groupBy("_id").agg(F.first("_r", ignorenulls=True).alias("_r"), (F.sum("_rank") - 1).cast("long").alias(out))
    return counted.select("_r.*", out)


def next_ranks(df: DataFrame, key: str, ts: str, tiebreak: str, micros: int) -> Segments:
    """Segments of the rows with ``rank`` in their key and ``next``, the rank of the first row more than ``micros`` later."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    base = segments(df.withColumn("_t", t), key, ["_t", tiebreak], "next-rows")
    ranked = stored(running(base, rank=F.lit(1)), "next-ranked")
    events = ranked.select(F.col(key).alias("_k"), F.col("rank").alias("_rank"), F.explode(F.array(
        F.struct(F.col("_t").alias("_t"), F.lit(1).alias("_row")),
        F.struct((F.col("_t") + int(micros)).alias("_t"), F.lit(0).alias("_row")))).alias("e")).select("_k", "_rank", "e.*")
    s = segments(events, "_k", ["_t"], "next-events")
    upto = running(s, frame="range", _upto=F.col("_row")).filter("_row = 0")
    after = upto.select(F.col("_k").alias("_nk"), F.col("_rank").alias("_nr"), (F.col("_upto") + 1).alias("next"))
    rows = ranked.join(after, (F.col(key) == F.col("_nk")) & (F.col("rank") == F.col("_nr"))).drop("_nk", "_nr")
    return base.derive(rows)


def reached(links: DataFrame, key: str) -> DataFrame:
    """(key, rank) of the rows that a key's chain 1, next(1), next(next(1)), ... visits, by pointer doubling.

    ``links`` has key, rank and next; a next that is no rank ends the chain. Round k follows
    2^k links at once from everything found, then doubles the links: log2(longest chain) rounds.
    """
    steps = links.select(F.col(key).alias("k"), F.col("rank").alias("a"), F.col("next").alias("b"))
    found = stored(steps.filter("a = 1").select("k", F.col("a").alias("at")), "reached")
    rows = links.select(F.col(key).alias("k2"), F.col("rank").alias("a2"))
    jump = stored(steps.join(rows, (F.col("k") == F.col("k2")) & (F.col("b") == F.col("a2")), "left_semi"), "jump")
    while not jump.isEmpty():
        more = found.withColumnRenamed("k", "fk").join(jump, (F.col("at") == F.col("a")) & (F.col("fk") == F.col("k")))
        found = stored(found.unionByName(more.select("k", F.col("b").alias("at"))), "reached")
        twice = jump.select(F.col("k").alias("k2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        jump = stored(jump.join(twice, (F.col("k") == F.col("k2")) & (F.col("b") == F.col("a2")))
                      .select("k", "a", F.col("b2").alias("b")), "jump")
    return found.select(F.col("k").alias(key), F.col("at").alias("rank"))

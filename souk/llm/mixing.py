"""Mixing sources to target weights.

Tokens per source are aggregated first (partial sums before the shuffle, so
a source with a third of all rows is a few rows per task). A source's
repetition rate is its target divided by its size; each document is then
emitted floor(rate) times plus one hash-seeded Bernoulli copy whose
probability is the fraction. The draw is a function of seed and document id
alone, so reruns and recomputed tasks agree.

Targets: the budget ``share`` x (all sizes) is dealt by weight; no source gets
more than ``max_rate`` times its size, the excess goes to the others by weight
until none is above. With the sources sorted by cap / weight this has a closed
form: if exactly the first i are at their cap, the others get weight x
(budget - caps before) / (weights from i on); the largest such level that
caps none from i on is the answer. Prefix sums over the per-source rows give it.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; sources without any word get target 0 and are not emitted; a
null id draws by its text; rows repeated with one id draw alike; an empty
table gives an empty result. Input columns of any name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import fresh, running_totals, stored

TOKEN = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Number of blank-separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """Uniform in [0, 1): the first 52 bits of md5(seed:id)."""
    key = F.coalesce(doc_id.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_rate: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) from (source, size); one row per source.

    The weights repeat along the sources in code-point order, null last.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_totals(per, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "mix-rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (ranked.withColumn("w", w)
              .withColumn("cap", F.lit(float(max_rate)) * F.col("source_size"))
              .withColumn("ratio", F.col("cap") / F.col("w")))
    filled = running_totals(ranked, [F.col("ratio").asc(), F.col("source").asc_nulls_last()],
                            {"caps": F.col("cap"), "ws": F.col("w")}, "mix-fill")
    filled = stored(filled, "mix-filled")
    total = filled.agg((F.lit(float(share)) * F.sum("source_size")).alias("budget"), F.sum("w").alias("all_w"))
    level = (filled.crossJoin(F.broadcast(total))              # one row
             .select("ratio", ((F.col("budget") - F.col("caps")) / (F.col("all_w") - F.col("ws"))).alias("level"))
             .agg(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).alias("level")))
    target = F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("w"))
    out = filled.crossJoin(F.broadcast(level)).withColumn("target", target)   # one row
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_rate)), F.col("target") / F.col("source_size")))
    return out.select("source", "source_size", "target", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def copies(rate: Column, u: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(u < rate - whole, 1).otherwise(0)).cast("int")


def mix_plan(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_rate: float = 2.0,
             seed: str = "mix-1") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies.

    The texts are read once; the narrow (id, source, size, draw) table is
    written and used for the totals and for the result.
    """
    narrow = stored(docs.select("doc_id", "source", token_count(F.col("text")).alias("size"),
                                draw(F.col("doc_id"), F.col("text"), seed).alias("u")), "mix-sizes")
    targets = stored(source_targets(narrow, weights, share, max_rate), "mix-targets").withColumnRenamed("source", "s_")
    out = narrow.join(targets, F.col("source").eqNullSafe(F.col("s_")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate",
                      copies(F.col("rate"), F.col("u")).alias("copies"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_rate: float = 2.0,
        seed: str = "mix-1") -> DataFrame:
    """The mixed corpus: ``docs`` with every row repeated ``copies`` times, same columns.

    Only the per-source table (one row per source) is joined to the texts; it
    is read from storage, so Spark knows its size and broadcasts it only below
    the session's threshold, else it shuffles with skew splitting.
    """
    sizes = docs.select("source", token_count(F.col("text")).alias("size"))
    s, r, k = fresh(docs, "_mix_source", "_mix_rate", "_mix_copy")
    targets = stored(source_targets(sizes, weights, share, max_rate), "mix-targets")
    rates = targets.filter("rate > 0").select(F.col("source").alias(s), F.col("rate").alias(r))
    out = docs.join(rates, F.col("source").eqNullSafe(F.col(s)))
    n = copies(F.col(r), draw(F.col("doc_id"), F.col("text"), seed))
    out = out.withColumn(k, n).filter(F.col(k) > 0)
    return out.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(k)))).select(*docs.columns)

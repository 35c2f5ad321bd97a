"""Document fingerprints by I-Match.

Document frequencies of all terms are counted over all documents (combined
before the shuffle). The lexicon keeps the terms whose inverse document
frequency lies in a chosen band. A document's distinct lexicon terms, sorted,
are hashed once for each of several randomised subsets of the lexicon; the
fingerprint is the list of these hashes. A subset keeps a term by a hash of
(term, subset), with probabilities from 1/2 down to 1/256, so that texts of
any length have subsets in which they hold only a few terms; such a hash
survives an edit that touches none of them.

The lexicon is the only thing that every task gets. Its size is bounded: the
df of all terms sum up to (documents x mean distinct terms), and every kept
term has at least ``min_share`` x documents of them, so there are at most mean
distinct terms / ``min_share`` terms, whatever the corpus' size.

Terms are 64-bit hashes of words (lower-cased runs of letters and digits);
sorting the hashes is the canonical order.

Defined cases: null is an empty text; a text without lexicon terms is hashed
as a whole, so equal texts always have equal fingerprints; terms count once a
document; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from souk.llm.common import GAP_ANY_CASE, fresh, stored

MIN_SHARE, MAX_SHARE = 0.002, 0.05          # idf band: ln(1/0.05) to ln(1/0.002)
LEVELS, SUBSETS = 8, 4                      # subset probabilities 2^-1 .. 2^-8, four subsets each


def terms(text: Column) -> Column:
    """Distinct term hashes of a text."""
    words = F.filter(F.split(F.lower(text), GAP_ANY_CASE), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """(term, df) of the terms in the band, over all documents."""
    held = stored(docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term"))
                  .groupBy("term").agg(F.count("*").alias("df")), "imatch-df")
    n = docs.count()
    return held.filter((F.col("df") >= min_share * n) & (F.col("df") <= max(1.0, max_share * n)))


def lexicon_lookup(lex: DataFrame) -> DataFrame:
    """The lexicon as one row, column ``lookup``: its terms dealt into small lists by their low bits.

    The number of lists is the power of two above the number of terms.
    """
    lex = stored(lex.select("term"), "imatch-lexicon")
    slots = 1 << max(0, lex.count()).bit_length()
    dealt = lex.groupBy(F.col("term").bitwiseAND(slots - 1).alias("slot")).agg(F.collect_list("term").alias("terms"))
    every = lex.sparkSession.range(slots).withColumnRenamed("id", "slot").join(dealt, "slot", "left")
    none = F.expr("cast(array() as array<bigint>)")
    one = every.agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("terms", none).alias("terms")))).alias("a"))
    return stored(one.select(F.transform("a", lambda x: x["terms"]).alias("lookup")), "imatch-lookup")


def fingerprint(text: Column, lookup: Column, levels: int = LEVELS, subsets: int = SUBSETS) -> Column:
    """array<int>: one hash per subset, 0 where the text has no term in it."""
    slot = lambda t: F.get(lookup, t.bitwiseAND(F.size(lookup) - 1).cast("int"))      # noqa: E731
    kept = F.array_sort(F.filter(terms(text), lambda t: F.array_contains(slot(t), t)))

    # a one-element array carries the kept terms into one lambda, so they are computed once
    def all_components(s: Column) -> Column:
        def one(k: int) -> Column:
            level = k // subsets + 1     # keeps 2^-level: the low bits of hash(term, subset) are 0
            part = F.filter(s["kept"], lambda t: F.xxhash64(t, F.lit(k)).bitwiseAND((1 << level) - 1) == 0)
            return F.when(F.size(part) == 0, F.lit(0)).otherwise(F.hash(part))
        whole = F.array_repeat(F.hash(s["text"]), levels * subsets)
        return F.when(F.size(s["kept"]) == 0, whole).otherwise(F.array(*[one(k) for k in range(levels * subsets)]))

    held = F.array(F.struct(kept.alias("kept"), text.alias("text")))
    return F.get(F.transform(held, all_components), F.lit(0))


def likeness(a: Column, b: Column, levels: int = LEVELS, subsets: int = SUBSETS) -> Column:
    """0 to 1: 1 for equal fingerprints, else the best level's share of equal hashes.

    At a level count the subsets in which either text has a term (two at
    least); equal are those with the same hash in both.
    """
    def level(i: Column) -> Column:
        x, y = F.slice(a, i * subsets + 1, subsets), F.slice(b, i * subsets + 1, subsets)
        both = F.arrays_zip(x.alias("x"), y.alias("y"))
        used = F.size(F.filter(both, lambda z: (z["x"] != 0) | (z["y"] != 0)))
        same = F.size(F.filter(both, lambda z: (z["x"] != 0) & (z["x"] == z["y"])))
        return same / F.greatest(used, F.lit(2))

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), level))
    return F.when(a == b, 1.0).otherwise(best).cast("double")


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda h: F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def fingerprints(docs: DataFrame, lookup: DataFrame | None = None, column: str = "text") -> tuple[DataFrame, str]:
    """``docs`` plus a column of fingerprints of ``column``; returns the frame and the column's name."""
    lookup = lexicon_lookup(lexicon(docs)) if lookup is None else lookup
    name, table = fresh(docs, "fingerprint", "_lookup")
    out = docs.crossJoin(F.broadcast(lookup.withColumnRenamed("lookup", table)))      # one row of bounded size
    return out.withColumn(name, fingerprint(F.coalesce(F.col(column), F.lit("")), F.col(table))).drop(table), name


def with_next(docs: DataFrame, columns: list[str], rows_per_bucket: int = 4096, max_buckets: int = 10_000) -> DataFrame:
    """doc_id, ``columns`` and their ``next_`` values: of the next document by descending doc_id, round the end.

    Rows are dealt into ranges of doc_id (bounds from approximate quantiles, at
    most ``max_buckets``) and sorted inside them, so texts are shuffled once.
    The first row of each range is also sent, marked, to the range before it,
    the very first to the last. Equal ids stand by their ``columns``, null ids last.
    """
    n = docs.count()
    buckets = max(1, min(max_buckets, n // rows_per_bucket))
    shares = [float(i / buckets) for i in range(1, buckets)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 100 * buckets)).first()[0] or []), reverse=True) if shares else []
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = (F.when(F.col("doc_id").isNull(), F.lit(len(bounds)))
              .otherwise(F.size(F.filter(table, lambda b: b > F.col("doc_id"))) if bounds else F.lit(0)))
    heads = docs.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy("bucket")                               # one row per bucket
    heads = heads.select("bucket", "head", F.lag("bucket").over(order).alias("before"), F.max("bucket").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    heads = stored(heads.select(F.col("bucket").alias("b_"), "head", F.coalesce("before", "last").alias("before")), "imatch-heads")
    rows = docs.select("doc_id", *columns, bucket.alias("bucket"))
    rows = rows.join(F.broadcast(heads), rows["bucket"] == heads["b_"])     # at most max_buckets rows
    own = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("before").alias("at"), F.lit(True).alias("copy"))
    place = F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, copy)).otherwise(F.array(own)))
    rows = rows.select("doc_id", *columns, place.alias("place")).select("doc_id", *columns, "place.at", "place.copy")
    w = Window.partitionBy("at").orderBy("copy", F.col("doc_id").desc_nulls_last(), *columns)
    return (rows.select("doc_id", *columns, "copy", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
            .filter(~F.col("copy")).drop("copy"))

"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.operators.ordering import running_totals, stored  # noqa: F401  (for the operators)

# Words of a text whose A-Z are lower-cased: runs of anything but ASCII
# characters other than 0-9 and a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words found without lower-casing first (A-Z belong to the run).
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# What stands between two words of an unchanged text.
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` doesn't have (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for b in bases:
        while b.lower() in taken:
            b += "_"
        taken.add(b.lower())
        out.append(b)
    return out


def text_batches(spark: SparkSession, rows: int = 1000, size: int | None = None) -> None:
    """Whole texts go to Python at most ``rows`` at a time, and with ``size`` in batches of about so many bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    if size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def match_spans(text: Column, pattern: Column | str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as array<struct<start,end,hit>>.

    Positions are code points, ``end`` exclusive. The pieces between matches
    come from ``split``, the matches from ``regexp_extract_all``; one fold adds
    up their lengths. The pattern must not match the empty string.
    """
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits = F.regexp_extract_all(text, pat, F.lit(0))
    pieces = F.split(text, pat, -1)
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,hit:string>>)")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"), x["hit"].alias("hit"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("piece"), hits.alias("hit"))
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def many_match_spans(text: Column, pattern: str, chunk: int = 256) -> Column:
    """``match_spans`` for texts with any number of matches: they are folded ``chunk`` at a time,
    so that the list so far is copied once a chunk and not once a match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,hit:string>>)")

    def state(at: Column, out: Column) -> Column:
        return F.struct(at.cast("long").alias("at"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"), x["hit"].alias("hit"))
        return state(end, F.concat(acc["out"], F.array(span)))

    def folded(found: Column) -> Column:
        def add(acc: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(found, k * chunk + 1, F.lit(chunk)), state(acc["at"], empty), step)
            return let(part, lambda p: state(p["at"], F.concat(acc["out"], p["out"])))
        chunks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(found) - 1) / chunk), F.lit(0)).cast("int"))
        return F.aggregate(chunks, state(F.lit(0), empty), add, lambda acc: acc["out"])

    zipped = let(hits, lambda h: F.arrays_zip(F.slice(pieces, F.lit(1), F.size(h)).alias("piece"), h.alias("hit")))
    return let(zipped, folded)

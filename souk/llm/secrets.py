"""Secret scans: fixed shapes plus sliding-window Shannon entropy.

Base spans are three shapes (assignment, access key, hex run), leftmost and
non-overlapping per kind. The method adds spans: maximal runs of a character
class (hex digits, base64 letters) of at least ``WINDOW`` characters are
candidates; a window slides over each, its entropy kept by incremental counts
(one character enters, one leaves, the sum of c*log2(c) changes by two
differences), and the union of the windows at or above the class's threshold is
a span. An allow-list of patterns suppresses candidates (never base spans).

Everything is DataFrame expressions in one scan without a shuffle; the costly
ones run only for texts that a cheap pattern lets through.

Defined cases: null is an empty text with no span; a text may be one long
candidate (the scan is linear in it, the list of matches is copied once in 256); equal texts
get equal spans; columns of any name are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import fresh, let, many_match_spans

# The shapes of the base spans.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16
# A run's failing matches are dropped as a whole, so the length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{%d,}" % (ACCESS_MIN - 4)
HEX = r"(?<![0-9a-f])[0-9a-f]{%d,}" % HEX_MIN
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]

WINDOW = 20
BLOCK = 512          # characters of a candidate scanned by one fold
# kind -> (candidate pattern, alphabet, bits a character)
CLASSES = {
    "entropy_hex": (r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{%d,}" % WINDOW, "0123456789abcdef", 2.8),
    "entropy_base64": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % WINDOW,
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.7),
}
# Candidates that are no secrets: only one sort of character, words, ramps, placeholders, paths.
ALLOW = [
    r"^[0-9]+$", r"^[A-Za-z_-]+$", r"(?i)example|sample|placeholder|changeme|xxxx", r"(?i)0123456789|abcdefghijkl",
    r"^(?:[A-Za-z0-9_-]{1,16}/)++[A-Za-z0-9_-]{0,16}$",       # possessive: no recursion a part of the path
]


def _hot_in_block(t: Column, fold: str, bits: float, window: int) -> Column:
    """Unions of the hot windows of the short string ``t``: array<struct<start,end>> from 0.

    One fold over the characters; its state holds the counts of the window's
    characters, the sum of c*log2(c), and the spans so far.
    """
    term = F.array(*[F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(window + 1)])
    f = lambda c: F.get(term, c)                                                  # noqa: E731
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    zero = F.struct(F.array_repeat(F.lit(0), len(fold)).alias("counts"), F.lit(0.0).alias("sum"), none.alias("out"))
    limit = window * (math.log2(window) - bits) + 1e-9      # entropy >= bits: sum <= limit

    def step(acc: Column, x: Column) -> Column:
        enters, leaves, i = x["enters"], x["leaves"], x["i"]      # codes from 1 (0: none), position from 1
        n_out = F.when(leaves > 0, F.get(acc["counts"], leaves - 1)).otherwise(F.lit(0))
        less = F.when(leaves > 0, f(n_out) - f(n_out - 1)).otherwise(F.lit(0.0))
        n_in = F.get(acc["counts"], enters - 1) - F.when(leaves == enters, 1).otherwise(0)
        total = acc["sum"] - less + f(n_in + 1) - f(n_in)
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k + 1 == enters, 1).otherwise(0)
                             - F.when(k + 1 == leaves, 1).otherwise(0))
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        grown = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1),
                         F.array(F.struct(last["start"].alias("start"), i.alias("end"))))
        opened = F.concat(acc["out"], F.array(F.struct((i - window).alias("start"), i.alias("end"))))
        out = (F.when((i < window) | (total > limit), acc["out"])
               .when((F.size(acc["out"]) > 0) & (last["end"] >= i - window), grown).otherwise(opened))
        return F.struct(counts.alias("counts"), total.alias("sum"), out.alias("out"))

    def scan(codes: Column) -> Column:
        leaving = F.slice(F.concat(F.array_repeat(F.lit(0), window), codes), F.lit(1), F.size(codes))
        moves = F.arrays_zip(codes.alias("enters"), leaving.alias("leaves"), F.sequence(F.lit(1), F.size(codes)).alias("i"))
        return F.aggregate(moves, zero, step, lambda acc: acc["out"])

    return let(F.transform(F.split(t, ""), lambda c: F.instr(F.lit(fold), c)), scan)


def hot_spans(s: Column, alphabet: str, bits: float, window: int = WINDOW, block: int = BLOCK) -> Column:
    """Unions of the windows of ``s`` with at least ``bits`` of entropy: array<struct<start,end>> from 0.

    ``s`` is scanned in blocks, each with the ``window`` - 1 characters before it, so that every window
    ends in one block and the work is linear in the length; spans of neighbouring blocks that meet are one.
    """
    cased = s if alphabet.lower() != alphabet else F.lower(s)

    def blocks_of(blocks: Column) -> Column:
        def scan(b: Column, k: Column) -> Column:
            tail = F.when(k > 0, F.substring(F.get(blocks, k - 1), 1 - window, window - 1)).otherwise("")
            base = F.when(k > 0, k * block - (window - 1)).otherwise(0)
            return F.transform(_hot_in_block(F.concat(tail, b), alphabet, bits, window),
                               lambda m: F.struct((m["start"] + base).alias("start"), (m["end"] + base).alias("end")))
        return F.flatten(F.transform(blocks, scan))

    def merged(spans: Column) -> Column:
        first = F.filter(spans, lambda m, j: (j == 0) | (F.get(spans, j - 1)["end"] < m["start"]))
        last = F.filter(spans, lambda m, j: (j == F.size(spans) - 1) | (F.get(spans, j + 1)["start"] > m["end"]))
        return F.zip_with(first, last, lambda a, z: F.struct(a["start"].alias("start"), z["end"].alias("end")))

    return let(let(F.regexp_extract_all(cased, F.lit(".{1,%d}" % block), F.lit(0)), blocks_of), merged)


def _named(spans: Column, kind: str, shift: Column | None = None) -> Column:
    at = F.lit(0).cast("long") if shift is None else shift
    return F.transform(spans, lambda m: F.struct((m["start"] + at).alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                                                 (m["end"] + at).alias("end"), F.lit(kind).alias("kind")))


def secret_spans(text: Column, window: int = WINDOW, allow=ALLOW) -> Column:
    """All spans of a text (null: none), array<struct<start,rank,end,kind>> by start, then kind."""
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)")

    def where(pattern: str, spans: Column) -> Column:
        return F.when(text.rlike(pattern), spans).otherwise(none)

    value = lambda m: F.regexp_extract(m["hit"], ASSIGN, 2)                       # noqa: E731
    found = [where(ASSIGN, _named(F.filter(many_match_spans(text, ASSIGN), lambda m: F.length(value(m)) >= ASSIGN_MIN), "assign")),
             where(ACCESS, _named(many_match_spans(text, ACCESS), "access")),
             where(HEX, _named(many_match_spans(text, HEX), "hex"))]
    for kind, (pattern, alphabet, bits) in CLASSES.items():
        def allowed(m):
            out = F.lit(False)
            for p in allow:
                out = out | m["hit"].rlike(p)
            return out
        candidates = F.filter(many_match_spans(text, pattern), lambda m: ~allowed(m))
        hot = F.transform(candidates, lambda m: _named(hot_spans(m["hit"], alphabet, bits, window), kind, m["start"]))
        found.append(where(pattern, F.flatten(hot)))
    return F.array_sort(F.concat(*found))


def scan_secrets(docs: DataFrame, window: int = WINDOW, allow=ALLOW) -> tuple[DataFrame, str]:
    """``docs`` plus a column of spans; returns the frame and the column's name."""
    name, = fresh(docs, "spans")
    return docs.withColumn(name, secret_spans(F.coalesce(F.col("text"), F.lit("")), window, allow)), name


PIECE = 4096         # characters of a text in which spans are replaced at a time


def redact(docs: DataFrame, mark: str = "[SECRET]", window: int = WINDOW, allow=ALLOW) -> DataFrame:
    """``docs`` with every secret replaced by ``mark``, same columns; other texts stay as they are.

    Overlapping spans become one mark, also over the borders of the pieces in which a text is cut. ``n_chars``, if there, follows the text.
    """
    out, name = scan_secrets(docs, window, allow)
    text = F.col("text")

    def cleaned(piece: Column, k: Column) -> Column:            # a piece of the text and its number
        begin = (k * PIECE).cast("long")

        def step(acc: Column, s: Column) -> Column:
            before = F.substring(piece, (acc["at"] - begin + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
            more = F.concat(acc["out"], before, F.when(s["start"] >= acc["at"], mark).otherwise(""))
            return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(more.alias("out"), s["end"].alias("at")))

        here = F.filter(F.col(name), lambda s: (s["start"] < begin + PIECE) & (s["end"] > begin))
        return F.aggregate(here, F.struct(F.lit("").alias("out"), begin.alias("at")), step, lambda acc: F.concat(
            acc["out"], F.substring(piece, (acc["at"] - begin + 1).cast("int"), F.length(piece))))

    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))
    cut = F.array_join(F.transform(pieces, cleaned), "")
    hit = F.size(name) > 0
    new, = fresh(out, "_new_text")
    out = out.withColumn(new, F.when(hit, cut).otherwise(text))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(hit, F.length(new).cast(kind)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(new)).select(*docs.columns)

"""Token counts: an exact length histogram.

Documents are encoded with a public tokenizer (byte-level BPE ranks, read
through Spark and broadcast: the vocabulary is a file of fixed size, checked
against ``MAX_VOCABULARY``); the counts are aggregated by encoded length, and
suffix sums over the histogram answer, for every context limit that is some
document's length, how many documents and tokens lie above it, what a corpus
truncated at the limit holds, and which quantile the limit is.

The histogram has one row per distinct length (partial counts before the
shuffle); the running totals are range-partitioned, so no task holds it all.

Defined cases: null and empty texts have 0 tokens; special-token strings are
ordinary text; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import running_totals, stored, text_batches
from souk.session import ship_package

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How byte-level BPE of this kind splits a text before merging (fixed value of the tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
MAX_VOCABULARY = 64 << 20
# Texts are encoded in pieces cut before white space, where the pattern always begins anew.
_ENCODERS: dict = {}


def _encoder(key, ranks: bytes):
    if key not in _ENCODERS:
        import tiktoken
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _ENCODERS[key] = tiktoken.Encoding("shared", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})
    return _ENCODERS[key]


def document_lengths(docs: DataFrame, tokenizer: str = TOKENIZER, column: str = "n_tokens") -> DataFrame:
    """``docs`` with the encoded length of each text in ``column`` instead of its text."""
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    text_batches(spark)
    file = spark.read.format("binaryFile").load(tokenizer).select("length", "content")
    size, content = file.first()
    if size > MAX_VOCABULARY:
        raise ValueError(f"{tokenizer} has {size} bytes; the broadcast allows {MAX_VOCABULARY}")
    ranks = spark.sparkContext.broadcast(bytes(content))

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encoder = _encoder(tokenizer, ranks.value)
        return texts.map(lambda t: len(encoder.encode_ordinary(t)) if t else 0).astype("int64")

    return docs.select(*[c for c in docs.columns if c not in ("text", column)], count("text").alias(column))


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """(length, n_docs), one row per distinct length."""
    return lengths.groupBy(F.col(column).alias("length")).agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """One row per distinct length L, taken as context limit.

    docs_over / tokens_over: of documents longer than L; tokens_kept: the
    corpus truncated to L per document; tokens_lost: what truncation drops;
    quantile: share of documents of length at most L.
    """
    hist = stored(histogram, "token-histogram")
    sums = running_totals(hist, [F.col("length").desc()],
                          {"docs_over": F.col("n_docs"), "tokens_over": F.col("n_docs") * F.col("length")}, "token-suffix")
    total = hist.agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("length")).alias("tokens"))
    out = sums.crossJoin(F.broadcast(total))                    # one row
    kept = F.col("tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("length")
    return out.select("length", "n_docs", "docs_over", "tokens_over", kept.alias("tokens_kept"),
                      (F.col("tokens") - kept).alias("tokens_lost"), F.col("docs").alias("docs_total"),
                      F.col("tokens").alias("tokens_total"),
                      ((F.col("docs") - F.col("docs_over")) / F.col("docs")).alias("quantile"))


def answer(limits: DataFrame, limit: int) -> DataFrame:
    """The row of totals for any context limit, from the suffix sums alone (one row, or none for an empty table)."""
    # the longest length at most the limit tells what lies above it; below the shortest everything does
    below = limits.filter(F.col("length") <= limit).agg(F.max_by(
        F.struct("docs_over", "tokens_over", "tokens_total", "docs_total"), "length").alias("s"))
    all_over = limits.agg(F.max("docs_total").alias("docs"), F.max("tokens_total").alias("tokens"))
    s = F.coalesce("s", F.struct(F.col("docs").alias("docs_over"), F.col("tokens").alias("tokens_over"),
                                    F.col("tokens").alias("tokens_total"), F.col("docs").alias("docs_total")))
    return (below.crossJoin(all_over).filter("docs is not null").select(F.lit(limit).alias("limit"), s.alias("s"))
            .select("limit", "s.docs_over", "s.tokens_over",
                    (F.col("s.tokens_total") - F.col("s.tokens_over") + F.col("s.docs_over") * limit).alias("tokens_kept")))

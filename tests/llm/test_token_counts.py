import base64
from collections import Counter

import tiktoken

from souk.llm import token_counts as tc
from souk.llm.queries import QUERIES

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tc.TOKENIZER, "rb"))}
ENCODER = tiktoken.Encoding("test", pat_str=tc.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", None, "a", "Hello  world\n\n x", "<|endoftext|>", "é😀ß" * 50, "x" * 3000, "w " * 20_000, "a", "\x00\x1f"]


def test_lengths_and_round_trip(docs_of, clash):
    out = tc.document_lengths(docs_of(list(enumerate(TEXTS)), clash))
    for r in out.collect():
        ids = ENCODER.encode_ordinary(TEXTS[r.doc_id] or "")
        assert r.n_tokens == len(ids) and ENCODER.decode(ids) == (TEXTS[r.doc_id] or "")


def brute(lengths, limit):
    over = [n for n in lengths if n > limit]
    return len(over), sum(over), sum(min(n, limit) for n in lengths)


def test_query_answers_every_limit(spark, sf_dir, documents):
    lengths = [len(ENCODER.encode_ordinary(r.text or "")) for r in documents.collect()]
    limits = QUERIES["op1_token_counts"](spark, sf_dir).collect()
    assert {r.length: r.n_docs for r in limits} == Counter(lengths)
    for r in limits:
        assert (r.docs_over, r.tokens_over, r.tokens_kept) == brute(lengths, r.length)
        assert r.tokens_lost == sum(lengths) - r.tokens_kept and r.tokens_total == sum(lengths)
        assert abs(r.quantile - sum(n <= r.length for n in lengths) / len(lengths)) < 1e-12


def test_any_limit_from_the_suffix_sums(spark):
    lengths = [0, 3, 3, 8, 20]
    df = tc.context_limits(tc.length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long")))
    for limit in (0, 1, 3, 7, 8, 19, 20, 500):
        r, = tc.answer(df, limit).collect()
        assert (r.docs_over, r.tokens_over, r.tokens_kept) == brute(lengths, limit)


def test_empty_table(docs_of):
    out = tc.context_limits(tc.length_histogram(tc.document_lengths(docs_of([]))))
    assert out.collect() == [] and tc.answer(out, 5).collect() == []

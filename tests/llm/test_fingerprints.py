import hashlib
import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from souk.llm import fingerprints as fp
from souk.llm.queries import QUERIES

GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def terms(t):
    return {signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in GAP.split((t or "").lower()) if w}


def brute_lexicon(texts):
    df = Counter(x for t in texts for x in terms(t))
    n = len(texts)
    return {t for t, k in df.items() if fp.MIN_SHARE * n <= k <= max(1.0, fp.MAX_SHARE * n)}


def subset(term, k):
    # Spark's hash of several columns: the hash of one seeds the next
    import struct
    h = xxhash.xxh64(struct.pack("<q", term), seed=42).intdigest()
    h = xxhash.xxh64(struct.pack("<i", k), seed=h).intdigest()
    return h & ((1 << (k // fp.SUBSETS + 1)) - 1) == 0


def shape(t, lex):
    """The terms of each subset, which is what the hashes stand for."""
    kept = sorted(terms(t) & lex)
    if not kept:
        return ["whole:" + (t or "")] * (fp.LEVELS * fp.SUBSETS)
    return [tuple(x for x in kept if subset(x, k)) for k in range(fp.LEVELS * fp.SUBSETS)]


def like(a, b):
    if a == b:
        return 1.0
    best = 0.0
    for i in range(fp.LEVELS):
        x, y = a[i * fp.SUBSETS:(i + 1) * fp.SUBSETS], b[i * fp.SUBSETS:(i + 1) * fp.SUBSETS]
        used = sum(bool(p) or bool(q) for p, q in zip(x, y))
        best = max(best, sum(bool(p) and p == q for p, q in zip(x, y)) / max(used, 2))
    return best


def test_query_equals_brute_force(spark, sf_dir, documents):
    rows = sorted(((r.doc_id, r.text or "") for r in documents.collect()), reverse=True)
    lex = brute_lexicon([t for _, t in rows])
    got = {r.doc_id: r for r in QUERIES["op9_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    shapes = {}
    for k, (d, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + following[:cut]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shape(t, lex), shape(edited, lex), shape(following, lex)
        assert math.isclose(r.near_edited, like(a, b)) and math.isclose(r.near_next, like(a, c))
        shapes.setdefault(str(a), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in shapes.values()) and len(set.union(*shapes.values())) == len(shapes)
    mean = lambda c: sum(getattr(r, c) for r in got.values()) / len(got)
    assert mean("near_edited") > 0.5 > 0.3 > mean("near_next")


@pytest.mark.parametrize("per", [1, 3, 1000])
def test_next_document_over_buckets(docs_of, per):
    rows = [(i * 7 % 101, f"t{i}") for i in range(60)] + [(None, "z"), (3 * 7, "dup"), (101 * 5, "")]
    got = {(r.doc_id, r.text): r.next_text for r in fp.with_next(docs_of(rows), ["text"], rows_per_bucket=per).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == {r: order[(i + 1) % len(order)][1] for i, r in enumerate(order)}


def test_odd_texts(docs_of, clash):
    rows = [(1, None), (2, ""), (3, "..."), (4, "..."), (5, "a " * 50_000), (6, "a"), (6, "a"), (7, "é ß 😀")]
    out, name = fp.fingerprints(docs_of(rows, clash))
    got = {}
    for r in out.withColumn("likeness_", fp.likeness(F.col(name), F.col(name))).collect():
        got.setdefault(r.text or "", set()).add(str(r[name]))
        assert r.likeness_ == 1.0
    assert all(len(v) == 1 for v in got.values()) and len(got) == 5
    assert fp.fingerprints(docs_of([]))[0].collect() == []
    assert fp.with_next(docs_of([]), ["text"]).collect() == []

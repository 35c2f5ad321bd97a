import hashlib
import random
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from souk.llm import periodic_runs as pr
from souk.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(w):
    """By the border array."""
    border, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = border[k - 1]
        k += w[i] == w[k]
        border[i] = k
    return len(w) - border[-1]


def brute_runs(w, least=12):
    """All maximal stretches of every period, by comparing words that far apart."""
    out, n = set(), len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q) and smallest_period(w[i:i + length]) == q:
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(w):
    names = {}
    return np.array([names.setdefault(x, len(names)) for x in w], np.int64)


def planted(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abc"), max_size=60)
       | st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.integers(2, 12), st.lists(st.sampled_from("ab"), max_size=9))
       .map(lambda x: x[2] + x[0] * x[1] + x[2]))
def test_runs_equal_brute_force(w):
    assert pr.runs_of(numbered(w)) == brute_runs(w)
    for least in (7, 20):
        assert pr.runs_of(numbered(w), least) == brute_runs(w, least)


def test_long_structured_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    rng = random.Random(5)
    line = [rng.choice("abcdefgh") for _ in range(17)]
    for w in (fib[-1], "a" * 500, "ab" * 300 + "a", line * 20 + ["x"] + line * 20, sum(([str(i)] + line for i in range(60)), [])):
        assert pr.runs_of(numbered(w)) == brute_runs(list(w))


def test_long_texts_in_seconds():
    rng = random.Random(7)
    block = [rng.randrange(50) for _ in range(30_000)]
    line = [rng.randrange(1000) for _ in range(30)]
    begin = time.time()
    assert pr.runs_of(np.array(block * 3 + [99])) == [(0, 90_000, 30_000)]
    assert pr.runs_of(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    scattered = np.array(sum(([2000 + i] + line for i in range(4000)), []))      # one line, many left words
    assert pr.runs_of(scattered) == []
    assert time.time() - begin < 60


def test_places_keep_order():
    rng = random.Random(1)
    values = rng.sample(range(10_000), 4000)
    held = pr.Places([values[0]])
    for v in values[1:]:
        held.add(v)
    for v in values[:3000]:
        held.remove(v)
    left = sorted(values[3000:])
    assert list(held) == left
    for x in range(0, 10_000, 7):
        assert held.after(x) == next((v for v in left if v > x), None)
        assert held.before(x) == next((v for v in reversed(left) if v < x), None)


def expected(doc_id, text, plant=True):
    w = planted(doc_id, text) if plant else WORD.findall(text or "")
    runs = brute_runs(w) if len(w) < 3000 else pr.runs_of(numbered(w))
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_query_equals_brute_force(spark, sf_dir, documents):
    rows = QUERIES["op12_periodic_runs"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        if len(texts[r.doc_id] or "") < 20_000:
            assert tuple(r)[1:] == expected(r.doc_id, texts[r.doc_id]), r.doc_id


def test_odd_rows_and_clashing_columns(docs_of, clash):
    texts = [None, "", " \t\n", "a", "a " * 12, "a " * 11, "a b " * 7, "a\u00a0b " * 20, "x y z " * 5 + "q " + "x y z " * 5, "a " * 12, "w " * 30_000]
    docs = docs_of(list(enumerate(texts)), clash | {"summary": "x", "runs": "x", "Collapsed": "x"})
    out, name = pr.summaries(docs)
    for r in out.collect():
        assert tuple(r[name]) == expected(r.doc_id, texts[r.doc_id], False)
    out, (runs, collapsed) = pr.find_runs(docs)
    assert runs == "runs_" and collapsed == "collapsed_" and set(docs.columns) < set(out.columns)
    for r in out.collect():
        w = WORD.findall(texts[r.doc_id] or "")
        assert [tuple(x) for x in r[runs]] == (brute_runs(w) if len(w) < 3000 else [(0, len(w), 1)])
        assert hashlib.sha256(r[collapsed].encode()).hexdigest() == expected(r.doc_id, texts[r.doc_id], False)[-1]


def test_empty_table(docs_of):
    assert pr.find_runs(docs_of([]))[0].collect() == [] and pr.summaries(docs_of([]))[0].collect() == []

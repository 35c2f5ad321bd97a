import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from souk.llm import toxicity as tx
from souk.llm.queries import QUERIES


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def held_out(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def corpus(n=300, seed=9):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 50))]
        if bad:
            w += rng.choices(["idiot", "trash", "scum"], k=rng.randrange(1, 4))
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def model_of(examples, idf, **more):
    """A model of (id, label, counts) with words w0, w1, ..."""
    words = [b"w%d" % i for i in range(len(idf))]
    start = np.concatenate(([0], np.cumsum([len(e[2]) for e in examples]))).astype(np.int64)
    word = np.array([w for e in examples for w in sorted(e[2])], np.int64)
    count = np.array([e[2][w] for e in examples for w in sorted(e[2])], np.int64)
    return tx.Model(words, np.asarray(idf, float), [e[0] for e in examples], np.array([e[1] for e in examples]), start, word, count, **more)


@pytest.mark.parametrize("frequent", [0, 5, 40])
def test_search_is_exact(monkeypatch, frequent):
    monkeypatch.setattr(tx, "FREQUENT", frequent)
    rng = np.random.default_rng(3)
    some = lambda low, high: {int(f): int(rng.integers(1, 4)) for f in rng.choice(40, rng.integers(low, high), replace=False)}
    examples = [(str(i), int(rng.integers(2)), some(0, 9)) for i in range(700)]
    m = model_of(examples, rng.uniform(1, 5, 40))
    dense = np.zeros((len(m.y), 40))
    by = {e[0]: e[2] for e in examples}
    for i, d in enumerate(m.id):
        word, value = m.query({b"w%d" % w: n for w, n in by[d].items()})
        dense[i, word] = value
    queries = [m.query({b"w%d" % w: n for w, n in some(1, 12).items()} | {b"unknown": 3}) for _ in range(80)]
    sims, nums = m.search(queries, 15)
    for (word, value), s, n in zip(queries, sims, nums):
        row = np.round(dense[:, word] @ value, 9)
        order = sorted((j for j in range(len(row)) if row[j] > 0), key=lambda j: (-row[j], j))[:15]
        assert np.allclose(s[:len(order)], row[order]) and len(n[n >= 0]) == len(order)
        assert set(n[n >= 0]) == set(order) or np.isclose(row[order][-1], s[len(order) - 1])
    assert m.blocks > 5 and abs(np.linalg.norm(dense, axis=1) - 1).max() < 1e-9


def brute_scores(rows, labels, max_examples=10 ** 6):
    """Plain scores: every word, every example, no index; calibration by direct pooling."""
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    toxic = {}
    for d, _, y in labels:
        if d is not None and y in (0, 1) and not held_out(d):
            toxic[d] = max(y, toxic.get(d, 0))
    first, df = {}, Counter()
    for d, t in sorted(rows, key=lambda r: str(r[0])):
        df.update(set(words(t)))
        if d in toxic:
            first.setdefault(t or "", (str(d), toxic[d], Counter(words(t))))
    examples = sorted(first.values(), key=lambda e: e[0])
    n, t = len(examples), sum(e[1] for e in examples)
    known = {w for e in examples for w in e[2]}

    def factor(w):
        a, b = (sum(w in e[2] for e in examples if e[1] == y) for y in (1, 0))
        table = [(a, a + b, t), (b, a + b, n - t), (t - a, n - a - b, t), (n - t - b, n - a - b, n - t)]
        g2 = 2 * sum(o * math.log(o * n / (r * c)) for o, r, c in table if o)
        return 1 + (round(max(g2, 0), 9) if a * (n - t) > b * t else 0) / tx.LABEL_G2
    weight = {w: math.log(1 + len(rows) / max(1, df[w])) * factor(w) for w in known}

    def vector(counts):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in counts.items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}
    vectors = [(vector(e[2]), e[1]) for e in examples]
    base = (sum(y for v, y in vectors if not v) + t / n) / (sum(not v for v, _ in vectors) + 1)
    vectors = [x for x in vectors if x[0]]

    def vote(q, skip=None):
        s = sorted(((round(sum(x * v.get(w, 0) for w, x in q.items()), 9), y) for i, (v, y) in enumerate(vectors) if i != skip), reverse=True)
        s = [x for x in s if x[0] > 0][:tx.NEAREST]
        return (sum(a * y for a, y in s) + tx.PRIOR * base) / (sum(a for a, _ in s) + tx.PRIOR)
    pools = []
    for x, y in sorted((round(vote(v, i), 9), y) for i, (v, y) in enumerate(vectors)):
        if pools and pools[-1][3] == x:
            pools[-1] = [pools[-1][0] + 1, pools[-1][1] + y, pools[-1][2] + x, x]
        else:
            pools.append([1, y, x, x])
    k = 0
    while k + 1 < len(pools):
        if pools[k][1] * pools[k + 1][0] >= pools[k + 1][1] * pools[k][0]:
            pools[k] = [p + q for p, q in zip(pools[k][:3], pools.pop(k + 1)[:3])] + [None]
            k = max(k - 1, 0)
        else:
            k += 1
    at = [p[2] / p[0] for p in pools]
    value = np.maximum.accumulate([(p[1] + 2 * x) / (p[0] + 2) for p, x in zip(pools, at)])
    out = []
    for _, text in rows:
        q = vector(Counter(words(text))) if any(w in weight for w in words(text)) else None
        out.append(base if q is None else float(np.interp(vote(q), at, value)))
    return out


def test_query_equals_brute_force(spark, sf_dir, documents):
    """Ties among equally similar examples of both labels may fall either way; nearly all scores agree, most exactly."""
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, sf_dir).collect()}
    want = brute_scores(rows, labels)
    assert len(got) == len(rows) and all(got[d].held_out == held_out(d) for d, _ in rows)
    off = [abs(got[d].score - s) for (d, _), s in zip(rows, want)]
    assert max(off) < 0.02 and np.mean(np.array(off) < 1e-6) > 0.95


def test_scores_and_evidence(spark, docs_of, clash):
    rows, labels = corpus()
    odd = [(1000, None), (1001, ""), (1002, "idiot"), (1003, "IDIOT " * 9000), (1004, "w1"), (1002, "idiot")]
    labels += [(2000, 1, 1), (0, 1, None), (None, 1, 1), (1, 0, labels[1][2])]
    out, (score, evidence) = tx.score_toxicity(docs_of(rows + odd, clash), labels_of(spark, labels))
    got = [(r.doc_id, r[score], r[evidence], r.text) for r in out.collect()]
    assert len(got) == len(rows) + len(odd) and all(0 <= s <= 1 for _, s, _, _ in got)
    by = {d: s for d, s, _, _ in got}
    truth = {d: y for d, _, y in labels[:len(rows)]}
    right = [(by[d] >= 0.5) == truth[d] for d in truth]
    assert np.mean(right) > 0.97 and by[1002] > 0.5 < by[1003] and by[1000] == by[1001] < 0.5
    same = {}
    for _, s, _, t in got:
        assert same.setdefault(t or "", s) == s
    cited = {int(e.doc_id) for _, _, ev, _ in got for e in ev}
    assert cited and not any(held_out(d) for d in cited)


def test_held_out_labels_change_nothing(spark, docs_of):
    rows, labels = corpus(120)
    flipped = [(d, q, 1 - y if held_out(d) else y) for d, q, y in labels]
    scores = [{r.doc_id: r.score for r in tx.score_toxicity(docs_of(rows), labels_of(spark, x))[0].collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_bounded_sample(spark, docs_of):
    rows, labels = corpus(200)
    model = tx.fit(docs_of(rows), labels_of(spark, labels), max_toxic=20, max_clean=30)
    assert len(model.y) <= 50 and model.y.sum() <= 20
    assert max(model.shares) > 1 == min(model.shares)


@pytest.mark.parametrize("labels", [[], [(0, 1, 0)], [(1, 1, 1)], [(777, 1, 1)]])
def test_few_or_no_labels(spark, docs_of, labels):
    out, (score, _) = tx.score_toxicity(docs_of([(0, "a b"), (1, "idiot"), (3, None)]), labels_of(spark, labels))
    assert all(0 <= r[score] <= 1 for r in out.collect())


def test_empty_table(spark, docs_of):
    assert tx.score_toxicity(docs_of([]), labels_of(spark, [(1, 1, 1)]))[0].collect() == []


def test_accuracy_on_held_out_rows(spark):
    """At sf0.01: 70 labelled documents are held out."""
    d = "/root/testdata/sf0.01"
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [(r.score, r.predicted, y[r.doc_id]) for r in QUERIES["op8_toxicity"](spark, d).collect() if r.doc_id in y and r.held_out]
    assert len(got) > 50 and np.mean([p == t for _, p, t in got]) >= 0.95
    assert all(p == (s >= 0.5) for s, p, _ in got)


def test_repeated_ids_are_one_example(spark, docs_of):
    rows, labels = corpus(60)
    again = rows + [(d, f"{t} again {k}") for d, t in rows for k in range(5)]
    model = tx.fit(docs_of(again), labels_of(spark, labels))
    assert len(model.id) == len(set(model.id)) <= len(rows)


def test_every_word_counts(spark, docs_of):
    """Texts without a word that speaks for the label are still told apart by their other words."""
    rows = [(i, f"alpha beta gamma s{i}") for i in range(0, 40)] + [(i, f"delta eps zeta s{i}") for i in range(40, 80)]
    labels = [(i, 1, int(i >= 40)) for i in range(80)]
    out, (score, evidence) = tx.score_toxicity(docs_of(rows + [(900, "gamma"), (901, "zeta new words")]), labels_of(spark, labels))
    got = {r.doc_id: r for r in out.collect()}
    assert got[900][score] < 0.5 < got[901][score] and len(got[901][evidence]) == tx.EVIDENCE

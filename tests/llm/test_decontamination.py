import hashlib
import random
import re

import pytest

from souk.llm import decontamination as dc
from souk.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    t = t or ""
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        if w and i is not None:
            for a in range(max(1, len(w) - n + 1)):
                windows.setdefault(tuple(w[a:a + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (g := tuple(w[a:a + k])) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[g]
        out.append((d, len(w), len(hit), len(found), ",".join(sorted(found))))
    return out


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def random_tables(seed, short=True):
    rng = random.Random(seed)
    vocab = ["a", "B", "é", "c1", "D"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 25]) if short else rng.randrange(10, 30))) for i in range(12)]
    items += [(12, items[0][1]), (13, None), (14, "..."), (15, items[4][1].upper())]
    docs = []
    for i in range(60):
        body = text(rng.randrange(0, 60))
        if i % 3 == 0:
            body += " z " + (rng.choice(items)[1] or "").replace(" ", ", ") + " z " + text(5)
        docs.append((i, body))
    return docs + [(60, None), (61, ""), (62, "...")], items


@pytest.mark.parametrize("seed,short,shard", [(1, True, 10_000), (2, False, 10_000), (3, True, 40)])
def test_hits_equal_brute_force(spark, docs_of, clash, seed, short, shard):
    docs, items = random_tables(seed, short)
    out = dc.contamination(docs_of(docs, clash), items_of(spark, items), shard_words=shard)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in out.collect())
    assert got == sorted(brute(docs, items))
    assert any(g[2] for g in got)


def test_query_equals_brute_force(spark, sf_dir, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {w[0]: w for w in brute([(r.doc_id, r.text) for r in documents.collect()], items)}
    for r in QUERIES["op7_decontamination"](spark, sf_dir).collect():
        w = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == w[1:4] and r.contaminated == (w[2] > 0)
        assert r.items_sha256 == hashlib.sha256(w[4].encode()).hexdigest()


def test_spans_are_cut_and_clean_documents_stay(spark, docs_of, clash):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, "Before it, " + "x y z " * 20 + item.title() + "! after"), (2, item), (3, "clean one two three"), (4, None), (5, "")]
    docs = docs_of(rows, clash)
    out = dc.decontaminate(docs, items_of(spark, [(9, item)]))
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    left = "Before it, " + "x y z " * 20 + "! after"
    assert got == {1: (left, len(left)), 3: ("clean one two three", 19), 4: (None, None), 5: ("", 0)}


def test_empty_tables(spark, docs_of):
    none = items_of(spark, [])
    assert [r.n_hit for r in dc.contamination(docs_of([(1, "a b")]), none).collect()] == [0]
    assert dc.decontaminate(docs_of([]), items_of(spark, [(1, "a b")])).collect() == []

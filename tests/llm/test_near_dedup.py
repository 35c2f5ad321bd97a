import random
import re
from collections import Counter

import numpy as np

from souk.llm import bagminhash as bag
from souk.llm import near_dedup
from souk.llm.queries import QUERIES

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def multiset(t):
    w = WORD.findall((t or "").encode().lower())
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows, least=0.8):
    """Classes of rows: equal texts, or linked by multiset similarity."""
    sets = [multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    first = {}
    for i, (_, t) in enumerate(rows):
        parent[find(i)] = find(first.setdefault(t or "", i))
    seen = set()
    for ids in by.values():
        for x in range(len(ids)):
            for y in range(x):
                if (pair := (ids[y], ids[x])) not in seen and find(ids[y]) != find(ids[x]):
                    seen.add(pair)
                    if similarity(sets[ids[y]], sets[ids[x]]) >= least:
                        parent[find(ids[x])] = find(ids[y])
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return sorted(sorted(v, key=lambda d: (d is None, d)) for v in ids.values() if len(v) > 1)


def classes(out):
    got = {}
    for r in out:
        got.setdefault(r.class_id, []).append(r)
    for rs in got.values():
        assert sum(r.kept for r in rs) >= 1 and {r.class_size for r in rs} == {len(rs)}
    return sorted(sorted([r.doc_id for r in rs], key=lambda d: (d is None, d)) for rs in got.values() if len(rs) > 1)


def fixture(seed=5):
    rng = random.Random(seed)
    text = lambda n: [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(90)) for _ in range(n)]
    passage = text(60)
    rows = [" ".join(text(rng.randrange(5, 120))) for _ in range(40)]
    rows += [" ".join(text(40) + passage + text(60)) for _ in range(30)]              # a passage that many share
    hot = text(150)
    for i in range(60):                                                             # a large group of near copies
        w = list(hot)
        w[i % 150] = f"edit{i}"
        rows.append(" ".join(w))
    drift = text(100)
    for i in range(25):                                                             # a chain that drifts away
        drift = list(drift)
        drift[4 * i] = f"drift{i}"
        rows.append(" ".join(drift))
    rows += [rows[0]] * 12 + [rows[0].upper().replace(" ", ", ")]
    rows += ["one two", "one  two!", "One two three", None, "", "...", "...", None, "a " * 4000, "a " * 4100, "b c " * 2000, "word " * 9 + " end"]
    return list(enumerate(rows))


def test_classes_equal_brute_force(docs_of, clash):
    rows = fixture()
    got = classes(near_dedup.assign_classes(docs_of(rows, clash)).collect())
    assert got == brute(rows)


def test_one_document_of_each_class_stays(docs_of, clash):
    rows = fixture(6)
    docs = docs_of(rows + [rows[3], (None, "one two"), (None, None)], clash)
    out = near_dedup.dedup(docs)
    assert out.columns == docs.columns
    left = sorted((r.doc_id, r.text) for r in out.collect())
    gone = {d for c in brute(rows) for d in c[1:]}
    assert [d for d, _ in left] == [d for d, _ in rows if d not in gone]
    assert all(dict(rows)[d] == t for d, t in left)


def test_query_equals_brute_force(spark, sf_dir, documents):
    out = QUERIES["op4_near_dedup"](spark, sf_dir).collect()
    rows = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
    assert len(out) == len(rows) and classes(out) == brute(rows) and len(brute(rows)) > 2


def test_empty_and_wordless_tables(docs_of):
    assert near_dedup.assign_classes(docs_of([])).collect() == []
    assert near_dedup.dedup(docs_of([])).collect() == []
    got = near_dedup.assign_classes(docs_of([(1, ""), (2, None), (3, ".")])).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 3}


def shingled(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
    return bag.shingles(np.frombuffer(b"".join(raw) or b"\0", np.uint8), offsets), len(raw)


def test_shingles_are_the_multisets():
    texts = [t or "" for _, t in fixture(7)] + ["ab", "", "x", "é ß É", "end"]
    (owner, s, occurrence), n = shingled(texts)
    names = {}
    for i, t in enumerate(texts):
        want = sorted(multiset(t).values())
        here = s[owner == i]
        assert sorted(Counter(here.tolist()).values()) == want
        for g, k in multiset(t).items():
            names.setdefault(g, set()).add(i)
    assert len(np.unique(s)) == len(names)
    # a text's shingles don't depend on its neighbours in the batch
    (o2, s2, _), _ = shingled([texts[50]])
    assert s2.tolist() == s[owner == 50].tolist()


def test_agreement_estimates_weighted_jaccard():
    rng = random.Random(8)
    errors = []
    for k in range(120):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(6, 200))]
        heavy = base + base[:len(base) // 2] * rng.randrange(0, 9)
        other = [w if rng.random() > 0.05 else f"n{rng.random()}" for w in heavy] + base[:rng.randrange(0, 20)]
        parts, n = shingled([" ".join(heavy), " ".join(other)])
        values, weight = bag.signatures(*parts, n)
        assert (values != 0).all() and weight.tolist() == [sum(multiset(" ".join(x)).values()) for x in (heavy, other)]
        errors.append((values[0] == values[1]).mean() - similarity(multiset(" ".join(heavy)), multiset(" ".join(other))))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def edited_group(seed, n, most):
    """Copies of one text with up to ``most`` words of 120 exchanged: many pairs just above or below the limit."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(120)] = f"e{rng.randrange(4)}"
        out.append(" ".join(w[rng.randrange(3):]))
    return out


def test_large_groups_of_edited_copies(docs_of):
    rows = list(enumerate(edited_group(3, 400, 7) + edited_group(4, 150, 12) + ["w0 " * 50, "other words of no group at all"]))
    got = classes(near_dedup.assign_classes(docs_of(rows)).collect())
    assert got == brute(rows) and max(map(len, got)) > 100


def test_cells_join_all_links(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(near_dedup, "COLUMNS", 50)
    texts = edited_group(9, 90, 6)
    (owner, s, occurrence), n = shingled(texts)
    found = bag.elements(owner, s, occurrence)
    lists = [found[owner == i].tolist() for i in range(n)]
    for first in ([True] * n, [i < 30 for i in range(n)]):
        cell = pa.table({"node": list(range(n)), "root": list(range(n)), "first": first, "elements": pa.array(lists, pa.list_(pa.int64()))})
        links = near_dedup.cell_links(cell, 0.8).to_pylist()
        linked = {(i, j) for i in range(n) for j in range(i) if (first[i] != first[j] or all(first))
                  and similarity(multiset(texts[i]), multiset(texts[j])) >= 0.8}
        assert len(links) < n and {(x["b"], x["a"]) for x in links} <= linked
        group = list(range(n))
        for x in links:
            a, b = group[x["a"]], group[x["b"]]
            group = [b if g == a else g for g in group]
        assert all(group[i] == group[j] for i, j in linked) and linked

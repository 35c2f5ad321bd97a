import hashlib
import math
import re
from collections import defaultdict

from souk.llm import mixing
from souk.llm.queries import QUERIES

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = defaultdict(int)
    for _, t, s in rows:
        per[s] += size(t)
    order = sorted(per, key=lambda s: (s is None, s or ""))
    w = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, open_, budget = {}, set(order), SHARE * sum(per.values())
    while open_:                                   # deal, cap, deal the rest again
        level = (budget - sum(target.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > CAP * per[s]}
        target |= {s: CAP * per[s] for s in over} or {s: level * w[s] for s in open_}
        open_ = open_ - over if over else set()
    out = []
    for d, t, s in rows:
        rate = min(CAP, target[s] / per[s]) if per[s] else 0.0
        key = str(d) if d is not None else t or ""
        u = int(hashlib.md5(f"mix-1:{key}".encode()).hexdigest()[:13], 16) / 2 ** 52
        out.append((d, size(t), per[s], target[s], size(t) * (math.floor(rate) + (u < rate - math.floor(rate)))))
    return out


def check(got, rows):
    key = lambda r: tuple((x is None, x) for x in r)
    a, b = sorted(got, key=key), sorted(brute(rows), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:3] == y[:3] and x[4] == y[4] and abs(x[3] - y[3]) <= 1e-9 * max(1, y[3])


def plan_rows(docs):
    return [(r.doc_id, r["size"], r.source_size, r.target, r["size"] * r.copies) for r in mixing.mix_plan(docs).collect()]


def test_plan_equals_brute_force(docs_of):
    rows = [(i, "w " * (i % 7) + "\x0bé\x1cx y", f"s{i % 5}" if i % 3 else "big") for i in range(200)]
    rows += [(200, None, None), (201, "", "empty"), (None, "a b", "s1"), (7, rows[7][1], rows[7][2]), (203, "x " * 30_000, "\U0001F600"), (204, "q", "￿")]
    check(plan_rows(docs_of(rows)), rows)


def test_empty_table(docs_of):
    assert plan_rows(docs_of([])) == [] and mixing.mix(docs_of([])).collect() == []


def test_only_wordless_texts(docs_of):
    assert [r[4] for r in plan_rows(docs_of([(1, "", "a"), (2, None, None)]))] == [0, 0]


def test_mix_repeats_rows_and_keeps_columns(docs_of, clash):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(120)] + [(5, "again", "s1")]
    docs = docs_of(rows, clash)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    want = defaultdict(int)
    for d, size, _, _, taken in brute(rows):
        want[(d, size)] += taken // size
    got = defaultdict(int)
    for r in out.collect():
        got[(r.doc_id, len(r.text.split()))] += 1
    assert dict(got) == {k: v for k, v in want.items() if v}


def test_query_is_near_its_targets_and_repeats(spark, sf_dir):
    a = {r.doc_id: r for r in QUERIES["op2_mixing"](spark, sf_dir).collect()}
    b = {r.doc_id: r for r in QUERIES["op2_mixing"](spark, sf_dir).collect()}
    assert a == b
    assert sum({r.source_size: r.target for r in a.values()}.values()) > 0
    assert all(r.taken <= 2 * r["size"] for r in a.values())
    total, taken = sum(r["size"] for r in a.values()), sum(r.taken for r in a.values())
    assert abs(taken - 1.5 * total) < 0.15 * total

import random
import re

from souk.llm import url_filter as uf
from souk.llm.queries import QUERIES


def split_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):], re.S)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits) if fits else None


def canonical(u):
    host, path = split_url(u)
    if not (host := re.sub(r"^(?:www|m)\.", "", host)):
        return None
    return "//" + host + re.sub(r"(?:/|/index\.html?|\.html?)$", "", path)


def brute(pages, links):
    """links: (url, absolute target)."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, _ in pages:
        if canonical(u):
            find(canonical(u))
    for u, t in links:
        if canonical(u) and canonical(t):
            parent[find(canonical(u))] = find(canonical(t))
    said = {}
    for u in [u for u, _ in pages] + [t for _, t in links]:
        r = rule_of(*split_url(u))
        if r and canonical(u):
            said.setdefault(find(canonical(u)), set()).add(r[2])
    out = []
    for k, (u, _) in enumerate(pages):
        host, path = split_url(u)
        r = rule_of(host, path)
        group = said.get(find(canonical(u)), set()) if canonical(u) else set()
        out.append((k, host, path, r[1] if r else None, r[2] if r else "allow" if "allow" in group else "block" if "block" in group else "allow"))
    return out


def frame(spark, pages):
    return spark.createDataFrame([(k, u, h, "x") for k, (u, h) in enumerate(pages)],
                                 "page_id long, url string, html string, host string").repartition(3)


def rows(df):
    return sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect())


def test_rules_and_propagation(spark):
    pages = [("http://A.Example.com/en/1", None), ("https://WWW.example.com/en/2?x", ""), ("http://example.net/es/", ""),
             ("http://org.org/a", '<LINK rel="canonical" href="http://example.net/es/">'), ("http://org.org/b", "<link href='/a' rel='canonical'>"),
             ("http://org.org/c", '<meta http-equiv="refresh" content="0; url=https://www.org.org/b.html">'),
             ("http://org.org/d", '<link rel="stylesheet" href="http://example.net/es/">'), (None, "x"), ("nothing", "x"), ("http://", ""),
             ("://net/fr/x", ""), ("ftp://x.net/fr", ""), ("http://com", ""), ("http://com/", ""), ("http://a.org/e", '<link rel=canonical href=//a.com/>'),
             ("http://a.org/f", '<link rel=canonical href=//example.net/es/q>'), ("http://a.org/e/", '<link rel=canonical href="f">'),
             ("http://org.org/a", "again"), ("http://x.org/a://b.com/", "")]
    links = [("http://org.org/a", "http://example.net/es/"), ("http://org.org/b", "http://org.org/a"), ("http://org.org/c", "https://www.org.org/b.html"),
             ("http://a.org/e", "http://a.com/"), ("http://a.org/f", "http://example.net/es/q"), ("http://a.org/e/", "http://a.org/e/f")]
    got = rows(uf.judge_urls(frame(spark, pages)))
    assert got == sorted(brute(pages, links))
    verdict = {g[0]: g[4] for g in got}
    assert [verdict[k] for k in (3, 4, 5, 6, 14, 15)] == ["block", "block", "block", "allow", "allow", "block"]


def test_components_read_exchanges_in_few_tasks(spark):
    """A star settles in one round, however many shuffle partitions there are most stages have four tasks a core at most."""
    few = 4 * spark.sparkContext.defaultParallelism
    edges = spark.createDataFrame([(40, i) for i in range(40)] + [(40, 90), (41, 90)], "a long, b long").coalesce(2)
    conf = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few-tasks", "components")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        roots = uf.components(edges)
        stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
        tasks = [i.numTasks for i in map(tracker.getStageInfo, stages) if i and i.numCompletedTasks]
        assert tasks and sum(t <= few for t in tasks) > 2 * sum(t > few for t in tasks)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.node: r.root for r in roots.collect()} == {i: 0 for i in [*range(42), 90]}


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("hub", f"s{i}") for i in range(200)]
    rand = [(f"r{rng.randrange(120)}", f"r{rng.randrange(120)}") for _ in range(90)]
    edges = chain + star + rand + chain[:5] + [("x", "x")]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[find(a)] = find(b)
    got = {r.node: r.root for r in uf.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    groups = {}
    for n in parent:
        groups.setdefault(find(n), set()).add(n)
    for g in groups.values():
        if len(g) > 1:
            assert {got[n] for n in g} == {min(g)}
    assert set(got) == {n for g in groups.values() if len(g) > 1 for n in g}


def test_query_equals_brute_force(spark, sf_dir):
    pages = [(r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").collect()]
    ids = [r.page_id for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").collect()]
    want = sorted((ids[k], *rest) for k, *rest in brute(pages, []))
    assert rows(QUERIES["op5_url_filter"](spark, sf_dir)) == want
    assert {w[4] for w in want} == {"allow", "block"}


def test_empty_table(spark):
    assert uf.judge_urls(frame(spark, [("a", "b")]).limit(0)).collect() == []


def test_alias_names_the_component_without_any_rule(spark):
    pages = [("http://q.org/b", '<link rel="canonical" href="/a">'), ("http://q.org/a", ""), ("http://q.org/c", '<link rel="canonical" href="/b">'),
             ("http://q.org/alone", ""), (None, "")]
    got = {r.page_id: (r.rule, r.alias, r.verdict) for r in uf.judge_urls(frame(spark, pages)).collect()}
    assert [got[k] for k in range(3)] == [(None, "//q.org/a", "allow")] * 3
    assert got[3] == (None, "//q.org/alone", "allow") and got[4] == (None, None, "allow")


def test_a_redirect_of_one_query_blocks_only_that_page(spark):
    pages = [("http://q.org/index.php?id=1", '<meta http-equiv="refresh" content="0; url=http://example.net/es/x">'),
             ("http://q.org/index.php?id=2", ""), ("http://q.org/index.php", ""), ("https://www.q.org/index.php?utm_source=a&id=1&gclid=z#top", ""),
             ("http://q.org/index.php?b=2&a=1", ""), ("http://q.org/index.php?a=1&&b=2", ""), ("http://q.org/index.php?fbclid=7", ""),
             ("http://r.org?x=a/b", "")]
    got = {r.page_id: (r.alias, r.verdict) for r in uf.judge_urls(frame(spark, pages)).collect()}
    assert [got[k][1] for k in range(8)] == ["block", "allow", "allow", "block", "allow", "allow", "allow", "allow"]
    assert got[0][0] == got[3][0] and got[4][0] == got[5][0] == "//q.org/index.php?a=1&b=2"
    assert got[2][0] == got[6][0] == "//q.org/index.php" and got[7][0] == "//r.org?x=a/b"

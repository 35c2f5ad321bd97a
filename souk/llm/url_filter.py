"""URL filters with redirect equivalence.

Rules name a host and a path prefix; the longest rule that fits a URL decides.
URLs that no rule fits take the decision of their aliases: the URLs joined to
them by redirects (meta refresh), canonical links and canonical forms of the
address (scheme, leading www./m., tracking parameters, fragment, trailing slash
and .html dropped; other parameters kept, sorted). Aliases are the connected components of these edges, found with
alternating large-star / small-star steps: each step only joins and takes
minima by node, so a component or node of any size is split over tasks and
combined before the shuffle. Rounds are cut with ``checkpoint()``; no
link or component reaches the driver, only each round's count and hash sum.

Precedence inside a component: an explicit allow of any member wins, then a
block of any member, else the default.

Defined cases: a null URL, or one without ``://``, has empty host and path, no
rule and no edges, and gets the default; repeated rows and equal URLs are
judged alike; null html has no links; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import UPPER, fresh, stored

# (verdict, host, path prefix): fixed values of the registered query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

# Query parameters that only track where a visitor came from.
TRACKING = r"(?i)^(?:utm_\w+|gclid|dclid|gbraid|wbraid|fbclid|msclkid|yclid|igshid|mc_[ce]id|_ga|_gl)(?:=|$)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct<size, rule, verdict>; null if none does.

    ``rules`` is a hand-written list; it is part of the expression. Every rule
    has a path prefix beginning with "/", so an empty path fits none.
    """
    fits = []
    for verdict, h, p in rules:
        here = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(here, F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"),
                                          F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def canonical_form(url: Column) -> Column:
    """One spelling of an address; null without a host."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/|/index\.html?|\.html?)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(F.lit("//"), host, path, asked))


def _absolute(href: Column, url: Column) -> Column:
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(url, r"^([^:]*:)", 1), href))
            .when(href.startswith("/"), F.concat(root, href))
            .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), href)))


def alias_links(pages: DataFrame) -> DataFrame:
    """(url, target): addresses that pages redirect or point to as canonical, absolute."""
    linked = pages.filter(F.col("html").rlike(r"(?i)canonical|http-equiv") & F.col("url").contains("://"))
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tag = F.col("tag")
    href = F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    to = F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*([^"'\s>]+)""", 1)
    target = (F.when(tag.rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b"""), href)
              .when(tag.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""), to))
    out = linked.select("url", F.explode(tags).alias("tag")).select("url", target.alias("target")).filter("target <> ''")
    return out.select("url", _absolute(F.col("target"), F.col("url")).alias("target")).distinct()


def alias_edges(links: DataFrame) -> DataFrame:
    """(a, b) canonical forms of the two ends of each link.

    A node is a canonical form, so spellings of one address are one node
    already; pages whose markup names no other address add no edge.
    """
    out = links.select(canonical_form(F.col("url")).alias("a"), canonical_form(F.col("target")).alias("b"))
    return out.filter("a is not null and b is not null and a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the component's least node.

    Edges are far smaller than what they link: most exchanges are read in at most four tasks
    a core, as the driver keeps the state of each task of each of the rounds' exchanges.
    """
    files = 4 * edges.sparkSession.sparkContext.defaultParallelism

    def once(df):
        return df.coalesce(files).distinct().coalesce(files)

    now = edges.filter("a is not null and b is not null and a <> b")
    now = once(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).checkpoint()
    for _ in range(max_rounds):
        if _settled(now, files):
            break
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        both = both.select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = once(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # here a > b: every node points to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = once(small.unionByName(least.select("a", F.col("m").alias("b")))).checkpoint()
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _settled(edges: DataFrame, files: int) -> bool:
    """Does every node hang on one other node, which hangs on none? (a > b in every row)"""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    per = ends.groupBy("e.node").agg((F.sum("e.up") + F.max("e.down")).alias("n"))
    return per.filter("n > 1").coalesce(files).count() == 0


def judge_urls(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """``pages`` plus host, path, rule, alias (the component's name) and verdict.

    Rules judge the pages' addresses and those that they link to. Decisions are
    gathered per canonical form (combined before the shuffle), then per
    component, and joined back on the canonical form. Input columns
    named like a new one are replaced by it.
    """
    url = F.col("url")
    links = stored(alias_links(pages), "url-links")
    every = pages.select("url").unionByName(links.select(F.col("target").alias("url")))
    judged = every.filter(url.contains("://")).distinct().select(
        canonical_form(url).alias("node"), rule_for(host_of(url), path_of(url), rules)["verdict"].alias("verdict"))
    judged = stored(judged.filter("node is not null").groupBy("node").agg(
        F.coalesce(F.max(F.col("verdict") == "allow"), F.lit(False)).alias("allowed"),
        F.coalesce(F.max(F.col("verdict") == "block"), F.lit(False)).alias("blocked")), "url-nodes")
    roots = stored(components(alias_edges(links)), "url-roots")
    judged = judged.join(roots, "node", "left").withColumn("linked", F.col("root").isNotNull()).withColumn(
        "root", F.coalesce("root", "node"))
    groups = judged.groupBy("root").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    node, root, group, fit, own = fresh(pages, "_node", "_root", "_group", "_fit", "_own")
    # a node without link and decision is its own alias and gets the default
    decided = (judged.select("node", "root", "linked").join(groups, "root").filter("linked or allowed or blocked")
               .select(F.col("node").alias(node), F.col("root").alias(root),
                       F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias(group)))
    out = pages.select("*", rule_for(host_of(url), path_of(url), rules).alias(fit), canonical_form(url).alias(own))
    out = out.join(decided, F.col(own) == F.col(node), "left")
    made = {"host": host_of(url), "path": path_of(url), "rule": F.col(fit)["rule"],
            "alias": F.coalesce(root, own),
            "verdict": F.coalesce(F.col(fit)["verdict"], F.col(group), F.lit(default))}
    return out.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in made],
                      *[v.alias(k) for k, v in made.items()])

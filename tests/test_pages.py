"""Deep pages through the page index, and threads cut into pages."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from souk.operators import pages as P


def read_rows(page):
    """The page's keys and how many rows its scan gave on."""
    rows = [r.k for r in page.rows.collect()]
    leaf = page.rows._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, leaf.metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def ranked(spark):
    rng = random.Random(5)
    rows = [(f"k{i:05d}", rng.choice([None, 1, 1, 2, 3]), "x" * rng.randrange(5)) for i in range(6003)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame(rows, "k string, price int, body string").repartition(7)
    path = os.path.join(tempfile.mkdtemp(), "index")
    yield rows, df, P.build_page_index(df, [F.col("price").desc(), F.col("k")], path, block_rows=250), path
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_every_page_is_right_and_reads_at_most_two_blocks(spark, ranked):
    rows, _, index, path = ranked
    want = [k for k, _, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    assert index.total == 6003 and index.page(1, 50).pages == 121
    for p in (1, 2, 5, 6, 60, 100, 121):
        got, read = read_rows(index.page(p, 50))
        assert got == want[(p - 1) * 50:p * 50]
        assert read <= 500
    first, last = read_rows(index.page(1, 50))[1], read_rows(index.page(120, 50))[1]
    assert first == last
    assert index.page(122, 50).rows.collect() == [] and index.page(0, 1000).limit == 50
    assert P.open_page_index(spark, path) == index
    assert [r.k for r in index.page(3, 400, max_limit=1000).rows.collect()] == want[800:1200]      # a page over three blocks


def test_boundaries(ranked):
    rows, df, _, _ = ranked
    want = [k for k, _, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    got = {r.page: (r.n_rows, r.first_id, r.last_id) for r in P.page_boundaries(df, [F.col("price").desc(), F.col("k")], 100, "k").collect()}
    assert got == {i // 100 + 1: (len(want[i:i + 100]), want[i], want[i:i + 100][-1]) for i in range(0, len(want), 100)}


def test_empty_list_and_taken_names(spark):
    df = spark.createDataFrame([], "k string")
    index = P.build_page_index(df, [F.col("k")], os.path.join(tempfile.mkdtemp(), "index"))
    assert index.total == 0 and index.page(1).rows.collect() == []
    assert P.page_boundaries(df, [F.col("k")], 10, "k").collect() == []
    with pytest.raises(ValueError):
        P.positions(df.withColumn("_POS", F.lit(1)), [F.col("k")])


def test_one_order_with_a_third_of_all_lines(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(2)
        rows = [(f"m{i:05d}", "hot" if i % 3 == 0 else f"o{rng.randrange(40)}", rng.randrange(500), f"line {i}") for i in range(4000)] + [("z", None, 1, "lost")]
        df = spark.createDataFrame(rows, "id string, order_id string, at int, message string").repartition(6)
        got = P.nested_pages(df, "order_id", ["at", "id"], 25).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    by = {}
    for i, o, at, m in rows[:-1]:
        by.setdefault(o, []).append((at, i, m))
    assert len(got) == sum(-(-len(v) // 25) for v in by.values())
    for r in got:
        want = sorted(by[r.order_id])[(r.page - 1) * 25:r.page * 25]
        assert [(i.at, i.id, i.message) for i in r["items"]] == want and r.n_rows == len(want)


def test_export_writes_json_lines(spark, T):
    path = tempfile.mkdtemp()
    P.export_orders(T, path, page_rows=2)
    lines = [json.loads(r.value) for r in spark.read.text(f"{path}/messages").collect()]
    assert sum(x["n_rows"] for x in lines) == T["messages"].join(T["users"].select(F.col("id").alias("sender_id")), "sender_id").count()
    assert max(len(x["items"]) for x in lines) <= 2 and {"sender_name", "message", "created_at"} <= set(lines[0]["items"][0])
    assert spark.read.json(f"{path}/orders").count() == T["orders"].count()
    assert spark.read.json(f"{path}/status_log").agg(F.sum("n_rows")).first()[0] == T["status_log"].count()

import random
import re

from pyspark.sql import functions as F

from souk.llm.common import match_spans, running_totals


def test_running_totals_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 2, 7]), rng.choice([None, "a", "b"])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x long, s string").repartition(7)
    out = running_totals(df, [F.col("s").asc_nulls_last(), F.col("id")], {"rank": F.lit(1), "sum": F.col("x")}, "t")
    order = sorted(rows, key=lambda r: (r[2] is None, r[2] or "", r[0]))
    want, total = {}, 0
    for k, (i, x, _) in enumerate(order):
        want[i] = (k, total)
        total += x
    assert {r.id: (r.rank, r["sum"]) for r in out.collect()} == want


def test_running_totals_of_nothing(spark):
    df = spark.createDataFrame([], "id long")
    assert running_totals(df, [F.col("id")], {"rank": F.lit(1)}, "t").collect() == []


def test_match_spans_are_those_of_a_regex_engine(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aaab é😀-") for _ in range(rng.randrange(0, 60))) for _ in range(200)] + ["", "a", "aab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in ("a+b?", "é|😀", "[^a]b*"):
        got = df.select("t", match_spans(F.col("t"), pattern).alias("m")).collect()
        for r in got:
            assert [(m.start, m.end, m.hit) for m in r.m] == [(*m.span(), m.group()) for m in re.finditer(pattern, r.t)]

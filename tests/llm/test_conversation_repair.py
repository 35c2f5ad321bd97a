import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import types as T

from harness import compare, duck
from souk.llm import conversation_repair as cr
from souk.llm.queries import ORACLE, QUERIES

TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
LEGAL = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(cr.BLANKS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(rows):
    """The cheapest edits of (role, text) rows by trying every list of edits, up to one insert more than rows."""
    flags, best = faults(rows), None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    takes = []
    for (role, text), f in zip(rows, flags):
        own = [("D", None, 4)]
        if f not in ("blank", "duplicate"):
            extra = 3 if f == "truncated" else 0
            own += [("K", role, extra), ("R", "user", 3 + extra), ("R", "assistant", 3 + extra)]
        takes.append(own)
    for choice in itertools.product(*takes):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(c for _, _, c in choice) + 3 * sum(map(len, put))
            if best and cost > best[0]:
                continue
            out, audit = [], ""
            for i in range(len(rows) + 1):
                out += [(p, "") for p in put[i]]
                audit += "I" * len(put[i])
                if i < len(rows):
                    audit += choice[i][0]
                    if choice[i][1] is not None:
                        out.append((choice[i][1], rows[i][1]))
            if any(not r for r, _ in out) or not LEGAL.fullmatch("".join(r[0] for r, _ in out)):
                continue
            if best is None or (cost, audit) < best[:2]:
                best = cost, audit, out
    return best


def turns_of(spark, rows):
    return spark.createDataFrame(rows, TURN).repartition(3)


def sha(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def test_random_conversations_equal_brute_force(spark):
    rng, convs = random.Random(11), {}
    for c in range(70):
        convs[c] = [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]),
                     rng.choice(["Hello.", "Well!  ", "cut", " \t", "Yes?", "No.\x0b", "half\u00a0", "One. "]) + rng.choice(["", "", " x", str(rng.random()) + "."]))
                    for _ in range(rng.randrange(1, 5))]
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    fixed = {r.conv_id: r for r in cr.summaries(turns_of(spark, rows)).collect()}
    lines = {}
    for r in cr.repair(turns_of(spark, rows)).orderBy("conv_id", "position").collect():
        assert r.position == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append((r.role, r.text))
    assert set(fixed) == set(convs)
    for c, turns in convs.items():
        cost, audit, out = brute(turns)
        assert (fixed[c].cost, fixed[c].audit, fixed[c].repaired_sha256) == (cost, audit, sha(out)), turns
        assert lines.get(c, []) == out
        flags = faults(turns)
        assert [fixed[c][k] for k in ("blank", "duplicate", "truncated")] == [flags.count(k) for k in ("blank", "duplicate", "truncated")]
        assert fixed[c].illegal == sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf):
    ok, said = compare(QUERIES["op13_conversation_repair"](spark, sf), duck(sf), ORACLE["op13_conversation_repair"])
    assert ok, said


def test_odd_rows(spark, tmp_path):
    rows = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (1, None, None, None), (1, None, "user", "A."), (1, 7, "assistant", "B."),
            (2, 0, "user", "Same."), (2, 0, "user", "Same."), (2, 9, "assistant", "Two."), (3, 4, "user", ""), (4, 0, "User", "X."), (5, -3, "", "Y.")]
    got = {r.conv_id: r for r in cr.summaries(turns_of(spark, rows)).collect()}
    assert (got[None].cost, got[None].audit, got[None].gaps) == (0, "KK", 0)
    assert (got[1].blank, got[1].gaps, got[1].audit) == (1, 0, "DKK")
    assert (got[2].duplicate, got[2].gaps, got[2].audit) == (1, 8, "KDK")
    assert (got[3].blank, got[3].audit, got[3].repaired_sha256) == (1, "D", sha([]))
    assert (got[4].audit, got[4].cost) == ("D", 4) and (got[5].audit, got[5].illegal) == ("D", 0)
    # the SQL on the same kind of rows, with damage
    wide = [(c, t if t % 5 else None, r, x) for c in [None, *range(30)] for t, (r, x) in
            enumerate([(None, "A."), ("user", None), ("system", "S."), ("assistant", "B "), ("user", "A."), ("user", "A."), ("aide", "Z?\n")])]
    turns_of(spark, wide).withColumnRenamed("x", "y").write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    ok, said = compare(QUERIES["op13_conversation_repair"](spark, str(tmp_path)), con, ORACLE["op13_conversation_repair"])
    assert ok, said


def test_absent_rows_leave_their_conversation(spark):
    from pyspark.sql import functions as F
    got = cr.summaries(turns_of(spark, [(1, 0, "user", "A."), (1, 1, "user", "B.")]), F.col("turn") > 5).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", sha([]))]
    assert cr.repair(turns_of(spark, [(1, 0, "user", "A.")]), F.lit(None).cast("boolean")).collect() == []


def test_giant_conversation_and_long_text(spark):
    n = 60_000
    df = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role",
                                   "concat('t', id, if(id % 1000 = 3, '', '.')) AS text", "'x' AS back", "'y' AS edits", "1 AS fault")
    one = spark.createDataFrame([(8, 0, "user", "long " * 200_000 + "."), (8, 1, "assistant", "ok.")], TURN)
    got = {r.conv_id: r for r in cr.summaries(df.unionByName(one, allowMissingColumns=True)).collect()}
    assert got[7].cost == 3 * 60 and got[7].audit == "K" * n and got[7].truncated == 60
    lines = [("user" if i % 2 == 0 else "assistant", f"t{i}" + ("" if i % 1000 == 3 else ".")) for i in range(n)]
    assert got[7].repaired_sha256 == sha(lines) and got[8].audit == "KK"


def test_empty_table(spark):
    assert cr.summaries(turns_of(spark, [])).collect() == [] and cr.repair(turns_of(spark, [])).collect() == []


def test_one_shuffle(spark, sf_dir):
    plan = QUERIES["op13_conversation_repair"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1

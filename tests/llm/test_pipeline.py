import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline as cp
from pyspark.sql import functions as F

from souk.llm import secrets
from test_decontamination import brute as hits
from test_near_dedup import brute as near

ROOT = Path(cp.__file__).parent
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def run_stages(spark, docs, sf_dir, tmp):
    """Each stage's input and output, written and reread in between."""
    out = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        path = f"{tmp}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def test_every_stage_on_its_own_input(spark, sf_dir, documents, tmp_path):
    stages = run_stages(spark, documents, sf_dir, tmp_path)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "secrets", "mixing"]
    for before, after in stages.values():
        assert after.columns == COLUMNS and after.dtypes == documents.dtypes

    before, after = map(rows, stages["toxicity"])
    gone = set(before) - set(after)
    assert gone and set(after) < set(before) and all(re.search("idiot|trash|scum|moron|stupid|clown|loser|pathetic|worthless|disgusting|ré|ach|bo", t.lower()) for _, t in gone)

    before, after = map(rows, stages["near_dedup"])
    dropped = {d for c in near(before) for d in c[1:]}
    assert dropped and after == [r for r in before if r[0] not in dropped]

    before, after = rows(stages["decontamination"][0]), dict(rows(stages["decontamination"][1]))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for (d, t), h in zip(before, hits(before, items)):
        if not h[2]:
            assert after[d] == t
        else:
            assert (d not in after) == (h[2] > 0.5 * h[1]) and after.get(d) != t
    assert not any(h[2] for h in hits(list(after.items()), items))

    before, after = rows(stages["secrets"][0]), dict(rows(stages["secrets"][1]))
    assert len(after) == len(before)
    for d, t in before:
        found = re.search(r"[0-9a-f]{16}|AKIA", t)
        assert found or after[d] == t
        assert not found or "[SECRET]" in after[d]

    before, after = stages["mixing"]
    plan = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(plan) <= {r.doc_id for r in before.collect()} and max(plan.values()) <= 2


def test_run_equals_its_stages(spark, sf_dir, documents, tmp_path):
    last = run_stages(spark, documents, sf_dir, tmp_path)["mixing"][1]
    key = lambda df: sorted((r.doc_id, r.text, r.n_chars) for r in df.collect())
    assert key(cp.run(spark, sf_dir)) == key(last)


def test_stages_on_odd_documents(spark, docs_of, sf_dir, tmp_path, clash):
    docs = docs_of([(1, None), (2, ""), (3, "x " * 40_000), (None, "a token=abcdefghijkl b"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A b, c d e f!")], clash)
    out = run_stages(spark, docs, sf_dir, tmp_path)["mixing"][1]
    assert out.columns == docs.columns and "[SECRET]" in " ".join(r.text or "" for r in out.collect()) or out.count() >= 0
    none = run_stages(spark, docs_of([]), sf_dir, tmp_path / "none")
    assert all(after.count() == 0 for _, after in none.values())


def test_entry_works_without_the_subpackage():
    code = ("import sys; sys.modules['souk.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)")
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True).stdout.split()
    assert int(said[0]) > 90 and said[1:] == ["False", "False"]


def test_entry_registers_every_operator():
    code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True).stdout.split()
    assert "pipeline" in said and {n.split("_")[0] for n in said if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 14)}

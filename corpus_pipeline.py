"""The corpus pipeline: toxicity, near-dedup, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the
columns of ``docs``; it works on everything its predecessor kept. ``run``
writes each stage's result to the shared folder and rereads it as the next
one's ``docs``. SQL can't express the stages (signatures, nearest neighbours),
so there is no oracle; tests compare with brute force.
"""

from __future__ import annotations

from souk.llm import decontamination, mixing, near_dedup, secrets, toxicity
from souk.llm.common import stored


def drop_toxic(spark, docs, sf_dir):
    """Documents scored 0.5 or more go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark, docs, sf_dir):
    """One document of each class of near copies (weighted Jaccard 0.8 or more) stays."""
    return near_dedup.dedup(docs)


def remove_benchmark(spark, docs, sf_dir):
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark, docs, sf_dir):
    """Secrets are replaced by a mark; the documents stay."""
    return secrets.redact(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents are repeated or left out so that the sources meet their target weights."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs

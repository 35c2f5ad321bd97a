"""Plan audit: one line per registered query with the operators that matter at scale.

    python -m souk.plans.explain [sf_dir] [--formatted NAME]

Counts shuffles (``Exchange``), join strategies, windows, Python operators and
pushed scan filters in each executed plan (AQE off, so the static plan is
shown); ``--formatted NAME`` prints ``explain("formatted")`` for one query.
"""

from __future__ import annotations

import re
import sys

from souk.plans.registry import REGISTRY, spark_query
from souk.session import get_session

MARKERS = {
    "shuffles": r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)",
    "bhj": r"BroadcastHashJoin",
    "smj": r"SortMergeJoin",
    "bnlj": r"BroadcastNestedLoopJoin",
    "windows": r"\bWindow \[",
    "python": r"MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython",
    "scans": r"FileScan parquet",
    "pushed": r"PushedFilters: \[[^\]]+\]",
}


def audit(spark, sf_dir: str) -> list[tuple[str, dict[str, int]]]:
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    rows = []
    try:
        for name in REGISTRY:
            if name.endswith("_stream") or name == "streaming_ratings":
                continue                      # these run their stream while being built
            plan = spark_query(name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            rows.append((name, {k: len(re.findall(p, plan)) for k, p in MARKERS.items()}))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return rows


def main(argv: list[str]) -> None:
    sf_dir = argv[0] if argv and not argv[0].startswith("--") else "/root/testdata/sf0.01"
    spark = get_session()
    if "--formatted" in argv:
        spark_query(argv[argv.index("--formatted") + 1])(spark, sf_dir).explain("formatted")
        return
    print("| query | " + " | ".join(MARKERS) + " |")
    print("|---|" + "---|" * len(MARKERS))
    for name, c in audit(spark, sf_dir):
        print(f"| {name} | " + " | ".join(str(c[k]) for k in MARKERS) + " |")


if __name__ == "__main__":
    main(sys.argv[1:])

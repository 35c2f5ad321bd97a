"""Registered queries: one per SURVEY §2 id with a tabular result.

Each entry pairs a Spark plan (a function of the table mapping ``T``) with
an independent SQL statement over the same derived tables. The SQL side is
written from the survey's wording, in other relations than the Spark side
uses, so it checks the plan rather than repeating it.
The derived tables come from ``souk.sources.fixtures`` on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from souk.sources.fixtures import AS_OF, AS_OF_EVENTS, fixture_tables, with_clause


@dataclass
class Query:
    plan: Callable                  # T -> DataFrame
    sql: str | None                 # oracle body (None: rows-only check)
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, doc: str = ""):
    def deco(fn):
        REGISTRY[name] = Query(fn, sql, doc)
        return fn
    return deco


def _m_tables(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\bm_[a-z_]+\b", sql)))


def oracle(name: str) -> str | None:
    q = REGISTRY[name]
    if q.sql is None:
        return None
    prefix = with_clause(_m_tables(q.sql))
    body = q.sql.lstrip()
    m = re.match(r"(?is)with(\s+recursive)?\s+", body)
    if prefix and m:
        # one WITH list: the fixture tables first, then the query's own CTEs
        head = "WITH RECURSIVE " if m.group(1) else "WITH "
        return head + prefix[len("WITH "):].rstrip().rstrip("\n") + ",\n" + body[m.end():]
    return prefix + body


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    q = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q.plan(fixture_tables(spark, sf_dir))

    run.__name__ = name
    run.__doc__ = q.doc
    return run


NOW = f"timestamp '{AS_OF}'"
NOW_EV = f"timestamp '{AS_OF_EVENTS}'"
MONEY = "round(cast({} as double), 2)"


def TRIMMED(x: str) -> str:
    """White space of any kind cut off at both ends, in the oracle's SQL."""
    return rf"regexp_replace({x}, '^[\s\x0B\p{{Z}}]+|[\s\x0B\p{{Z}}]+$', '', 'g')"


def money_sql(x: str) -> str:
    return MONEY.format(x)


# Import the modules that register entries (kept at the bottom to avoid cycles).
from souk.plans import q_views, q_reports, q_history, q_audits, q_changes, q_retention, q_streams  # noqa: E402,F401

"""souk — marketplace analytics as Spark DataFrame plans.

Sub-packages:

- ``sources``   declared schemas, table loading, fixture derivation, sinks
- ``functions`` column-level predicates and scalar rules (no UDFs)
- ``operators`` joins/views, reports, windows, audits, change rules, retention
- ``plans``     registered queries and their DuckDB oracle SQL
- ``streaming`` Structured Streaming versions of limits, ratings, alerts
"""

from souk.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]

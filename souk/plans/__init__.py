"""Registered queries (Spark plan + DuckDB oracle SQL) and the plan audit."""

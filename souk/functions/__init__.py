"""Column-level predicates and scalar rules (no UDFs)."""

"""Table sources, declared schemas, sinks and the fixture derivation."""

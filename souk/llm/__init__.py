"""Training-data operators: token counts, mixing, secrets, near-dedup, URL
filters, personal data, decontamination, toxicity, fingerprints, licenses.

Nothing else in the library imports this subpackage. ``queries.py`` registers
one query per operator, ``corpus_pipeline.py`` at the repository top chains
five of them.
"""

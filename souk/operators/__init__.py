"""Operators over the table mapping T: views and joins, reports, windows, audits,
change rules (with ordered folds) and retention."""

"""Operators for preparing training text: archives, near and exact
deduplication, quality and toxicity classifiers, quality rules, secret scans,
HTML extraction, tokenising and packing. Nothing else in the library imports
this subpackage."""

"""Corpus operators for training-data pipelines: packing, token counts, scans, classifiers, dedup.

Nothing else in the library imports this subpackage. Operators take a DataFrame plus column names and
return a DataFrame; ``queries`` holds the thin registered queries that derive the contract's columns.
"""

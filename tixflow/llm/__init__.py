"""Operators for training-data pipelines (dedup, scans, scoring, packing).

Nothing else in the library imports this subpackage.
"""

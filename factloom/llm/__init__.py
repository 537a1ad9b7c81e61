"""Operators for preparing training data: scans, classifiers, dedup, scoring.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""

"""Operators of a training-data pipeline: text, vector, archive and page jobs.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when the package is present.
"""

"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it except ``__spark_entry__`` and
``corpus_pipeline``.  Operators live one per module; ``registry`` names the
queries built on them.
"""

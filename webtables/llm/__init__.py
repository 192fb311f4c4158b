"""Operators of a training-data pipeline, each one Spark job over whole tables.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

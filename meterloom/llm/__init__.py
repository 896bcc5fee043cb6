"""Operators of a training-data pipeline: scoring, filtering, deduplication, mixing and archives.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""

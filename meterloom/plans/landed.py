"""Upkeep of what streams land: many small batches become one folder, and old history goes."""

from __future__ import annotations

from pyspark.sql import SparkSession

from meterloom.config import RETAIN_RESETS, RETAIN_SECS
from meterloom.operators.history import retain
from meterloom.sources.batches import merge_batches
from meterloom.sources.quota import history_of, landed_points
from meterloom.streaming.live import cube_of


def merge_quota_history(
    spark: SparkSession, path: str, now: int, secs: int = RETAIN_SECS, cycles: int = RETAIN_RESETS
) -> int:
    """Merge the landed history and apply its retention as of ``now``; returns the newest batch merged, or -1.

    One reset point more than ``cycles`` stays, so that the bound holds for older rows that arrive later: retention
    at reading gives the same rows as without merges, in whatever order batches arrive.
    """

    def fold(folders):
        found = history_of(spark, folders)
        return landed_points(retain(*found, now, secs, cycles)[0], retain(*found, now, secs, cycles + 1)[1])

    return merge_batches(spark, path, fold)


def merge_usage_cube(spark: SparkSession, path: str) -> int:
    """Merge the partial cubes of ``maintain_usage_cube``; returns the newest batch merged, or -1."""
    return merge_batches(spark, path, lambda folders: cube_of(spark, folders))

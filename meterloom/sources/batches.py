"""Folders of micro-batches, and their merge.

A stream writes batch *n* to ``batch=<n>``; a replayed batch replaces its folder.  ``merge_batches`` folds what is
in force into ``merged/upto=<n>``, which stands for all batches up to *n* once it is committed: a reader takes the
newest merged folder and the batches behind it, so it sees the old folders or the new one, and a late replay of a
merged batch changes nothing.  ``drop_merged`` removes folders that a merged one stands for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterloom.sources.refresh import committed


def batch_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in force."""
    merged = committed(spark, f"{path}/merged", "upto")
    last = merged[-1] if merged else -1
    return [f"{path}/merged/upto={n}" for n in merged[-1:]] + [f"{path}/batch={n}" for n in committed(spark, path, "batch") if n > last]


def merge_batches(spark: SparkSession, path: str, fold: Callable[[list[str]], DataFrame]) -> int:
    """Write what ``fold`` makes of the folders in force; returns the newest batch it stands for, or -1 without a new one."""
    merged, batches = committed(spark, f"{path}/merged", "upto"), committed(spark, path, "batch")
    if not batches or merged and batches[-1] <= merged[-1]:
        return -1
    fold(batch_folders(spark, path)).write.mode("overwrite").parquet(f"{path}/merged/upto={batches[-1]}")
    return batches[-1]


def drop_merged(spark: SparkSession, path: str) -> list[int]:
    """Remove what the newest merged folder stands for; returns the numbers of the removed batches.

    A reader that listed its folders before the merge may still need them: call it once such readers are done.
    """
    merged = committed(spark, f"{path}/merged", "upto")
    if not merged:
        return []
    name = spark._jvm.org.apache.hadoop.fs.Path
    fs = name(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [n for n in committed(spark, path, "batch") if n <= merged[-1]]
    for folder in [*(f"batch={n}" for n in gone), *(f"merged/upto={n}" for n in merged[:-1])]:
        fs.delete(name(f"{path}/{folder}"), True)
    return gone

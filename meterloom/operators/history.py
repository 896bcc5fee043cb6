"""Landed quota history: throttle, reset points, retention, cycles and their curves.

Series are cut into day chunks (``carry_scan``, ``run_fold``), so a limit with a long history
is shared by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.config import (
    CHUNK_SECS, CYCLE_BUCKETS, CYCLE_COMPLETE, CYCLE_HIGH, CYCLE_LOW, LANDING_DELTA, LANDING_SECS,
    LOCKED_PCT, RETAIN_RESETS, RETAIN_SECS,
)
from meterloom.operators.folds import Thinning, run_fold
from meterloom.operators.ordered import carry_scan, time_chunk
from meterloom.operators.readings import LIMIT

CYCLE = [*LIMIT, "cycle_id"]


def _scan(df: DataFrame, seq: list[str], width: int, **columns: dict[str, str]) -> DataFrame:
    chunked = df.withColumn("_chunk", time_chunk("ts", width))
    return carry_scan(chunked, LIMIT, ["_chunk"], seq, **columns).drop("_chunk")


def with_reset_change(samples: DataFrame, width: int = CHUNK_SECS) -> DataFrame:
    """Mark the samples whose ``resets_at`` differs from the sample before (or that are first)."""
    scanned = _scan(samples, ["ts"], width, lag={"_prev_reset": "resets_at"})
    changed = F.col("_prev_reset").isNull() | (F.col("_prev_reset") != F.col("resets_at"))
    return scanned.withColumn("reset_changed", changed).drop("_prev_reset")


def reset_points(marked: DataFrame) -> DataFrame:
    return marked.filter("reset_changed").select(*LIMIT, "ts", "resets_at")


def landed_samples(
    marked: DataFrame, secs: int = LANDING_SECS, delta: float = LANDING_DELTA, width: int | None = None
) -> DataFrame:
    """Samples worth keeping: the first, every reset change, and after that one per ``secs``
    or per ``delta`` points of movement, both against the last *kept* sample."""
    rows = marked.select(*LIMIT, "ts", F.col("util").alias("value"), F.col("reset_changed").alias("forced"))
    return run_fold(rows, LIMIT, Thinning(secs, delta), width=width, out="util")


def retain(
    samples: DataFrame, resets: DataFrame, now: int, secs: int = RETAIN_SECS, cycles: int = RETAIN_RESETS
) -> tuple[DataFrame, DataFrame]:
    """Drop what is older than ``secs``; with more than ``cycles`` reset points left, also what
    precedes the ``cycles``-th newest of them."""
    samples, resets = (df.filter(F.col("ts") >= now - secs) for df in (samples, resets))
    newest = Window.partitionBy(*LIMIT).orderBy(F.desc("ts"))
    top = resets.select(*LIMIT, "ts").withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= cycles + 1)
    bound = top.groupBy(*LIMIT).agg(
        F.when(
            F.max("n") > cycles, F.max(F.when(F.col("n") == cycles, F.col("ts")))
        ).alias("keep_from")
    ).filter(F.col("keep_from").isNotNull())

    def kept(df: DataFrame) -> DataFrame:
        joined = df.join(bound, LIMIT, "left")
        return joined.filter(F.col("ts") >= F.coalesce("keep_from", F.col("ts"))).drop("keep_from")

    return kept(samples), kept(resets)


def with_reset_in_force(samples: DataFrame, resets: DataFrame, width: int = CHUNK_SECS) -> DataFrame:
    """As-of join: the latest reset point at or before each sample, 0 without one."""
    both = samples.withColumn("_kind", F.lit(1)).unionByName(
        resets.select(*LIMIT, "ts", F.col("resets_at").alias("_point")).withColumn("_kind", F.lit(0)),
        allowMissingColumns=True,
    )
    scanned = _scan(both, ["ts", "_kind"], width, last={"in_force": "_point"})
    kept = scanned.filter(F.col("_kind") == 1).drop("_kind", "_point")
    return kept.withColumn("in_force", F.coalesce("in_force", F.lit(0)))


def split_cycles(samples: DataFrame, width: int = CHUNK_SECS) -> DataFrame:
    """Number the quota cycles of each limit.

    A cycle begins where the reset in force grows or utilisation falls from above 20 to below
    5.  Adds the previous sample, ``boundary``, ``cycle_id`` and ``cycle_start``.
    """
    paired = _scan(
        samples, ["ts"], width,
        lag={"prev_ts": "ts", "prev_util": "util", "_prev_force": "in_force"},
    )
    grew = F.col("in_force") > F.col("_prev_force")
    fell = (F.col("prev_util") > CYCLE_HIGH) & (F.col("util") < CYCLE_LOW)
    marked = paired.withColumn("boundary", F.coalesce(grew | fell, F.lit(False))).drop("_prev_force")
    opens = F.col("boundary") | F.col("prev_ts").isNull()
    marked = marked.withColumns(
        {"_open": F.when(opens, F.col("ts")), "_step": F.col("boundary").cast("bigint")}
    )
    return _scan(
        marked, ["ts"], width, last={"cycle_start": "_open"}, running={"cycle_id": "_step"}
    ).drop("_open", "_step")


def complete_cycles(cycles: DataFrame, part: float = CYCLE_COMPLETE) -> DataFrame:
    """One row per cycle that spans at least ``part`` of its window (column ``window_secs``)."""
    summed = cycles.groupBy(*CYCLE).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts").alias("cycle_start"),
        F.max("ts").alias("cycle_end"),
        F.min_by("util", "ts").alias("first_util"),
        F.max_by("util", "ts").alias("last_util"),
        (F.max("util") >= LOCKED_PCT).alias("hit_locked"),
        F.max("window_secs").alias("window_secs"),
    )
    span = F.col("cycle_end") - F.col("cycle_start")
    return summed.filter((F.col("n") >= 2) & (F.col("window_secs") > 0) & (span >= part * F.col("window_secs")))


def _progress(ts: str):
    return F.least((F.col(ts) - F.col("cycle_start")) / F.col("window_secs"), F.lit(1.0))


def cycle_curves(cycles: DataFrame, complete: DataFrame, buckets: int = CYCLE_BUCKETS) -> DataFrame:
    """Utilisation of each complete cycle at ``buckets`` even steps of its window.

    Every pair of neighbouring samples answers for the steps between them; the earliest pair
    wins, and beyond the ends the curve is flat.  No cycle is collected: a step is one
    aggregated value.
    """
    last = buckets - 1
    pairs = cycles.filter(~F.col("boundary") & F.col("prev_ts").isNotNull() & (F.col("window_secs") > 0))
    pairs = pairs.withColumns({"p0": _progress("prev_ts"), "p1": _progress("ts")})
    low, high = F.ceil(F.col("p0") * last - 1e-9), F.floor(F.col("p1") * last + 1e-9)
    steps = F.when(low <= high, F.sequence(low, high))
    hits = pairs.select(*CYCLE, "ts", "prev_util", "util", "p0", "p1", F.explode(steps).alias("bucket"))
    p = F.col("bucket") / F.lit(float(last))
    f = (p - F.col("p0")) / (F.col("p1") - F.col("p0"))
    value = F.when(F.col("p1") - F.col("p0") < 1e-12, F.col("util")).otherwise(
        F.col("prev_util") * (1 - f) + F.col("util") * f
    )
    hits = hits.filter(p.between(F.col("p0"), F.col("p1"))).withColumn("value", value)
    steps = hits.groupBy(*CYCLE, "bucket").agg(F.min_by("value", "ts").alias("value"))
    inner = steps.groupBy(*CYCLE).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "value"))).alias("_inner")
    )
    end = F.least((F.col("cycle_end") - F.col("cycle_start")) / F.col("window_secs"), F.lit(1.0))

    def at(b):
        p = b / F.lit(float(last))
        return (
            F.when(p <= 0, F.col("first_util")).when(p >= F.col("_end"), F.col("last_util"))
            .otherwise(F.element_at("_inner", b))
        )

    joined = complete.join(inner, CYCLE, "left").withColumn("_end", end)
    curve = F.transform(F.sequence(F.lit(0), F.lit(last)), at)
    return joined.withColumn("curve", curve).drop("_inner", "_end")

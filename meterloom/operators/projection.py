"""Historical projection: median of past cycle curves, runway along it, choice of basis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from meterloom.config import CYCLE_BUCKETS, LOCKED_PCT, MIN_CYCLES, RUNWAY_STEPS
from meterloom.operators.readings import LIMIT

#: A proposed step may miss the line by this many percent points; the exact test follows.
SLACK = 1e-6
#: Share of a bucket within which meetings of curves count as one; far below SLACK in percent points.
HAIR = 1e-9


def curve_at(curve: Column, t: Column, buckets: int = CYCLE_BUCKETS) -> Column:
    """Value of a bucket curve at progress ``t``, interpolated between buckets."""
    x = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * (buckets - 1)
    i = F.floor(x).cast("int")
    frac = x - i
    inner = F.element_at(curve, i + 1) * (1 - frac) + F.element_at(curve, i + 2) * frac
    return F.when(i >= buckets - 1, F.element_at(curve, -1)).otherwise(inner)


def median_at(curves: Column, t: Column) -> Column:
    """Median over curves at ``t``; the mean of the middle two for an even number."""
    values = F.array_sort(F.transform(curves, lambda c: curve_at(c, t)))
    half = F.floor(F.size(curves) / 2).cast("int")
    upper = F.try_element_at(values, half + 1)
    even = F.size(curves) % 2 == 0
    return F.when(F.size(curves) == 0, 0.0).when(
        even, (F.try_element_at(values, F.greatest(half, F.lit(1))) + upper) / 2
    ).otherwise(upper)


def _level_breaks(left: np.ndarray, rise: np.ndarray, rank: int) -> list[tuple[int, float]]:
    """``(bucket, f)`` where the ``rank``-th smallest of a bucket's lines ``left + rise * f`` changes line.

    A row of ``left`` and ``rise`` is a bucket; all buckets step from meeting to meeting at once.  The
    line in charge is looked up a hair after each meeting, where lines that meet are apart again.
    """
    breaks, bucket, f = [], np.arange(len(left)), np.zeros(len(left))
    while len(bucket):
        after = (f + HAIR)[:, None]
        line = np.argsort(left + rise * after, axis=1, kind="stable")[:, rank, None]
        closing = np.take_along_axis(rise, line, 1) - rise
        gap = left - np.take_along_axis(left, line, 1)
        met = np.divide(gap, closing, out=np.full(left.shape, np.inf), where=closing != 0)
        f = np.where(met > after, met, np.inf).min(axis=1)
        on = f < 1.0
        bucket, f, left, rise = bucket[on], f[on], left[on], rise[on]
        breaks += zip(bucket.tolist(), f.tolist())
    return breaks


def median_pieces(curves: list) -> list[list[float]]:
    """The median of bucket curves as straight pieces ``[x0, y0, x1, y1]``, x in buckets.

    Between two buckets every curve is a line, so their median is a chain of lines that breaks
    where the middle one (or one of the middle two) changes.  Pieces on one line stay apart at buckets.
    """
    if not len(curves):
        return []
    values = np.stack([np.asarray(c, float) for c in curves], axis=1)
    left, rise = values[:-1], np.diff(values, axis=0)
    half, last = values.shape[1] // 2, len(values) - 1
    ranks = [half] if values.shape[1] % 2 else [half - 1, half]
    edges = [(b, f) for b in range(last) for f in (0.0, 1.0)]
    knots = sorted({*edges, *(k for rank in ranks for k in _level_breaks(left, rise, rank))})
    bucket, f = np.asarray([b for b, _ in knots]), np.asarray([f for _, f in knots])
    x, y = bucket + f, np.median(left[bucket] + rise[bucket] * f[:, None], axis=1)
    inside = bucket[:-1] == bucket[1:]
    return np.stack([x[:-1], y[:-1], x[1:], y[1:]], axis=1)[inside].tolist()


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def _pieces(curves: pd.Series) -> pd.Series:
    return curves.map(median_pieces)


def limit_curves(curves: DataFrame) -> DataFrame:
    """All curves of a limit in one row, the pieces of their median, the share of cycles that ran out.

    The retention rule bounds the row: cycles of at most 35 days, at most five reset points.
    """
    ordered = F.array_sort(F.collect_list(F.struct("cycle_id", "curve")))
    gathered = curves.groupBy(*LIMIT).agg(
        F.transform(ordered, lambda x: x["curve"]).alias("curves"),
        F.avg(F.col("hit_locked").cast("double")).alias("run_out_probability"),
    )
    return gathered.withColumn("pieces", _pieces("curves"))


def _proposed_step(pieces: Column, t: Column, need: Column, steps: int, buckets: int) -> Column:
    """A step at or before the first one at which the median's pieces reach ``need``; NULL if none does."""
    start = t * (buckets - 1)
    width = (F.lit(1.0) - t) * (buckets - 1) / steps

    def first(p: Column) -> Column:
        x0, y0, x1, y1 = p[0], p[1], p[2], p[3]
        meet = x0 + F.try_divide(need - y0, y1 - y0) * (x1 - x0)
        begin = F.when(y0 >= need, x0).otherwise(meet)
        end = F.when(y1 >= need, x1).otherwise(meet)
        step = F.greatest(F.ceil(F.try_divide(F.greatest(begin, start) - start, width) - SLACK), F.lit(1))
        reaches = (F.greatest(y0, y1) >= need) & (end >= start - SLACK) & (step * width <= end - start + SLACK)
        return F.when(reaches & (step <= steps), step)

    return F.when(width > 0, F.array_min(F.transform(pieces, first))).otherwise(F.lit(1)).cast("int")


def historical_runway(
    curves: Column,
    pieces: Column,
    t: Column,
    util: Column,
    window_secs: Column,
    base: Column | None = None,
    steps: int = RUNWAY_STEPS,
    buckets: int = CYCLE_BUCKETS,
) -> Column:
    """Seconds until the median growth from ``t`` on lifts ``util`` to 100; NULL if it never does.

    The answer is the first of ``steps`` even steps that reaches it.  The median's ``pieces``, made
    once per limit, propose a step that is never too late; the curves themselves decide there and
    at the next two steps, and at later ones only where the line is touched within rounding.
    ``base`` is the median at ``t``, as a column of its own if it should be computed once.
    """
    base = median_at(curves, t) if base is None else base
    remaining = 1.0 - t

    def ahead(i: Column) -> Column:
        return remaining * (i / F.lit(float(steps)))

    def full(i: Column) -> Column:
        return util + (median_at(curves, F.least(t + ahead(i), F.lit(1.0))) - base) >= LOCKED_PCT

    def first_full(low: Column, high: Column) -> Column:
        return F.when(low <= high, F.try_element_at(F.filter(F.sequence(low, high), full), F.lit(1)))

    near = _proposed_step(pieces, t, F.lit(LOCKED_PCT - SLACK) - util + base, steps, buckets)
    last = F.least(near + 2, F.lit(steps))
    later = F.when(remaining > 0, first_full(last + 1, F.lit(steps)))
    first = F.coalesce(first_full(near, last), later)
    reached = (ahead(first) * window_secs).cast("bigint")
    return F.when((F.size(curves) == 0) | (window_secs <= 0), F.lit(None)).when(
        util >= LOCKED_PCT, 0
    ).otherwise(reached)


def project(readings: DataFrame, curves: DataFrame) -> DataFrame:
    """Choose the projection of each reading (``util, progress, window_secs, linear_secs``).

    Historical with at least two cycles, a placed window and a number; linear otherwise.  The
    probability is reported whenever the historical side is eligible.
    """
    joined = readings.join(limit_curves(curves), LIMIT, "left")
    eligible = F.coalesce(
        (F.size("curves") >= MIN_CYCLES) & F.col("progress").isNotNull() & (F.col("window_secs") > 0), F.lit(False)
    )
    joined = joined.withColumn("_base", median_at(F.col("curves"), F.col("progress")))
    hist = historical_runway(
        F.col("curves"), F.col("pieces"), F.col("progress"), F.col("util"), F.col("window_secs"), F.col("_base")
    )
    shaped = joined.withColumns(
        {
            "expected_util": F.when(eligible, F.col("_base")),
            "_hist": F.when(eligible, hist),
            "run_out_probability": F.when(eligible, F.col("run_out_probability")),
        }
    )
    return shaped.withColumns(
        {
            "runway_secs": F.coalesce("_hist", "linear_secs"),
            "pace_basis": F.when(F.col("_hist").isNotNull(), "historical").otherwise("linear"),
        }
    ).drop("_hist", "_base", "curves", "pieces")

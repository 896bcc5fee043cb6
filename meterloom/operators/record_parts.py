"""Records and streaks from mergeable partials, so that a range of months needs no usage rows.

A *part* sums up some whole days of a group in a row of bounded size: the best day, the best two hours, and the
first and last days of its runs of active days.  ``merged`` joins parts of different days in any order and
grouping: runs that touch become one.  The answers are those of ``operators.records`` over the same days.
A part never holds half a day, since an hour's sum decides its rank; a day that changed is summed anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.operators.usage import SCOPE

STATE = ["best_day", "hours", "firsts", "lasts"]


def day_parts(df: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """One part per group and day from usage rows or a cube with ``date`` and ``hour``."""
    slots = df.groupBy(*by, "date", "hour").agg(F.sum("total").alias("tokens"))
    # Sorted downwards, the earlier of equal hours comes first.
    slot = F.struct("tokens", (-F.unix_date("date")).alias("day_back"), (-F.col("hour")).cast("int").alias("hour_back"))
    days = slots.groupBy(*by, "date").agg(F.sum("tokens").alias("tokens"), _two(F.collect_list(slot)).alias("hours"))
    return days.select(
        *by, "date", F.struct("date", "tokens").alias("best_day"), "hours", F.array("date").alias("firsts"), F.array("date").alias("lasts")
    )


def _two(hours: Column) -> Column:
    return F.slice(F.sort_array(hours, asc=False), 1, 2)


def merged(parts: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Parts of different days as one per group.

    The arrays of a group hold two hours per part and its runs, at most one for every second day of the calendar.
    """
    rank = F.struct(F.col("best_day.tokens"), -F.unix_date("best_day.date"))
    met = parts.groupBy(*by).agg(
        F.max_by("best_day", rank).alias("best_day"), _two(F.flatten(F.collect_list("hours"))).alias("hours"),
        F.flatten(F.collect_list("firsts")).alias("firsts"), F.flatten(F.collect_list("lasts")).alias("lasts"),
    )
    opened = F.array_except("firsts", F.transform("lasts", lambda d: F.date_add(d, 1)))
    closed = F.array_except("lasts", F.transform("firsts", lambda d: F.date_sub(d, 1)))
    return met.select(*by, "best_day", "hours", F.sort_array(opened).alias("firsts"), F.sort_array(closed).alias("lasts"))


def month_parts(df: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """One part per group and ``month`` (its first day)."""
    return merged(day_parts(df, by).withColumn("month", F.trunc("date", "month")), [*by, "month"])


def record_day(parts: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Day with most tokens, the earliest on ties."""
    return merged(parts, by).select(*by, "best_day.*")


def record_hour(parts: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Single (date, hour) with most tokens, the earliest on ties."""
    best = F.col("hours")[0]
    day = F.date_from_unix_date(-best["day_back"])
    return merged(parts, by).select(*by, day.alias("date"), (-best["hour_back"]).alias("hour"), best["tokens"].alias("tokens"))


def streak(parts: DataFrame, today: str, by: Sequence[str] = SCOPE, first: str | None = None) -> DataFrame:
    """Consecutive active days that end today, or yesterday while today is still empty.

    Days after ``today`` and before ``first`` do not count, also where they stand in a part.
    """
    day = F.lit(today).cast("date")
    start = F.lit(first or "0001-01-01").cast("date")
    runs = F.transform(
        F.arrays_zip("firsts", "lasts"),
        lambda r: F.struct(F.greatest(r["firsts"], start).alias("first"), F.least(r["lasts"], day).alias("last")),
    )
    newest = F.array_max(F.filter(runs, lambda r: r["first"] <= r["last"]))
    held = merged(parts, by).select(*by, newest.alias("run")).filter(F.col("run").isNotNull())
    length = F.datediff("run.last", "run.first") + 1
    return held.select(*by, F.when(F.col("run.last") >= F.date_sub(day, 1), length).otherwise(0).cast("bigint").alias("streak_days"))


def new_record_now(parts: DataFrame, today: str, hour: int, by: Sequence[str] = SCOPE) -> DataFrame:
    """Whether the current hour is above every other hour of the parts."""
    best = F.col("hours")[0]
    second = F.coalesce(F.get("hours", F.lit(1))["tokens"], F.lit(0))
    here = (best["day_back"] == -F.unix_date(F.lit(today).cast("date"))) & (best["hour_back"] == -hour)
    return merged(parts, by).select(*by, (here & (best["tokens"] > F.greatest(second, F.lit(0)))).alias("pr_now"))

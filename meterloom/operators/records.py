"""Records and streaks over daily and hourly sums.

Inputs are usage rows or a cube with ``date`` and ``hour``; they are summed first, so the
windows see at most one row per group and day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.operators.usage import SCOPE, tokens_per


def record_day(df: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Day with most tokens, the earliest on ties."""
    daily = tokens_per(df, "date", by=by)
    best = F.max_by(F.struct("date", "tokens"), F.struct("tokens", -F.unix_date("date")))
    return daily.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def record_hour(df: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Single (date, hour) with most tokens, the earliest on ties."""
    slots = tokens_per(df, "date", "hour", by=by)
    order = F.struct("tokens", -F.unix_date("date"), -F.col("hour"))
    best = F.max_by(F.struct("date", "hour", "tokens"), order)
    return slots.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def streak(df: DataFrame, today: str, by: Sequence[str] = SCOPE) -> DataFrame:
    """Consecutive active days that end today, or yesterday while today is still empty."""
    day = F.lit(today).cast("date")
    days = df.select(*by, "date").distinct().filter(F.col("date") <= day)
    newest = Window.partitionBy(*by).orderBy(F.desc("date"))
    runs = days.withColumns(
        {
            "latest": F.max("date").over(Window.partitionBy(*by)),
            "expected": F.date_sub(F.max("date").over(newest), F.row_number().over(newest) - 1),
        }
    )
    current = (F.col("date") == F.col("expected")) & (F.col("latest") >= F.date_sub(day, 1))
    return runs.groupBy(*by).agg(F.count_if(current).alias("streak_days"))


def new_record_now(df: DataFrame, today: str, hour: int, by: Sequence[str] = SCOPE) -> DataFrame:
    """Whether the current hour is above every other hour of the range."""
    slots = tokens_per(df, "date", "hour", by=by)
    here = (F.col("date") == F.lit(today).cast("date")) & (F.col("hour") == hour)
    current = F.coalesce(F.max(F.when(here, F.col("tokens"))), F.lit(0))
    others = F.coalesce(F.max(F.when(~here, F.col("tokens"))), F.lit(0))
    return slots.groupBy(*by).agg(((current > others) & (current > 0)).alias("pr_now"))

"""Shares, rankings and report shapes over summed usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.operators.usage import SCOPE, Span

# Heat levels 0..4, strong day above this part of the greatest day.
HEAT_LEVELS = 4
STRONG_PART = 0.6


def percent(value: Column, total: Column) -> Column:
    """Whole percent of a total, 0 when the total is 0."""
    share = F.floor(value / total * 100 + 0.5)
    return F.when(total > 0, share).otherwise(0).cast("bigint")


def with_share(df: DataFrame, value: str, by: Sequence[str] = SCOPE) -> DataFrame:
    whole = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn("pct", percent(F.col(value), whole))


def ranking(df: DataFrame, name: str, value: str, by: Sequence[str] = SCOPE) -> DataFrame:
    """Entries by value, greatest first; ``pos`` 1 is the leader.  Equal values by name."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), name)
    return with_share(df, value, by).withColumn("pos", F.row_number().over(order))


def splits(df: DataFrame, name: str, totals: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Positive entries with their share of the *period* total.

    ``df`` holds (by, name, tokens), ``totals`` one row (by, tokens) per group.
    """
    keys = list(by) or ["_all"]
    if not by:
        df, totals = (d.withColumn("_all", F.lit(1)) for d in (df, totals))
    whole = totals.select(*keys, F.col("tokens").alias("_whole"))
    joined = df.filter(F.col("tokens") > 0).join(whole, keys, "left")
    order = Window.partitionBy(*keys).orderBy(F.desc("tokens"), name)
    return joined.select(
        *by, name, "tokens",
        percent(F.col("tokens"), F.coalesce("_whole", F.lit(0))).alias("pct"),
        F.row_number().over(order).alias("pos"),
    )


def hour_profile(hours: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Each hour relative to the greatest, the first greatest hour flagged as peak."""
    group = Window.partitionBy(*by)
    peak = F.max("tokens").over(group)
    first = F.min(F.when(F.col("tokens") == F.col("_max"), F.col("hour"))).over(group)
    flagged = hours.withColumn("_max", peak).withColumn("_first", first)
    return flagged.withColumns(
        {
            "level": F.when(F.col("_max") > 0, F.col("tokens") / F.col("_max")).otherwise(0.0),
            "is_peak": (F.col("_max") > 0) & (F.col("hour") == F.col("_first")),
        }
    ).drop("_max", "_first")


def heat_grid(daily: DataFrame, span: Span, by: Sequence[str] = SCOPE) -> DataFrame:
    """Calendar cells: weekday row (Monday 0), week column, intensity and heat level."""
    first = F.lit(span[0]).cast("date")
    slot = F.weekday(first) + F.datediff(F.col("date"), first)
    busiest = F.max("tokens").over(Window.partitionBy(*by))
    cells = daily.select(
        *by, "date", "tokens",
        (slot % 7).cast("int").alias("weekday_row"),
        F.floor(slot / 7).cast("int").alias("week_col"),
        F.when(busiest > 0, F.col("tokens") / busiest).otherwise(0.0).alias("intensity"),
    )
    level = F.least(F.lit(HEAT_LEVELS), F.ceil(F.col("intensity") * HEAT_LEVELS)).cast("int")
    return cells.withColumn("level", level)


def daily_trend(daily: DataFrame, span: Span, value: str = "tokens", by: Sequence[str] = SCOPE) -> DataFrame:
    """Days from the first active one on, share of the shown total, last and strong days flagged.

    A range without any activity keeps all of its days.
    """
    group = Window.partitionBy(*by)
    began = F.min(F.when(F.col(value) > 0, F.col("date"))).over(group)
    shown = daily.withColumn("_began", F.coalesce(began, F.lit(span[0]).cast("date")))
    shown = shown.filter(F.col("date") >= F.col("_began")).drop("_began")
    last = F.col("date") == F.lit(span[1]).cast("date")
    peak = F.greatest(F.max(value).over(group), F.lit(1))
    return with_share(
        shown.withColumns(
            {"is_last": last, "is_strong": ~last & (F.col(value) / peak > STRONG_PART)}
        ),
        value,
        by,
    )

"""Aggregates over usage rows.

Every function takes usage rows (or a cube of them), groups by ``by`` (default: the scope) and
sums before it shuffles.  ``span`` is the (first, last) calendar day of the range: totals,
per-model and per-agent tokens count only days inside it, hour and cost maps count every row.
``groups`` is a frame of the groups that must have a row; without it, those that have usage do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.config import OTHER_PROJECT, RECENT_SECS, TOP_PROJECTS
from meterloom.functions.clock import local_timestamp

SCOPE = ("scope",)
Span = tuple[str, str]
PARTS = ["input", "cached", "output", "reasoning"]


def in_range(usage: DataFrame, start: int) -> DataFrame:
    """Rows from the start of the range on; no upper bound."""
    return usage.filter(F.col("ts") >= start)


def with_clock(usage: DataFrame, tz: str = "UTC") -> DataFrame:
    """Add the local ``date`` and ``hour`` of each row."""
    wall = local_timestamp("ts", tz)
    return usage.withColumns({"date": F.to_date(wall), "hour": F.hour(wall)})


def usage_cube(
    usage: DataFrame, tz: str = "UTC", now: int | None = None, by: Sequence[str] = SCOPE
) -> DataFrame:
    """Sums per (by, date, hour, model, agent, kind, project).

    The one pass over the fact rows; every aggregate below gives the same result on it.
    """
    recent = F.lit(0) if now is None else F.when(now - F.col("ts") <= RECENT_SECS, F.col("total"))
    return (
        with_clock(usage, tz)
        .groupBy(*by, "date", "hour", "model", "agent", "kind", "project")
        .agg(
            F.sum("total").alias("total"),
            *[F.sum(c).alias(c) for c in PARTS],
            F.sum("cost").alias("cost"),
            F.coalesce(F.sum(recent), F.lit(0)).cast("bigint").alias("recent"),
        )
    )


def in_span(df: DataFrame, span: Span) -> DataFrame:
    return df.filter(F.col("date").between(*[F.lit(d).cast("date") for d in span]))


def tokens_per(df: DataFrame, *columns: str, by: Sequence[str] = SCOPE) -> DataFrame:
    return df.groupBy(*by, *columns).agg(F.sum("total").alias("tokens"))


def cost_per(df: DataFrame, *columns: str, by: Sequence[str] = SCOPE) -> DataFrame:
    return df.groupBy(*by, *columns).agg(F.sum("cost").alias("cost"))


def daily_tokens_by(df: DataFrame, span: Span, dim: str, by: Sequence[str] = SCOPE) -> DataFrame:
    """Tokens per day and model (or agent) inside the range."""
    return tokens_per(in_span(df, span), "date", dim, by=by)


def daily_cost(df: DataFrame, span: Span, by: Sequence[str] = SCOPE, groups: DataFrame | None = None) -> DataFrame:
    return fill_days(cost_per(in_span(df, span), "date", by=by), span, ["cost"], by=by, groups=groups)


def daily_totals(df: DataFrame, span: Span, by: Sequence[str] = SCOPE, groups: DataFrame | None = None) -> DataFrame:
    """Tokens and cost of every day of the range, zero on empty days."""
    daily = in_span(df, span).groupBy(*by, "date").agg(
        F.sum("total").alias("tokens"), F.sum("cost").alias("cost")
    )
    return fill_days(daily, span, ["tokens", "cost"], by=by, groups=groups)


def _groups(df: DataFrame, by: Sequence[str], groups: DataFrame | None) -> DataFrame:
    return (df if groups is None else groups).select(*by).distinct() if by else df.sparkSession.range(1).drop("id")


def _zero(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    return {v: F.coalesce(v, F.lit(0).cast(df.schema[v].dataType)) for v in names}


def _every_group(df: DataFrame, by: Sequence[str], groups: DataFrame | None) -> DataFrame:
    """``df``, which has a row per group, with a row for each of ``groups``."""
    return df if groups is None or not by else _groups(df, by, groups).join(df, list(by), "left")


def _fill(df: DataFrame, slot: str, slots: Column, values: Sequence[str], by: Sequence[str], groups: DataFrame | None) -> DataFrame:
    spine = _groups(df, by, groups).withColumn(slot, F.explode(slots))
    return spine.join(df, [*by, slot], "left").withColumns(_zero(df, values))


def fill_days(
    df: DataFrame, span: Span, values: Sequence[str], by: Sequence[str] = SCOPE, groups: DataFrame | None = None
) -> DataFrame:
    """Calendar spine: one row per group and day of the range, missing values as zero.

    ``df`` is already aggregated to one row per group and day.
    """
    days = F.sequence(*[F.lit(d).cast("date") for d in span])
    return _fill(df, "date", days, values, by, groups)


def hourly(df: DataFrame, value: str = "total", by: Sequence[str] = SCOPE, groups: DataFrame | None = None) -> DataFrame:
    """Tokens (``total``) or dollars (``cost``) per hour of day, all 24 hours present."""
    name = "tokens" if value == "total" else value
    sums = df.groupBy(*by, "hour").agg(F.sum(value).alias(name))
    return _fill(sums, "hour", F.sequence(F.lit(0), F.lit(23)), [name], by, groups)


def composition(df: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Tokens by part; sources without a split contribute nothing."""
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in PARTS])


def by_kind(df: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Tokens per activity kind, with ``pos`` in display order."""
    sums = tokens_per(df.filter(F.col("kind").isNotNull()), "kind", by=by)
    order = Window.partitionBy(*by).orderBy(F.desc("tokens"), "kind")
    return sums.withColumn("pos", F.row_number().over(order))


def by_project(df: DataFrame, top: int = TOP_PROJECTS, by: Sequence[str] = SCOPE) -> DataFrame:
    """Largest projects and the rest under one name, with ``pos`` in display order.

    The rest is the total minus the top, so the ranking window never sees more than ``top``
    rows of each task per group (Spark limits ``row_number() <= top`` before the shuffle).
    """
    sums = tokens_per(df.filter(F.col("project") != ""), "project", by=by)
    order = Window.partitionBy(*by).orderBy(F.desc("tokens"), "project")
    head = sums.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= top)
    signed = sums.select(*by, F.col("tokens").alias("t")).unionByName(
        head.select(*by, (-F.col("tokens")).alias("t"))
    )
    rest = signed.groupBy(*by).agg(F.sum("t").alias("tokens")).filter(F.col("tokens") > 0)
    return head.unionByName(
        rest.withColumns({"project": F.lit(OTHER_PROJECT), "pos": F.lit(top + 1)})
    )


def totals(df: DataFrame, span: Span, by: Sequence[str] = SCOPE, groups: DataFrame | None = None) -> DataFrame:
    sums = in_span(df, span).groupBy(*by).agg(
        F.sum("total").alias("tokens"), F.sum("cost").alias("cost")
    )
    return sums if groups is None else _every_group(sums, by, groups).withColumns(_zero(sums, ["tokens", "cost"]))


def best_day(df: DataFrame, span: Span, by: Sequence[str] = SCOPE, groups: DataFrame | None = None) -> DataFrame:
    """Day of the greatest cost, the earliest on ties; the last day of the range when nothing cost."""
    daily = cost_per(in_span(df, span), "date", by=by)
    best = F.max_by(F.struct("date", "cost"), F.struct("cost", -F.unix_date("date")))
    top = _every_group(daily.groupBy(*by).agg(best.alias("b")), by, groups)
    paid = F.col("b.cost") > 0
    return top.select(
        *by,
        F.when(paid, F.col("b.date")).otherwise(F.lit(span[1]).cast("date")).alias("date"),
        F.when(paid, F.col("b.cost")).otherwise(F.lit(0.0)).alias("cost"),
    )


def active_days(df: DataFrame, span: Span, by: Sequence[str] = SCOPE, groups: DataFrame | None = None) -> DataFrame:
    """Days with any usage, and the first of them; the first day of the range without any."""
    days = in_span(df, span).select(*by, "date").distinct()
    found = _every_group(days.groupBy(*by).agg(F.count(F.lit(1)).alias("active_days"), F.min("date").alias("range_start_day")), by, groups)
    return found.withColumns({
        "active_days": F.coalesce("active_days", F.lit(0).cast("bigint")),
        "range_start_day": F.coalesce("range_start_day", F.lit(span[0]).cast("date")),
    })


def session_files(files: DataFrame, start: int, by: Sequence[str] = SCOPE) -> DataFrame:
    """Session files touched since the start of the range, from a manifest of one source."""
    recent = files.filter(F.col("file_mtime") >= start)
    return recent.groupBy(*by).agg(F.countDistinct("file_path").alias("sessions"))


def tokens_per_minute(usage: DataFrame, now: int, by: Sequence[str] = SCOPE, groups: DataFrame | None = None) -> DataFrame:
    """Average of the last ten minutes, truncated; later rows count as well."""
    recent = F.sum(F.when(now - F.col("ts") <= RECENT_SECS, F.col("total")))
    sums = _every_group(usage.groupBy(*by).agg(recent.alias("_recent")), by, groups)
    return sums.select(*by, F.floor(F.coalesce("_recent", F.lit(0)) / 10).cast("bigint").alias("tok_per_min"))

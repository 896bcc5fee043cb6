"""Recent quota history: live samples, bounded look-back, linear runway."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.config import HISTORY_ROWS, HISTORY_SECS, PROVIDER_OF_SOURCE
from meterloom.functions.quota import linear_runway, live_status, pace, window_progress
from meterloom.operators.ordered import first_of, with_lookback

LIMIT = ["scope", "limit_id"]


def filter_limits(readings: DataFrame, sources: list[str]) -> DataFrame:
    """Readings (or accounts) of the providers behind the listed sources.

    A provider no source stands for passes, as an account of it would.
    """
    known = list(PROVIDER_OF_SOURCE.values())
    wanted = [p for s, p in PROVIDER_OF_SOURCE.items() if s in sources]
    listed = F.col("provider").isin(wanted) if wanted else F.lit(False)
    return readings.filter(listed | ~F.col("provider").isin(known))


def live_samples(readings: DataFrame) -> DataFrame:
    """Readings with status ``normal``, the first of each limit and second.

    Hence a limit has at most one sample per second, which bounds every chunk of its series.
    """
    return first_of(readings.filter(F.col("status") == "normal"), [*LIMIT, "ts"], ["position"])


def bounded_history(
    samples: DataFrame, secs: int = HISTORY_SECS, rows: int | None = HISTORY_ROWS, width: int | None = None
) -> DataFrame:
    """Front and length of the history in force at each sample.

    The history holds the samples of the last ``secs`` seconds, at most ``rows`` of them: of the
    last ``rows`` samples those that are young enough.  Without ``rows`` all young ones count.
    """
    spread = with_lookback(samples, "ts", secs, width)
    order = Window.partitionBy(*LIMIT, "chunk").orderBy("ts")
    point = F.struct("ts", "util")
    if rows is None:
        young = order.rangeBetween(-secs, 0)
        framed = spread.withColumns({"_front": F.first(point).over(young), "n": F.count("ts").over(young)})
    else:
        last = F.collect_list(point).over(order.rowsBetween(-(rows - 1), 0))
        framed = spread.withColumn("_last", last).withColumn("_young", F.filter("_last", lambda p: p["ts"] >= F.col("ts") - secs))
        framed = framed.withColumns({"_front": F.col("_young")[0], "n": F.size("_young").cast("bigint")})
    return framed.filter("own").select(
        *samples.columns, F.col("_front.ts").alias("front_ts"), F.col("_front.util").alias("front_util"), "n"
    )


def with_linear_runway(history: DataFrame) -> DataFrame:
    cols = [F.col(c) for c in ("front_ts", "front_util", "ts", "util", "n", "util")]
    return history.withColumn("runway_secs", linear_runway(*cols))


def with_pace(readings: DataFrame, now: str = "ts") -> DataFrame:
    """Add ``progress`` of the window and ``pace``, both only for live readings."""
    live = F.col("status") == "normal"
    placed = readings.withColumn("progress", F.when(live, window_progress("resets_at", "window_secs", now)))
    return placed.withColumn("pace", pace("util", F.col("progress")))


def with_status(readings: DataFrame) -> DataFrame:
    return readings.withColumn("status", live_status())

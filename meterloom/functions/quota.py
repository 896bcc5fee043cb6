"""Column arithmetic on quota readings.

A reading has ``scope, ts, position, limit_id, provider, label, util, resets_at, window_secs,
status`` and optionally ``used, cap, hint, action``.  ``resets_at`` and ``window_secs`` are 0
when unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterloom.config import DEFICIT_EPS, IDLE_SLOPE, LOCKED_PCT, MIN_SAMPLES, NEAR_PCT, STALE_SECS
from meterloom.functions.clock import as_col

# States of a reading.
STATUSES = ["normal", "near", "locked", "stale", "insufficient_data", "source_failed", "idle"]
UNKNOWN_STATUSES = ["source_failed", "insufficient_data"]
# Gauge states, most urgent first.
GAUGE_STATES = ["locked", "warn", "degraded", "stale", "safe"]


def window_name(minutes: Column | str) -> Column:
    """Id and label of a window by its length in minutes."""
    m = as_col(minutes)
    text = m.cast("string")
    hours = F.round(m / 60).cast("bigint").cast("string")
    days = F.round(m / 1440).cast("bigint").cast("string")

    def named(name: Column, label: Column) -> Column:
        return F.struct(name.alias("id"), label.alias("label"))

    other = F.concat(F.lit("codex.min"), text)
    return (
        F.when(m.between(250, 360), named(F.lit("codex.5h"), F.lit("Codex·5h")))
        .when(m.between(9_000, 11_000), named(F.lit("codex.week"), F.lit("Codex·Weekly")))
        .when(m < 1_440, named(other, F.concat(F.lit("Codex·"), hours, F.lit("h"))))
        .otherwise(named(other, F.concat(F.lit("Codex·"), days, F.lit("d"))))
    )


def honest_reading(util: Column, resets_at: Column, age: Column, now: Column) -> Column:
    """What an old snapshot still says: a passed reset means 0, an old open window is stale."""
    expired, old = resets_at <= now, age > STALE_SECS
    return F.struct(
        F.when(expired, 0.0).otherwise(util).alias("util"),
        F.when(expired, 0).otherwise(resets_at).cast("bigint").alias("resets_at"),
        F.when(expired & old, "idle").when(old, "stale").otherwise("normal").alias("status"),
    )


def live_status(util: Column | str = "util", status: Column | str = "status") -> Column:
    """Status by utilisation for live readings; degraded ones keep theirs."""
    u, s = as_col(util), as_col(status)
    by_util = F.when(u >= LOCKED_PCT, "locked").when(u >= NEAR_PCT, "near").otherwise("normal")
    return F.when(s == "normal", by_util).otherwise(s)


def window_progress(resets_at: Column | str, window_secs: Column | str, now: Column | str) -> Column:
    """Elapsed part of the window 0..1; NULL when the window or its reset is unknown, or not begun."""
    reset, window = as_col(resets_at), as_col(window_secs)
    elapsed = as_col(now) - (reset - window)
    known = (window > 0) & (reset > 0) & (elapsed > 0)
    return F.when(known, F.least(elapsed / window, F.lit(1.0)))


def pace(util: Column | str, progress: Column) -> Column:
    """Points ahead (positive) or behind an even burn; NULL without a placed window."""
    deficit = as_col(util) - progress * 100
    return F.when(
        progress.isNotNull(),
        F.struct(deficit.alias("deficit"), (deficit > DEFICIT_EPS).alias("in_deficit")),
    )


def linear_runway(front_ts: Column, front_util: Column, ts: Column, util: Column, n: Column, current: Column) -> Column:
    """Seconds until 100 % at the slope of the recent history; NULL when short, flat or falling."""
    dt = (ts - front_ts).cast("double")
    slope = F.when(dt > 0, (util - front_util) / dt)
    left = F.greatest(100.0 - current, F.lit(0.0))
    return F.when((n >= MIN_SAMPLES) & (slope > IDLE_SLOPE), (left / slope).cast("bigint"))


def percent_left(util: Column | str = "util", status: Column | str = "status") -> Column:
    """Whole percent left: NULL when the reading is unknown, 0 when locked."""
    u, s = as_col(util), as_col(status)
    left = F.greatest(F.floor(100 - u + 0.5), F.lit(0)).cast("bigint")
    return F.when(s.isin(UNKNOWN_STATUSES), F.lit(None)).when(s == "locked", 0).otherwise(left)


def gauge_state(status: Column | str = "status") -> Column:
    s = as_col(status)
    return (
        F.when(s == "locked", "locked").when(s == "near", "warn")
        .when(s.isin(UNKNOWN_STATUSES), "degraded").when(s.isin("stale", "idle"), "stale")
        .otherwise("safe")
    )

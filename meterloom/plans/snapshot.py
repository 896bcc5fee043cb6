"""The quota snapshot: everything the engine says about the readings of one instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.operators.choice import sticky_worst
from meterloom.operators.history import (
    complete_cycles, cycle_curves, landed_samples, reset_points, retain, split_cycles,
    with_reset_change, with_reset_in_force,
)
from meterloom.operators.projection import project
from meterloom.operators.readings import (
    LIMIT, bounded_history, live_samples, with_linear_runway, with_pace, with_status,
)
from meterloom.config import HISTORY_ROWS, HISTORY_SECS


def limit_history(samples: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Landed samples and reset points of live samples, within retention."""
    marked = with_reset_change(samples)
    return retain(landed_samples(marked), reset_points(marked), now)


def limit_cycle_curves(samples: DataFrame, resets: DataFrame, windows: DataFrame) -> DataFrame:
    """Curves of the complete cycles; ``windows`` gives (scope, limit_id, window_secs)."""
    placed = with_reset_in_force(samples, resets).join(windows, LIMIT)
    cycles = split_cycles(placed)
    return cycle_curves(cycles, complete_cycles(cycles))


def quota_snapshot(
    readings: DataFrame,
    now: int,
    secs: int = HISTORY_SECS,
    rows: int = HISTORY_ROWS,
    landed: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Status, pace, runway and shown limit of every reading at each scope's latest instant.

    ``readings`` holds the recorded readings up to ``now`` including that instant.  ``landed``
    gives the stored history (samples, reset points); without it, it is derived from the readings.
    """
    readings = readings.filter(F.col("ts") <= now)
    latest = readings.groupBy("scope").agg(F.max("ts").alias("ts"))
    current = readings.join(latest, ["scope", "ts"], "left_semi")
    live = live_samples(readings)
    runway = with_linear_runway(bounded_history(live.select(*LIMIT, "ts", "util"), secs, rows))
    recent = runway.select(*LIMIT, "ts", F.col("runway_secs").alias("linear_secs"))
    samples, resets = retain(*landed, now) if landed else limit_history(live, now)
    windows = current.filter(F.col("window_secs") > 0).groupBy(*LIMIT).agg(F.max("window_secs").alias("window_secs"))
    curves = limit_cycle_curves(samples, resets, windows)
    paced = with_pace(current).join(recent, [*LIMIT, "ts"], "left")
    projected = project(paced, curves)
    live_row = F.col("status") == "normal"
    shaped = projected.withColumns(
        {
            "runway_secs": F.when(live_row, F.col("runway_secs")),
            "pace": F.when(
                F.col("pace").isNotNull(),
                F.struct("pace.deficit", "pace.in_deficit", "pace_basis", "run_out_probability"),
            ),
        }
    ).drop("pace_basis", "run_out_probability", "linear_secs", "expected_util")
    return with_status(shaped).join(sticky_worst(readings), ["scope", "ts"], "left")

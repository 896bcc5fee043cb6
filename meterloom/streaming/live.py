"""Stateful operators on a stream of quota readings, and incremental usage sums.

The rules are the batch ones (``operators.folds``); a stream only supplies their rows in order.
Every key has its own time: nothing depends on how far other keys have come, and there is no
watermark.  Rules per limit take a reading when it arrives.  Rules per snapshot hold the rows of a
scope's latest instant until a later instant of that scope arrives (or a closing row, one without a
limit), so a snapshot may be split over micro-batches.  A row at or before an instant that is done
is late: it changes nothing and is returned by the same function with ``late=True``.

A key's state is a few values (and the held rows of one snapshot); it is kept for good.  How many
rows of a key a micro-batch brings is set by the source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterloom.config import (
    ALERT_SECS, CRIT_PCT, DWELL_SECS, HISTORY_ROWS, HISTORY_SECS, HYSTERESIS_PCT, LANDING_DELTA,
    LANDING_SECS, PROVIDER_OF_SOURCE, SOURCE_FAIL_SECS, WARN_PCT,
)
from meterloom.functions.quota import linear_runway, live_status, pace, window_progress
from meterloom.operators.alerts import alert_level
from meterloom.operators.folds import StickyWorst, Thinning
from meterloom.operators.usage import PARTS, SCOPE, usage_cube
from meterloom.sources.batches import batch_folders
from meterloom.sources.quota import land_points

READING = (
    "scope string, ts bigint, position bigint, limit_id string, provider string, label string,"
    " util double, resets_at bigint, window_secs bigint, status string, hint string"
)

READING_COLUMNS = [f.strip().split()[0] for f in READING.split(",")]

Step = Callable[[tuple, object, int, list[dict]], tuple[object, list[tuple]]]


def _null(value) -> bool:
    return value is None or value != value


def _keyed(stream: DataFrame, keys: list[str], output: str, step: Step, late: bool, whole: bool = False) -> DataFrame:
    """Fold the readings of each key, one instant at a time, with JSON state.

    ``step(key, memory, ts, rows of that instant)`` returns the new memory and output tuples.
    ``whole`` holds an instant until a later one arrives.  With ``late`` the result is the key and
    time of the rows that came too late, otherwise what ``step`` put out.
    """
    names = [f.strip().split()[0] for f in output.split(",")]

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # Most keys have a few rows: plain rows are many times quicker here than a frame per instant.
        memory, last, held, rows = None, None, [], []
        if state.exists:
            text, last, rest = state.get
            memory, held = json.loads(text), json.loads(rest)
        for frame in frames:
            columns = list(frame.columns)
            if held:
                rows = [{c: float("nan") if v is None and c == "util" else v for c, v in zip(columns, row)} for row in held]
                held = []
            rows.extend(dict(zip(columns, row)) for row in zip(*(frame[c].tolist() for c in columns)))
        rows = [row for row in rows if not _null(row["ts"])]
        rows.sort(key=lambda row: (row["ts"], none := _null(row["position"]), 0 if none else row["position"]))
        held, out = [], []
        for ts, group in groupby(rows, lambda row: row["ts"]):
            group = [row for row in group if not _null(row["limit_id"])]
            if last is not None and ts <= last:
                out.extend((*key, int(ts), *[None] * (len(names) - len(key) - 1), True) for _ in group)
            elif whole and ts == rows[-1]["ts"]:
                held = [[None if _null(v) else v for v in row.values()] for row in group]
            elif group:
                memory, emitted = step(key, memory, int(ts), group)
                last = int(ts)
                out.extend((*row, False) for row in emitted)
        state.update((json.dumps(memory), last, json.dumps(held)))
        if out:
            yield pd.DataFrame(out, columns=[*names, "late"]).astype({"late": bool})

    ordered = [c for c in READING_COLUMNS if c in stream.columns]
    rest = [c for c in stream.columns if c not in ordered]
    folded = stream.select(*ordered, *rest).groupBy(*keys).applyInPandasWithState(
        update, f"{output}, late boolean", "memory string, last_ts bigint, held string", "append", "NoTimeout"
    )
    picked = folded.filter(F.col("late") if late else ~F.col("late"))
    return picked.select(*keys, "ts") if late else picked.drop("late")


def _state(memory) -> tuple | None:
    return None if memory is None else tuple(memory)


def stream_alerts(
    stream: DataFrame, warn: float = WARN_PCT, crit: float = CRIT_PCT, secs: int = ALERT_SECS, late: bool = False
) -> DataFrame:
    """Threshold alerts as they fire: scope, limit_id, ts, level."""
    rule = Thinning(secs, emit="level")

    def step(key, memory, ts, rows):
        state, level = rule.step(_state(memory), {"ts": ts, "level": rows[0]["level"]})
        return state, [] if level is None else [(*key, ts, level)]

    levels = stream.withColumn("level", alert_level(warn, crit)).filter(F.col("level").isNotNull())
    return _keyed(levels, ["scope", "limit_id"], "scope string, limit_id string, ts bigint, level string", step, late)


def stream_source_notices(stream: DataFrame, secs: int = SOURCE_FAIL_SECS, late: bool = False) -> DataFrame:
    """Source-failure notices as they fire: scope, ts, provider, body."""
    rule = Thinning(secs, emit="body")
    providers = list(PROVIDER_OF_SOURCE.values())

    def step(key, memory, ts, rows):
        memory = dict(memory or {})
        notices = {}
        for r in rows:
            if r["status"] == "source_failed":
                notices.setdefault(r["provider"], r["hint"] if isinstance(r["hint"], str) else f"{r['label']} usage unavailable")
        out = []
        for p in providers:
            row = {"ts": ts, "body": notices.get(p), "clears": p not in notices}
            state, body = rule.step(_state(memory.get(p)), row)
            memory[p] = state
            if body is not None:
                out.append((*key, ts, p, body))
        return memory, out

    return _keyed(stream, ["scope"], "scope string, ts bigint, provider string, body string", step, late, whole=True)


def stream_sticky_worst(
    stream: DataFrame, margin: float = HYSTERESIS_PCT, dwell: int = DWELL_SECS,
    late: bool = False,
) -> DataFrame:
    """Limit to show after each snapshot: scope, ts, worst_id."""
    rule = StickyWorst(margin, dwell)

    def step(key, memory, ts, rows):
        row = {"ts": ts, "ids": [r["limit_id"] for r in rows], "utils": [r["util"] for r in rows]}
        state, shown = rule.step(_state(memory), row)
        return state, [(*key, ts, shown)]

    return _keyed(stream, ["scope"], "scope string, ts bigint, worst_id string", step, late, whole=True)


def stream_history(
    stream: DataFrame, secs: int = HISTORY_SECS, rows: int = HISTORY_ROWS, late: bool = False
) -> DataFrame:
    """Live samples with the front and length of the history in force at each."""

    def step(key, memory, ts, group):
        first = group[0]
        points = [p for p in (memory or []) if p[0] >= ts - secs]
        points = [*points, [ts, float(first["util"])]][-rows:]
        front = points[0]
        out = (*key, ts, float(first["util"]), int(first["resets_at"]), int(first["window_secs"]), front[0], front[1], len(points))
        return points, [out]

    live = stream.filter(F.col("status") == "normal")
    output = (
        "scope string, limit_id string, ts bigint, util double, resets_at bigint, window_secs bigint,"
        " front_ts bigint, front_util double, n bigint"
    )
    return _keyed(live, ["scope", "limit_id"], output, step, late)


def stream_projection(stream: DataFrame, secs: int = HISTORY_SECS, rows: int = HISTORY_ROWS) -> DataFrame:
    """Status, pace and linear runway of each live reading; only the history is Python state."""
    history = stream_history(stream, secs, rows)
    cols = [F.col(c) for c in ("front_ts", "front_util", "ts", "util", "n", "util")]
    placed = history.withColumn("progress", window_progress("resets_at", "window_secs", "ts"))
    return placed.withColumns(
        {
            "status": live_status("util", F.lit("normal")),
            "pace": pace("util", F.col("progress")),
            "runway_secs": linear_runway(*cols),
        }
    ).drop("front_ts", "front_util", "n", "progress")


def stream_landing(
    stream: DataFrame, secs: int = LANDING_SECS, delta: float = LANDING_DELTA, late: bool = False
) -> DataFrame:
    """What is worth landing: kept samples and reset points (``kind`` is sample or reset)."""
    rule = Thinning(secs, delta)

    def step(key, memory, ts, rows):
        first = rows[0]
        util, reset = float(first["util"]), int(first["resets_at"])
        kept, known = memory or (None, None)
        forced = known is None or known != reset
        state, value = rule.step(_state(kept), {"ts": ts, "value": util, "forced": forced})
        out = [(*key, ts, "reset", None, reset)] if forced else []
        if value is not None:
            out.append((*key, ts, "sample", util, None))
        return [state, reset], out

    live = stream.filter(F.col("status") == "normal").select("scope", "ts", "position", "limit_id", "util", "resets_at")
    output = "scope string, limit_id string, ts bigint, kind string, util double, resets_at bigint"
    return _keyed(live, ["scope", "limit_id"], output, step, late)


def _start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def land_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch to its own folder below ``path``; a replayed batch replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _start(df, write, checkpoint)


def land_quota_history(stream: DataFrame, path: str, checkpoint: str, **rule) -> StreamingQuery:
    """Landing throttle into the history tables read by ``sources.quota.read_quota_history``."""

    def write(batch: DataFrame, number: int) -> None:
        land_points(batch, path, number)

    return _start(stream_landing(stream, **rule), write, checkpoint)


def maintain_usage_cube(
    usage_stream: DataFrame, path: str, checkpoint: str, tz: str = "UTC"
) -> StreamingQuery:
    """Keep usage sums current from newly booked rows.

    Each micro-batch adds its own partial cube; a replayed batch replaces its folder, so nothing
    counts twice.  ``read_usage_cube`` adds the partials up.
    """

    def write(batch: DataFrame, number: int) -> None:
        usage_cube(batch, tz).drop("recent").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _start(usage_stream, write, checkpoint)


def read_usage_cube(spark: SparkSession, path: str) -> DataFrame:
    """The maintained cube; every usage aggregate accepts it in place of usage rows."""
    return cube_of(spark, batch_folders(spark, path) or [path])


def cube_of(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The sum of the partial cubes of some folders."""
    dims = [*SCOPE, "date", "hour", "model", "agent", "kind", "project"]
    return spark.read.parquet(*folders).groupBy(*dims).agg(
        *[F.sum(c).alias(c) for c in ["total", *PARTS, "cost"]]
    )

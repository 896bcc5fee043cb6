"""Streams against the batch operators on the same readings, in several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from meterloom.config import RETAIN_SECS
from meterloom.operators import alerts, choice, history, readings
from meterloom.operators.usage import daily_tokens_by, with_clock
from meterloom.plans.landed import merge_quota_history, merge_usage_cube
from meterloom.sources.batches import drop_merged
from meterloom.sources.quota import read_quota_history, write_quota_history
from meterloom.streaming import live
from test_quota import READING, make, reading
from test_usage import SCHEMA, claude_row, usage

T0 = 1_700_000_000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out, t = [], T0
    for i in range(240):
        t += rng.choice([15, 15, 15, 60, 400])
        for pos, name in enumerate(("a", "b", "c")):
            status = "source_failed" if name == "c" and 60 < i % 120 < 100 else "normal"
            util = 0.0 if status == "source_failed" else min(100.0, (i * (3 + pos)) % 130)
            provider = "anthropic" if name == "c" else "codex"
            out.append(reading(t, util, name, status, provider, 18_000, T0 + 18_000 * (1 + i // 80), pos=pos, hint=None))
    return out


def stream_of(spark, rows, folder, slices=4):
    """One file per slice of time, read one file per trigger."""
    stamps = sorted({r[1] for r in rows})
    cuts = [stamps[len(stamps) * i // slices] for i in range(slices)] + [stamps[-1] + 1]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        # the first snapshot of a slice is split: its even positions came with the slice before
        part = [r for r in rows if (lo <= r[1] < hi and not (r[1] == lo and i and r[2] % 2 == 0)) or (r[1] == hi and r[2] % 2 == 0)]
        if i == slices - 1:
            part += [closing(r[0], r[1]) for r in {r[0]: r for r in sorted(rows, key=lambda r: r[1])}.values()]
        random.Random(i).shuffle(part)
        make(spark, part).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(READING).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


def closing(scope, ts):
    """A row without a limit: the scope's latest snapshot is complete."""
    return (scope, ts + 1, *[None] * (len(READING.split(",")) - 2))


def drain(spark, stream, tmp_path):
    query = live.land_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def same(got, want, *cols):
    assert sorted(map(repr, got.select(*cols).collect())) == sorted(map(repr, want.select(*cols).collect()))
    assert got.count() > 0


def test_alerts(spark, rows, tmp_path):
    got = drain(spark, live.stream_alerts(stream_of(spark, rows, str(tmp_path / "in"))), tmp_path)
    same(got, alerts.threshold_alerts(make(spark, rows)), "scope", "limit_id", "ts", "level")


def test_source_notices(spark, rows, tmp_path):
    got = drain(spark, live.stream_source_notices(stream_of(spark, rows, str(tmp_path / "in")), secs=900), tmp_path)
    same(got, alerts.source_failure_notices(make(spark, rows), secs=900), "scope", "provider", "ts", "body")


def test_sticky_worst(spark, rows, tmp_path):
    got = drain(spark, live.stream_sticky_worst(stream_of(spark, rows, str(tmp_path / "in"))), tmp_path)
    same(got, choice.sticky_worst(make(spark, rows)), "scope", "ts", "worst_id")


def test_projection(spark, rows, tmp_path):
    got = drain(spark, live.stream_projection(stream_of(spark, rows, str(tmp_path / "in"))), tmp_path)
    batch = readings.with_pace(readings.with_linear_runway(readings.bounded_history(readings.live_samples(make(spark, rows)))))
    same(got, readings.with_status(batch), "limit_id", "ts", "status", "runway_secs", "pace")


def test_landing(spark, rows, tmp_path):
    path = str(tmp_path / "history")
    live.land_quota_history(stream_of(spark, rows, str(tmp_path / "in")), path, str(tmp_path / "ck")).awaitTermination()
    samples, resets = read_quota_history(spark, path)
    marked = history.with_reset_change(readings.live_samples(make(spark, rows)))
    same(samples, history.landed_samples(marked), "limit_id", "ts", "util")
    same(resets, history.reset_points(marked), "limit_id", "ts", "resets_at")


def test_late_and_repeated_readings_are_dropped(spark, tmp_path):
    first = [reading(T0, 50, "a"), reading(T0 + 100, 60, "a")]
    late = [reading(T0 + 50, 99, "a"), reading(T0 + 100, 99, "a"), reading(T0 + 200, 70, "a")]
    for i, part in enumerate((first, late)):
        make(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
    stream = spark.readStream.schema(READING).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(spark, live.stream_history(stream), tmp_path)
    assert [(r["ts"], r["util"]) for r in got.orderBy("ts").collect()] == [(T0, 50.0), (T0 + 100, 60.0), (T0 + 200, 70.0)]
    late = drain(spark, live.stream_history(stream, late=True), tmp_path / "late")
    assert sorted(r["ts"] for r in late.collect()) == [T0 + 50, T0 + 100]


def test_lagging_scope_loses_nothing(spark, rows, tmp_path):
    """One scope arrives days behind the other; both give what the batch gives."""
    slow = [("slow", *r[1:]) for r in rows]
    shifted = [(*r[:1], r[1] + 5 * 86_400, *r[2:]) for r in rows]
    both = shifted + slow
    for i in range(4):
        part = [*shifted[len(shifted) * i // 4:len(shifted) * (i + 1) // 4], *(slow[len(slow) * (i - 1) // 4:len(slow) * i // 4] if i else [])]
        part += slow[len(slow) * 3 // 4:] + [closing("slow", 2 * T0), closing(rows[0][0], 2 * T0)] if i == 3 else []
        make(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
    read = lambda: spark.readStream.schema(READING).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(spark, live.stream_sticky_worst(read()), tmp_path)
    same(got, choice.sticky_worst(make(spark, both)), "scope", "ts", "worst_id")
    got = drain(spark, live.stream_history(read()), tmp_path / "h")
    assert got.filter("scope = 'slow'").count() == readings.live_samples(make(spark, slow)).count()
    late = live.stream_history(read(), late=True)
    assert drain(spark, late, tmp_path / "l").count() == 0


def test_incremental_usage(spark, tmp_path):
    parts = [usage(spark, claude_row("2026-07-15T01:00:00", 5, 0.5), claude_row("2026-07-16T01:00:00", 7)), usage(spark, claude_row("2026-07-16T02:00:00", 8))]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.maintain_usage_cube(stream, str(tmp_path / "cube"), str(tmp_path / "ck")).awaitTermination()
    span = ("2026-07-15", "2026-07-16")
    got = daily_tokens_by(live.read_usage_cube(spark, str(tmp_path / "cube")), span, "model")
    same(got, daily_tokens_by(with_clock(parts[0].unionByName(parts[1])), span, "model"), "date", "model", "tokens")
    assert len(list((tmp_path / "cube").glob("batch=*"))) == 2
    assert live.read_usage_cube(spark, str(tmp_path / "cube")).agg(F.sum("cost")).first()[0] == 0.5
    more = usage(spark, claude_row("2026-07-16T02:00:00", 30, 0.25))
    assert merge_usage_cube(spark, str(tmp_path / "cube")) == 1 and drop_merged(spark, str(tmp_path / "cube")) == [0, 1]
    more.coalesce(1).write.parquet(str(tmp_path / "in" / "002"))
    live.maintain_usage_cube(stream, str(tmp_path / "cube"), str(tmp_path / "ck")).awaitTermination()
    whole = live.read_usage_cube(spark, str(tmp_path / "cube"))
    every = parts[0].unionByName(parts[1]).unionByName(more)
    same(daily_tokens_by(whole, span, "model"), daily_tokens_by(with_clock(every), span, "model"), "date", "model", "tokens")
    assert merge_usage_cube(spark, str(tmp_path / "cube")) == 2
    assert rows_of(live.read_usage_cube(spark, str(tmp_path / "cube"))) == rows_of(whole)  # the old folders still stand


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_merged_history_keeps_retention_and_later_batches(spark, tmp_path):
    path, now = str(tmp_path / "history"), 2_000_000_000
    old = now - RETAIN_SECS - 1
    assert read_quota_history(spark, path)[0].count() == 0 and merge_quota_history(spark, path, now) == -1

    def land(batch, *points):
        write_quota_history(
            spark.createDataFrame([("s", "a", t, 1.5) for t in points], "scope string, limit_id string, ts long, util double"),
            spark.createDataFrame([("s", "a", t, t + 9) for t in points[:1]], "scope string, limit_id string, ts long, resets_at long"), path, batch)

    land(0, old, now - 50), land(1, now - 40)
    before = read_quota_history(spark, path)
    assert merge_quota_history(spark, path, now) == 1 and merge_quota_history(spark, path, now) == -1
    merged = read_quota_history(spark, path)
    assert sorted(r["ts"] for r in merged[0].collect()) == [now - 50, now - 40] and [r["ts"] for r in merged[1].collect()] == [now - 40]
    assert before[0].count() == 3  # a reader from before the merge
    land(1, now - 40)  # a late replay of a merged batch changes nothing
    land(2, now - 10)
    assert sorted(r["ts"] for r in read_quota_history(spark, path)[0].collect()) == [now - 50, now - 40, now - 10]
    assert merge_quota_history(spark, path, now) == 2
    (tmp_path / "history" / "merged" / "upto=2" / "_SUCCESS").unlink()  # died before the commit
    assert sorted(r["ts"] for r in read_quota_history(spark, path)[0].collect()) == [now - 50, now - 40, now - 10]
    assert merge_quota_history(spark, path, now) == 2 and drop_merged(spark, path) == [0, 1, 2]
    kept = read_quota_history(spark, path)
    assert sorted(r["ts"] for r in kept[0].collect()) == [now - 50, now - 40, now - 10] and kept[1].count() == 2

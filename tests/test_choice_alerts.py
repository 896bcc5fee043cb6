"""Choice of the shown limit, fallbacks, board, alerts."""

import random

import pytest

from meterloom.operators import alerts, choice, readings
from meterloom.operators.folds import StickyWorst
from test_quota import READING, make, reading

LIMITS = "array<struct<limit_id:string,label:string,util:double,resets_at:long,window_secs:long,used:long,cap:long>>"


@pytest.mark.parametrize(
    "snapshots,want",
    [
        ([(0, {"a": 40, "b": 88, "c": 12})], ["b"]),
        ([(0, {"a": 87, "b": 85}), (100, {"a": 87, "b": 89})], ["a", "a"]),
        ([(0, {"a": 80, "b": 78}), (100, {"a": 80, "b": 90})], ["a", "b"]),
        ([(0, {"a": 80, "b": 78}), (5, {"a": 80, "b": 99})], ["a", "a"]),
        ([(0, {"a": 80}), (5, {"b": 30})], ["a", "b"]),
        ([(0, {"a": 80, "b": 80})], ["b"]),
    ],
)
def test_sticky_worst(spark, snapshots, want):
    rows = [reading(t, u, limit, pos=i) for t, limits in snapshots for i, (limit, u) in enumerate(limits.items())]
    got = choice.sticky_worst(make(spark, rows)).orderBy("ts").collect()
    assert [r["worst_id"] for r in got] == want


@pytest.mark.parametrize("width", [45, 500, 100_000])
def test_sticky_worst_across_chunks(spark, width):
    rng = random.Random(11)
    rows, t, rule, state, want = [], 0, StickyWorst(), None, []
    for _ in range(400):
        t += rng.choice([5, 15, 15, 40, 90])
        names = rng.sample("abcd", rng.randint(1, 4))
        utils = [float(rng.randint(40, 60)) for _ in names]
        rows += [reading(t, u, n, pos=i) for i, (n, u) in enumerate(zip(names, utils))]
        state, shown = rule.step(state, {"ts": t, "ids": names, "utils": utils})
        want.append((t, shown))
    got = choice.sticky_worst(make(spark, rows), width=width)
    assert sorted((r["ts"], r["worst_id"]) for r in got.collect()) == want


def test_worst_per_provider_first_of_equals(spark):
    rows = [reading(1, 50, "a", pos=0), reading(1, 50, "b", pos=1), reading(1, 40, "c", "locked", pos=2), reading(2, 9, "x", pos=5), reading(2, 9, "y", pos=4)]
    got = {r["ts"]: r["limit_id"] for r in choice.worst_per_provider(make(spark, rows)).collect()}
    assert got == {1: "c", 2: "y"}


def test_board_and_gauge(spark):
    rows = [
        reading(10, 30, "cc.5h", provider="anthropic", resets=100, pos=0), reading(10, 80, "cc.week", "stale", provider="anthropic", resets=5, pos=1),
        reading(10, 0, "codex.5h", "source_failed", pos=2), reading(10, 100, "codex.week", pos=3), reading(10, 3, "x", "insufficient_data", pos=4, provider="grok"),
    ]
    board = {r["limit_id"]: r for r in choice.quota_board(readings.with_status(make(spark, rows))).collect()}
    assert [board[k]["percent_left"] for k in ("cc.5h", "cc.week", "codex.5h", "codex.week", "x")] == [70, 20, None, 0, None]
    assert [board[k]["badge"] for k in ("cc.5h", "cc.week", "codex.5h", "x")] == [None, "stale", "unavailable", "estimate"]
    assert [board[k]["provider_state"] for k in ("cc.5h", "codex.5h", "x")] == ["stale", "locked", "degraded"]
    assert [board[k]["reset_in_secs"] for k in ("cc.5h", "cc.week", "codex.5h")] == [90, 0, None]
    gauge = choice.quota_gauge(make(spark, rows)).orderBy("gauge_pos").collect()
    assert [(r["limit_id"], r["util"]) for r in gauge] == [("cc.5h", 30.0), ("cc.week", 80.0), ("codex.week", 100.0)]


def test_choose_source(spark):
    live = make(spark, [reading(1, 5, "L", scope=s) for s in ("local", "auto", "live")])
    local = make(spark, [reading(1, 7, "F", scope=s) for s in ("local", "auto", "auto2", "live2")])
    modes = spark.createDataFrame([(s, m, 1) for s, m in (("local", "local"), ("auto", "auto"), ("auto2", "auto"), ("live", "live"), ("live2", "live"), ("none", "local"))], "scope string, mode string, ts long")
    got = {}
    for r in choice.choose_source(live, local, modes).collect():
        got.setdefault(r["scope"], []).append((r["limit_id"], r["status"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        "local": [("F", "normal")], "auto": [("L", "normal")], "auto2": [("F", "normal")], "live": [("L", "normal")],
        "live2": [("codex.5h", "source_failed"), ("codex.week", "source_failed")],
    }


def test_last_known_good(spark):
    good = [("cc.5h", "Claude·5h", 10.0, 9, 18_000, None, None), ("cc.extra", "Claude·Credits", 1.0, 0, 5, 3, 4)]
    rows = [
        ("s", 1, None, "usage_http_429"), ("s", 2, good, None), ("s", 3, None, "usage_http_429"), ("s", 4, None, "usage_http_401"),
        ("s", 5, None, "network"), ("s", 6, [], None), ("t", 3, None, "refresh_http_403"),
    ]
    df = spark.createDataFrame(rows, f"scope string, ts long, limits {LIMITS}, failure string")
    got = {}
    for r in choice.last_known_good(df, width=2).orderBy("position").collect():
        got.setdefault((r["scope"], r["ts"]), []).append((r["limit_id"], r["status"], r["util"], r["action"]))
    failed = [("cc.5h", "source_failed", 0.0, None), ("cc.week", "source_failed", 0.0, None)]
    login = [(a, b, c, "relogin") for a, b, c, _ in failed]
    stale = [("cc.5h", "stale", 10.0, None), ("cc.extra", "stale", 1.0, None)]
    assert got == {
        ("s", 1): failed, ("s", 2): [(a, "normal", c, d) for a, _, c, d in stale], ("s", 3): stale, ("s", 4): login,
        ("s", 5): stale, ("s", 6): stale, ("t", 3): login,
    }


def test_filter_limits(spark):
    rows = make(spark, [reading(1, 1, p, provider=p) for p in ("anthropic", "codex", "grok", "other")])
    assert sorted(r["provider"] for r in readings.filter_limits(rows, ["claude", "grok"]).collect()) == ["anthropic", "grok", "other"]
    assert [r["provider"] for r in readings.filter_limits(rows, []).collect()] == ["other"]


def test_threshold_alerts(spark):
    t = 1_700_000_000
    rows = [
        reading(t, 80), reading(t + 60, 95), reading(t + 1_799, 99), reading(t + 1_800, 91), reading(t + 3_000, 10), reading(t + 4_000, 75),
        reading(t, 100, "f", "source_failed"), reading(t, 1, "l", "locked"),
    ]
    got = sorted((r["limit_id"], r["ts"] - t, r["level"]) for r in alerts.threshold_alerts(make(spark, rows)).collect())
    assert got == [("a", 0, "warning"), ("a", 1_800, "critical"), ("a", 4_000, "warning"), ("l", 0, "critical")]


def test_source_notices(spark):
    t = 1_700_000_000
    def bad(at, **kw):
        return [reading(at, 0, "cc.5h", "source_failed", "anthropic", hint="log in", pos=0, **kw), reading(at, 0, "cc.week", "source_failed", "anthropic", hint="x", pos=1, **kw)]

    rows = bad(t) + bad(t + 15) + bad(t + 21_599) + bad(t + 21_600) + [reading(t + 21_700, 5, "cc.5h", provider="anthropic")]
    rows += bad(t + 21_800) + [reading(t + 21_900, 5, "codex.5h")] + bad(t + 22_000) + [reading(t + 22_000, 0, "codex.5h", "source_failed", pos=7)]
    got = sorted((r["provider"], r["ts"] - t, r["body"]) for r in alerts.source_failure_notices(make(spark, rows)).collect())
    assert got == [("anthropic", s, "log in") for s in (0, 21_600, 21_800, 22_000)] + [("codex", 22_000, "Codex.5H usage unavailable")]
    for width in (21_600, 30_000):
        again = alerts.source_failure_notices(make(spark, rows), width=width)
        assert sorted((r["provider"], r["ts"] - t, r["body"]) for r in again.collect()) == got


def test_reading_schema_matches():
    assert READING.startswith("scope string, ts long, position long")

"""Quota readings: status, pace, runway, history, cycles, projection."""

import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import lines
from meterloom.functions import quota as q
from meterloom.operators import choice, history, projection, readings
from meterloom.plans.snapshot import limit_cycle_curves, limit_history, quota_snapshot
from meterloom.sources import quota as sources

NOW = 1_700_000_000
READING = (
    "scope string, ts long, position long, limit_id string, provider string, label string, util double,"
    " resets_at long, window_secs long, status string, hint string"
)


def make(spark, rows):
    return spark.createDataFrame(rows, READING)


def reading(ts, util, limit="a", status="normal", provider="codex", window=0, resets=0, scope="s", pos=0, hint=None):
    return (scope, ts, pos, limit, provider, limit.title(), float(util), resets, window, status, hint)


# name, id, provider, util, window, seconds to reset, status, samples, expected status, deficit, runway
UP = lambda end: [(-100, end - 10.0), (-50, end - 5.0), (0, end)]
# The thirteen shared cases (FIXTURES.md F6) under their names.
GOLDEN = [
    ("normal_reset_today_clock", "codex.5h", "codex", 20.0, 18_000, 16_200, "normal", UP(20.0), "normal", 10.0, 800),
    ("in_deficit_at_90_near_boundary", "codex.5h", "codex", 90.0, 18_000, 9_000, "normal", UP(90.0), "near", 40.0, 100),
    ("threshold_below_75_normal", "codex.5h", "codex", 74.0, 18_000, 9_000, "normal", UP(74.0), "normal", 24.0, 260),
    ("threshold_at_75_near", "codex.5h", "codex", 75.0, 18_000, 9_000, "normal", UP(75.0), "near", 25.0, 250),
    ("locked_reset_tomorrow_clock", "codex.week", "codex", 100.0, 604_800, 82_800, "normal", UP(100.0), "locked", 13.6905, 0),
    ("locked_reset_cross_week_clock", "cc.week", "anthropic", 100.0, 604_800, 252_000, "normal", UP(100.0), "locked", 41.6667, 0),
    ("pin_5h_no_data_dash", "codex.week", "codex", 50.0, 604_800, 100_000, "normal", UP(50.0), "normal", -33.4656, 500),
    ("pin_auto_picks_worst_locked", "codex.week", "codex", 100.0, 604_800, 50_000, "normal", UP(100.0), "locked", 8.2672, 0),
    ("pin_5h_explicit_on_pace", "codex.5h", "codex", 60.0, 18_000, 7_200, "normal", UP(60.0), "normal", 0.0, 400),
    ("stale_no_projection", "codex.5h", "codex", 30.0, 18_000, 6_000, "stale", [], "stale", None, None),
    ("source_failed_dash", "codex.5h", "codex", 0.0, 18_000, 0, "source_failed", [], "source_failed", None, None),
    ("idle_flat_no_runway", "codex.5h", "codex", 40.0, 18_000, 9_000, "normal", [(-100, 40.0), (-50, 40.0), (0, 40.0)], "normal", -10.0, None),
    ("insufficient_samples_no_runway", "codex.5h", "codex", 40.0, 18_000, 9_000, "normal", [(-50, 38.0), (0, 40.0)], "normal", -10.0, None),
]


def test_golden_cases(spark):
    """All thirteen cases as scopes of one frame."""
    rows = []
    for name, limit, provider, util, window, left, status, samples, *_ in GOLDEN:
        for t, u in samples or [(0, util)]:
            rows.append(reading(NOW + t, u, limit, status, provider, window, NOW + left if left else 0, name))
    got = {r["scope"]: r for r in quota_snapshot(make(spark, rows), NOW).collect()}
    for name, limit, *_, status, deficit, runway in GOLDEN:
        r = got[name]
        assert r["status"] == status, name
        assert r["worst_id"] == limit
        if deficit is None:
            assert r["pace"] is None, name
        else:
            assert r["pace"]["deficit"] == pytest.approx(deficit, abs=0.05), name
            assert r["pace"]["in_deficit"] is (deficit > 1.0), name
            assert r["pace"]["pace_basis"] == "linear"
        assert (r["runway_secs"] is None) if runway is None else abs(r["runway_secs"] - runway) <= 1, name


def test_golden_picks(spark):
    rows = [
        reading(1, 20, "codex.5h"), reading(2, 50, "codex.week"),
        reading(3, 80, "codex.5h", pos=0), reading(3, 100, "codex.week", pos=1),
        reading(4, 60, "codex.5h", pos=0), reading(4, 100, "codex.week", pos=1),
        reading(5, 0, "codex.5h", "source_failed"), reading(6, 70, "cc.opus", provider="anthropic"),
    ]
    pins = [(1, "codex", "auto"), (2, "codex", "5h"), (3, "codex", "auto"), (4, "codex", "5h"), (5, "codex", "auto"),
            (6, "anthropic", "model:cc.opus"), (6, "anthropic", "nonsense"), (6, "codex", "auto"), (1, "codex", "")]
    frame = spark.createDataFrame([("s", t, p, v) for t, p, v in pins], "scope string, ts long, provider string, pin string")
    got = {(r["ts"], r["provider"], r["pin"]): r["limit_id"] for r in choice.pinned_choice(readings.with_status(make(spark, rows)), frame).collect()}
    assert got == {
        (1, "codex", "auto"): "codex.5h", (2, "codex", "5h"): None, (3, "codex", "auto"): "codex.week", (4, "codex", "5h"): "codex.5h",
        (5, "codex", "auto"): "codex.5h", (6, "anthropic", "model:cc.opus"): "cc.opus", (6, "anthropic", "nonsense"): None,
        (6, "codex", "auto"): None, (1, "codex", ""): "codex.5h",
    }


def runway(spark, samples, **bounds):
    live = readings.live_samples(make(spark, [reading(t, u) for t, u in samples]))
    rows = readings.with_linear_runway(readings.bounded_history(live, **bounds))
    return {r["ts"]: (r["n"], r["front_ts"], r["runway_secs"]) for r in rows.collect()}


def test_sampling_gap_does_not_dilute_the_slope(spark):
    flat = [(NOW + i * 15, 40.0) for i in range(60)]
    wake = NOW + 59 * 15 + 7_200
    burn = [(wake + i * 15, 40.0 + 10.0 * (i / 20.0)) for i in range(21)]
    assert runway(spark, flat + burn)[wake + 300] == (21, wake, 1500)


def test_regular_sampling_number(spark):
    got = runway(spark, [(NOW + i * 15, 40.0 + i * 0.1) for i in range(100)])[NOW + 99 * 15]
    assert got[:2] == (60, NOW + 600) and abs(got[2] - 7515) <= 1


@pytest.mark.parametrize("width", [900, 1_000, 86_400])
def test_history_is_the_same_for_every_chunk_width(spark, width):
    samples = [(NOW + i * 37 + (i * i) % 11, float((i * 7) % 90)) for i in range(200)]
    assert runway(spark, samples, width=width) == runway(spark, samples)


def test_live_samples_keep_the_first_of_a_second(spark):
    rows = [reading(5, 10, pos=1), reading(5, 20, pos=2), reading(6, 30, status="stale"), reading(7, 0, status="source_failed")]
    assert [(r["ts"], r["util"]) for r in readings.live_samples(make(spark, rows)).collect()] == [(5, 10.0)]


def test_window_names(spark):
    df = spark.createDataFrame([(m,) for m in (60, 250, 300, 361, 1440, 9000, 10080, 43200)], "m long")
    got = [tuple(r["w"]) for r in df.select(q.window_name("m").alias("w")).collect()]
    assert got == [
        ("codex.min60", "Codex·1h"), ("codex.5h", "Codex·5h"), ("codex.5h", "Codex·5h"), ("codex.min361", "Codex·6h"),
        ("codex.min1440", "Codex·1d"), ("codex.week", "Codex·Weekly"), ("codex.week", "Codex·Weekly"), ("codex.min43200", "Codex·30d"),
    ]


def rate_line(*windows, **extra):
    slots = {f"k{i}": {"used_percent": u, "window_minutes": m, "resets_at": r} for i, (u, m, r) in enumerate(windows)}
    return json.dumps({"foo": 1, "rate_limits": {"limit_id": "x", **slots, "credits": None, "plan_type": "plus", **extra}}).replace('": ', '":')


def latest(spark, files, now=NOW):
    frame = None
    for path, (mtime, texts) in files.items():
        part = lines(spark, "codex", {path: texts}, mtime=mtime)
        frame = part if frame is None else frame.unionByName(part)
    rows = sources.latest_rate_limits(frame, now).orderBy("position").collect()
    return [(r["limit_id"], r["util"], r["resets_at"], r["status"]) for r in rows]


def test_window_in_the_seventh_newest_file_is_found(spark):
    files = {f"/f{k}": (NOW - k, ["{}"]) for k in range(6)} | {"/f6": (NOW - 6, [rate_line((12.0, 300, NOW + 50))]), "/f7": (NOW - 7, [rate_line((99.0, 300, NOW + 50))])}
    assert [r[1] for r in latest(spark, files)] == [12.0]
    frame = lines(spark, "codex", {"/f": ["{}"]}, mtime=NOW).unionByName(lines(spark, "codex", {"/g": [rate_line((12.0, 300, NOW + 50))]}, mtime=NOW - 1))
    assert sources.latest_rate_limits(frame, NOW, 1).count() == 0


def test_rate_limits_expired_stale_fresh(spark):
    def one(reset, age):
        return latest(spark, {"/a": (NOW - age, [rate_line((12.0, 300, NOW + reset))])})

    assert one(-3_600, 6 * 86_400) == [("codex.5h", 0.0, 0, "idle")]
    assert one(-3_600, 60) == [("codex.5h", 0.0, 0, "normal")]
    assert one(3_600, 1_800) == [("codex.5h", 12.0, NOW + 3_600, "stale")]
    assert one(3_600, 60) == [("codex.5h", 12.0, NOW + 3_600, "normal")]


def test_rate_limits_choice_of_file_and_line(spark):
    reset = NOW + 3_600
    old, new = rate_line((1.0, 300, reset)), rate_line((40.0, 300, reset), (3.0, 10_080, reset), (9.0, 310, reset))
    assert latest(spark, {"/a": (NOW, [old, new, "{}"])}) == [("codex.5h", 40.0, reset, "normal"), ("codex.week", 3.0, reset, "normal")]
    no_window = json.dumps({"rate_limits": {"credits": 1}}).replace('": ', '":')
    assert latest(spark, {"/a": (NOW, [no_window]), "/b": (NOW - 5, [old])}) == [("codex.5h", 1.0, reset, "normal")]
    six = {f"/{i}": (NOW - i, ["{}"]) for i in range(5)}
    assert latest(spark, {**six, "/z": (NOW - 9, [old])}) == [("codex.5h", 1.0, reset, "normal")]
    assert latest(spark, {"/a": (NOW, [rate_line((3.0, 10_080, reset), other={"used_percent": 1.0})])}) == [("codex.week", 3.0, reset, "normal")]


def usage_rows(spark, *payloads):
    df = spark.createDataFrame([("s", i, json.dumps(p)) for i, p in enumerate(payloads)], "scope string, observed_at long, payload string")
    return [(r["ts"], r["limit_id"], r["label"], r["util"], r["resets_at"], r["window_secs"], r["used"], r["cap"]) for r in sources.parse_usage_payload(df).orderBy("ts", "position").collect()]


def test_usage_payload_shapes(spark):
    at = "2026-07-10T06:19:59+00:00"
    five = {"utilization": 25.0, "resets_at": at}
    modern = {
        "five_hour": five,
        "limits": [
            {"kind": "session", "group": "session", "percent": 25, "resets_at": at, "scope": None},
            {"kind": "weekly_scoped", "group": "weekly", "percent": 5, "resets_at": at, "scope": {"model": {"id": None, "display_name": "Fable"}}},
            {"kind": "weekly_scoped", "group": "weekly", "percent": 18, "scope": {"model": {"display_name": "Opus"}}},
            {"kind": "new_kind", "group": "daily", "percent": 1},
            {"kind": "weekly_scoped", "group": "weekly"}, {"group": "weekly", "percent": 7},
        ],
        "extra_usage": {"is_enabled": False, "monthly_limit": 2000, "used_credits": 0.0},
    }
    legacy = {"limits": [], "five_hour": five, "seven_day": {"utilization": 41.0}, "seven_day_opus": None,
              "extra_usage": {"is_enabled": True, "monthly_limit": 200, "used_credits": 50.5}}
    epoch = 1_783_664_399
    assert usage_rows(spark, modern, legacy, {"limits": []}) == [
        (0, "cc.5h", "Claude·5h", 25.0, epoch, 18_000, None, None),
        (0, "cc.w.fable", "Claude·Fable", 5.0, epoch, 604_800, None, None),
        (0, "cc.opus", "Claude·Opus", 18.0, 0, 604_800, None, None),
        (0, "cc.newkind", "Claude·new_kind", 1.0, 0, 0, None, None),
        (1, "cc.5h", "Claude·5h", 25.0, epoch, 18_000, None, None),
        (1, "cc.week", "Claude·Weekly", 41.0, 0, 604_800, None, None),
        (1, "cc.extra", "Claude·Credits", 25.25, 0, 2_592_000, 50, 200),
    ]


def test_live_payload(spark):
    good = {"rate_limit": {"primary_window": {"used_percent": 4.0, "limit_window_seconds": 18_000, "reset_at": 9}, "x": None,
                           "weekly": {"used_percent": 7, "limit_window_seconds": 604_800, "reset_at": 8}}}
    df = spark.createDataFrame([("s", 1, json.dumps(good)), ("s", 2, '{"rate_limit":{"credits":1}}'), ("s", 3, "{}")], "scope string, observed_at long, payload string")
    rows = sources.parse_live_payload(df).orderBy("position").collect()
    assert [(r["ts"], r["limit_id"], r["util"], r["resets_at"]) for r in rows] == [(1, "codex.5h", 4.0, 9), (1, "codex.week", 7.0, 8)]


# ---------------------------------------------------------------- landed history


def landed(spark, rows, width=None):
    frame = spark.createDataFrame([("s", "a", t, float(u), r) for t, u, r in rows], "scope string, limit_id string, ts long, util double, resets_at long")
    marked = history.with_reset_change(frame)
    return marked, history.landed_samples(marked, width=width)


def test_landing_throttle(spark):
    rows = [(0, 10, 1), (100, 10.4, 1), (150, 10.5, 1), (200, 10.6, 1), (449, 10.5, 1), (450, 10.5, 1), (460, 10.5, 2), (470, 10.5, 2)]
    marked, kept = landed(spark, rows)
    assert [r["ts"] for r in kept.orderBy("ts").collect()] == [0, 150, 450, 460]
    assert [(r["ts"], r["resets_at"]) for r in history.reset_points(marked).orderBy("ts").collect()] == [(0, 1), (460, 2)]


def test_landing_is_the_same_for_every_chunk_width(spark):
    rows = [(i * 17 + i % 5, (i * i % 13) * 0.09, i // 150) for i in range(600)]
    want, last = [], None
    for i, (t, u, r) in enumerate(rows):
        if last is None or r != rows[i - 1][2] or t - last[0] >= 300 or abs(u - last[1]) >= 0.5:
            want.append(t)
            last = (t, u)
    for width in (300, 1_000, None):
        assert [r["ts"] for r in landed(spark, rows, width)[1].orderBy("ts").collect()] == want


def test_retention(spark):
    day = 86_400
    samples = spark.createDataFrame([("s", "a", NOW - d * day, 1.0) for d in (40, 34, 20, 10, 3, 1)], "scope string, limit_id string, ts long, util double")
    resets = spark.createDataFrame([("s", "a", NOW - d * day, d) for d in (40, 30, 25, 12, 6, 4, 2)], "scope string, limit_id string, ts long, resets_at long")
    kept, points = history.retain(samples, resets, NOW)
    assert sorted(NOW - r["ts"] for r in kept.collect()) == [1 * day, 3 * day, 10 * day, 20 * day]
    assert sorted(r["resets_at"] for r in points.collect()) == [2, 4, 6, 12, 25]
    few = resets.filter("resets_at < 12")
    assert history.retain(samples, few, NOW)[0].count() == 5


def cycles_of(spark, samples, resets, window=1_000):
    s = spark.createDataFrame([("s", "a", t, float(u)) for t, u in samples], "scope string, limit_id string, ts long, util double")
    r = spark.createDataFrame([("s", "a", t, v) for t, v in resets], "scope string, limit_id string, ts long, resets_at long")
    w = spark.createDataFrame([("s", "a", window)], "scope string, limit_id string, window_secs long")
    return limit_cycle_curves(s, r, w)


def test_cycle_split_drops_the_runt(spark):
    samples = [(k * 100, k * 10.0) for k in range(11)] + [(1100 + k * 100, k * 10.0) for k in range(10)] + [(2100 + k * 100, k * 5.0) for k in range(3)]
    got = cycles_of(spark, samples, [(0, 5000), (1100, 6000), (2100, 7000)]).orderBy("cycle_id").collect()
    assert [(r["cycle_id"], r["hit_locked"]) for r in got] == [(0, True), (1, False)]
    assert got[0]["curve"][0] == 0.0 and got[0]["curve"][47] == 100.0 and got[0]["curve"][24] == pytest.approx(100 * 24 / 47)
    assert got[1]["curve"][47] == 90.0  # flat beyond the last sample


def test_cycle_split_by_drop_without_reset(spark):
    samples = [(0, 0), (500, 50), (900, 60), (1000, 4), (1500, 10), (1900, 30)]
    got = cycles_of(spark, samples, [(0, 5)]).orderBy("cycle_id").collect()
    assert [(r["cycle_start"], r["cycle_end"], r["n"]) for r in got] == [(0, 900, 3), (1000, 1900, 3)]
    assert cycles_of(spark, [(0, 10), (900, 21), (1000, 5)], [(0, 5)]).count() == 1


def curves(spark, *rows):
    data = [("s", "a", i, c, h) for i, (c, h) in enumerate(rows)]
    return spark.createDataFrame(data, "scope string, limit_id string, cycle_id long, curve array<double>, hit_locked boolean")


def flat(u, hit=False):
    return [float(u)] * 48, hit


def ramp(lo, hi):
    return [lo + (hi - lo) * i / 47 for i in range(48)], hi >= 100


def projected(spark, cycle_rows, util, linear, t=0.5, window=1_000):
    now = spark.createDataFrame([("s", "a", float(util), t, window, linear)], "scope string, limit_id string, util double, progress double, window_secs long, linear_secs long")
    return projection.project(now, curves(spark, *cycle_rows)).first()


def test_median_and_probability(spark):
    one = projected(spark, [flat(40), flat(60)], 50, None)
    assert one["expected_util"] == pytest.approx(50.0)
    assert projected(spark, [ramp(0, 80), ramp(0, 100)], 20, None)["expected_util"] == pytest.approx(45, abs=0.5)
    assert projected(spark, [flat(1), flat(9), flat(5)], 20, None)["expected_util"] == pytest.approx(5)
    assert projected(spark, [flat(50, h) for h in (True, False, True, False)], 50, None)["run_out_probability"] == 0.5


def test_projection_switch(spark):
    single = projected(spark, [ramp(0, 100)], 80, 100)
    assert (single["pace_basis"], single["runway_secs"], single["run_out_probability"]) == ("linear", 100, None)
    both = projected(spark, [ramp(0, 100), ramp(0, 100)], 50, None)
    assert both["pace_basis"] == "historical" and abs(both["runway_secs"] - 500) <= 5 and both["run_out_probability"] == 1.0
    short = projected(spark, [flat(60), flat(60)], 50, 500)
    assert (short["pace_basis"], short["runway_secs"], short["run_out_probability"]) == ("linear", 500, 0.0)
    assert projected(spark, [ramp(0, 100), ramp(0, 100)], 50, 7, t=None)["pace_basis"] == "linear"
    assert projected(spark, [flat(60), flat(60)], 100, 7)["runway_secs"] == 0


def _plain_runway(curves, t, util, window, steps=240, buckets=48):
    """Every step tried in turn."""
    def median(x):
        x = min(max(x, 0.0), 1.0) * (buckets - 1)
        i = int(x)
        at = sorted(c[-1] if i >= buckets - 1 else c[i] * (1 - (x - i)) + c[i + 1] * (x - i) for c in curves)
        half = len(at) // 2
        return at[half] if len(at) % 2 else (at[half - 1] + at[half]) / 2

    if util >= 100:
        return 0
    ahead = ((1.0 - t) * (i / float(steps)) for i in range(1, steps + 1))
    return next((int(a * window) for a in ahead if util + (median(min(t + a, 1.0)) - median(t)) >= 100.0), None)


def test_runway_by_pieces_of_the_median_equals_every_step(spark):
    """Rising, falling, flat and crossing curves; whole numbers make the line touch 100 exactly."""
    rng, rows, readings_ = random.Random(4), [], []
    for limit in range(60):
        curves = []
        for _ in range(limit % 7 + 1):
            kind, c = rng.randrange(4), []
            for b in range(48):
                c.append({0: lambda: 2.0 * b, 1: lambda: rng.uniform(0, 100), 2: lambda: float(rng.randrange(0, 100, 10)),
                          3: lambda: min(100.0, float(b // 6 * 25))}[kind]())
            curves.append(sorted(c) if rng.random() < 0.5 else c)
        rows += [("s", str(limit), k, c, False) for k, c in enumerate(curves)]
        for k in range(12):
            t = rng.choice([0.0, 0.5, 1.0, rng.randrange(48) / 47, rng.random()])
            util = rng.choice([0.0, 30.0, 75.0, 100.0, float(rng.randrange(100)), rng.uniform(0, 100)])
            readings_.append(("s", str(limit), k, t, util, 18_000, _plain_runway(curves, t, util, 18_000)))
    curves = spark.createDataFrame(rows, "scope string, limit_id string, cycle_id long, curve array<double>, hit_locked boolean")
    told = spark.createDataFrame(readings_, "scope string, limit_id string, k int, t double, util double, window long, want long")
    joined = told.join(projection.limit_curves(curves), ["scope", "limit_id"])
    got = joined.select("*", projection.historical_runway(F.col("curves"), F.col("pieces"), F.col("t"), F.col("util"), F.col("window")).alias("got"))
    seen = got.select("limit_id", "k", "want", "got").collect()
    assert len(seen) == 720 and [r for r in seen if r["want"] != r["got"]] == []
    assert 100 < sum(r["want"] is not None for r in seen) < 700


def test_snapshot_uses_the_landed_history(spark):
    """Two full five-hour ramps, then half of a third: the projection turns historical."""
    window, step = 18_000, 600
    rows, start = [], NOW - 2 * window - window // 2
    for cycle in range(3):
        begin = start + cycle * window
        for i in range(31 if cycle < 2 else 16):
            t = begin + i * step - (1 if i == 30 else 0)
            rows.append(reading(t, min(100.0, i / 30 * 100), window=window, resets=begin + window))
    samples, resets = limit_history(readings.live_samples(make(spark, rows)), NOW)
    assert resets.count() == 3 and samples.count() > 70
    r = quota_snapshot(make(spark, rows), NOW).first()
    assert r["pace"]["pace_basis"] == "historical" and r["pace"]["run_out_probability"] == 1.0
    assert abs(r["runway_secs"] - 9_000) <= 150 and r["ts"] == NOW

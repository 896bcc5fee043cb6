"""Which readings to believe and which limit to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.config import CHUNK_SECS, DWELL_SECS, HYSTERESIS_PCT
from meterloom.functions.quota import GAUGE_STATES, UNKNOWN_STATUSES, gauge_state, percent_left
from meterloom.operators.folds import StickyWorst, run_fold
from meterloom.operators.ordered import carry_scan, time_chunk

SNAPSHOT = ["scope", "ts"]

# Placeholder limits of a failed source: id, label, window seconds.
CODEX_PLACEHOLDERS = [("codex.5h", "Codex·5h", 18_000), ("codex.week", "Codex·Weekly", 604_800)]
CLAUDE_PLACEHOLDERS = [("cc.5h", "Claude·5h", 18_000), ("cc.week", "Claude·Weekly", 18_000)]

# Failures that only a new login can mend.
LOGIN_FAILURES = [
    "credentials_file", "credentials_shape", "refresh_disabled",
    "refresh_http_401", "refresh_http_403", "usage_http_401", "usage_http_403",
]

LIMIT_FIELDS = "limit_id string, label string, util double, resets_at bigint, window_secs bigint, used bigint, cap bigint"
_LIMITS = "array<struct<limit_id:string,label:string,util:double,resets_at:bigint,window_secs:bigint,used:bigint,cap:bigint>>"


def _placeholders(rows: list[tuple[str, str, int]]) -> Column:
    none = F.lit(None).cast("bigint")
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("limit_id"), F.lit(label).alias("label"), F.lit(0.0).alias("util"),
                F.lit(0).cast("bigint").alias("resets_at"), F.lit(secs).cast("bigint").alias("window_secs"),
                none.alias("used"), none.alias("cap"),
            )
            for name, label, secs in rows
        ]
    )


def choose_source(live: DataFrame, local: DataFrame, modes: DataFrame) -> DataFrame:
    """Readings per scope by mode: ``local``; ``auto`` = live, else local; otherwise live, else
    placeholder rows marked failed.  ``modes`` has one row (scope, mode, ts) per scope."""
    has_live = live.select("scope").distinct().withColumn("_live", F.lit(True))
    plan = modes.join(has_live, "scope", "left").select(
        "scope", "ts",
        F.when(F.col("mode") == "local", "local")
        .when(F.col("_live"), "live")
        .when(F.col("mode") == "auto", "local")
        .otherwise("failed")
        .alias("_use"),
    )
    tagged = live.withColumn("_from", F.lit("live")).unionByName(
        local.withColumn("_from", F.lit("local")), allowMissingColumns=True
    )
    chosen = tagged.join(plan.select("scope", "_use"), "scope").filter(F.col("_from") == F.col("_use"))
    failed = plan.filter(F.col("_use") == "failed").select(
        "scope", "ts", F.posexplode(_placeholders(CODEX_PLACEHOLDERS)).alias("position", "l")
    )
    failed = failed.select(
        "scope", "ts", F.col("position").cast("bigint").alias("position"), "l.limit_id",
        F.lit("codex").alias("provider"), "l.label", "l.util", "l.resets_at", "l.window_secs",
        F.lit("source_failed").alias("status"),
    )
    return chosen.drop("_from", "_use").unionByName(failed, allowMissingColumns=True)


def last_known_good(responses: DataFrame, width: int = CHUNK_SECS) -> DataFrame:
    """Readings to show for each response (``scope, ts, limits, failure``).

    Success shows its limits.  A login failure shows failed placeholders with an action.  Any
    other failure shows the last good limits marked stale, or failed placeholders before the
    first success.  A response without failure but also without limits failed by shape.
    """
    empty = F.coalesce(F.size("limits"), F.lit(0)) <= 0
    failure = F.coalesce("failure", F.when(empty, "usage_shape"))
    rows = responses.select(
        "scope", "ts", time_chunk("ts", width).alias("_chunk"), failure.alias("failure"),
        F.when(failure.isNull(), F.col("limits").cast(_LIMITS)).alias("good"),
    )
    scanned = carry_scan(rows, ["scope"], ["_chunk"], ["ts"], last={"known": "good"})
    login = F.coalesce(F.col("failure").isin(LOGIN_FAILURES), F.lit(False))
    ok = F.col("failure").isNull()
    reuse = ~login & F.col("known").isNotNull()
    shown = scanned.select(
        "scope", "ts",
        F.when(ok, "normal").when(reuse, "stale").otherwise("source_failed").alias("status"),
        F.when(~ok & ~reuse, F.col("failure")).alias("hint"),
        F.when(login, "relogin").alias("action"),
        F.posexplode(
            F.when(ok | reuse, F.col("known")).otherwise(_placeholders(CLAUDE_PLACEHOLDERS))
        ).alias("position", "l"),
    )
    return shown.select(
        "scope", "ts", F.col("position").cast("bigint").alias("position"), "l.limit_id",
        F.lit("anthropic").alias("provider"), "l.label", "l.util", "l.resets_at", "l.window_secs",
        "status", "l.used", "l.cap", "hint", "action",
    )


def snapshots(readings: DataFrame) -> DataFrame:
    """One row per (scope, ts) with the limits in display order as parallel lists."""
    members = F.array_sort(F.collect_list(F.struct("position", "limit_id", "util")))
    packed = readings.groupBy(*SNAPSHOT).agg(members.alias("m"))
    return packed.select(
        *SNAPSHOT,
        F.transform("m", lambda x: x["limit_id"]).alias("ids"),
        F.transform("m", lambda x: x["util"]).alias("utils"),
    )


def sticky_worst(
    readings: DataFrame, margin: float = HYSTERESIS_PCT, dwell: int = DWELL_SECS, width: int | None = None
) -> DataFrame:
    """Limit to show at each snapshot, with hysteresis against flicker."""
    return run_fold(
        snapshots(readings), ["scope"], StickyWorst(margin, dwell), width=width, out="worst_id", out_type="string"
    )


def _rank(status: Column) -> Column:
    return F.when(status == "locked", 2).when(status == "near", 1).otherwise(0)


def worst_per_provider(readings: DataFrame) -> DataFrame:
    """Locked before near before the rest, then utilisation; the first of equals."""
    order = F.struct(_rank(F.col("status")), "util", -F.col("position"))
    rest = [c for c in readings.columns if c not in (*SNAPSHOT, "provider")]
    return readings.groupBy(*SNAPSHOT, "provider").agg(
        F.max_by(F.struct(*rest), order).alias("w")
    ).select(*SNAPSHOT, "provider", "w.*")


def pinned_choice(readings: DataFrame, pins: DataFrame) -> DataFrame:
    """Limit per pin row (``scope, ts, provider, pin``): ``auto`` takes the worst, ``5h`` and
    ``week`` that window, ``model:<id>`` that limit.  Missing data gives NULL, never another limit."""
    prefix = F.when(F.col("provider") == "anthropic", "cc.").when(F.col("provider") == "codex", "codex.")
    wanted = (
        F.when(F.col("pin").isin("5h", "week"), F.concat(prefix, "pin"))
        .when(F.col("pin").startswith("model:"), F.expr("substring(pin, 7)"))
    )
    target = pins.withColumn("_want", wanted)
    order = F.struct(_rank(F.col("status")), "util", -F.col("position"))
    joined = target.join(readings.drop("label"), [*SNAPSHOT, "provider"], "left")
    auto = (F.coalesce("pin", F.lit("")) == "") | (F.col("pin") == "auto")
    return joined.groupBy(*SNAPSHOT, "provider", "pin").agg(
        F.max_by(F.when(auto, F.col("limit_id")), order).alias("_auto"),
        F.min_by(
            "limit_id", F.when(F.col("limit_id") == F.col("_want"), F.col("position"))
        ).alias("_exact"),
    ).select(*SNAPSHOT, "provider", "pin", F.coalesce("_auto", "_exact").alias("limit_id"))


def quota_board(readings: DataFrame, now: str = "ts") -> DataFrame:
    """Per limit: percent left, gauge state, badge, seconds to reset; and its provider's state.

    The window spans one snapshot of one provider: a handful of limits.
    """
    states = F.array(*[F.lit(s) for s in GAUGE_STATES])
    state = gauge_state()
    worst = F.min(F.array_position(states, state)).over(Window.partitionBy(*SNAPSHOT, "provider"))
    badge = (
        F.when(F.col("status") == "source_failed", "unavailable")
        .when(F.col("status").isin(UNKNOWN_STATUSES), "estimate")
        .when(F.col("status") == "stale", "stale")
    )
    left = F.col("resets_at") - F.col(now)
    return readings.select(
        *SNAPSHOT, "provider", "position", "limit_id", "status",
        percent_left().alias("percent_left"),
        state.alias("gauge_state"),
        badge.alias("badge"),
        F.when(F.col("resets_at") > 0, F.greatest(left, F.lit(0))).alias("reset_in_secs"),
        F.element_at(states, worst.cast("int")).alias("provider_state"),
    )


# Rows of a statement's gauge, in order.
GAUGE_ROWS = [("anthropic", ".5h"), ("anthropic", ".week"), ("codex", ".week")]


def quota_gauge(readings: DataFrame) -> DataFrame:
    """Used percent of the three gauge windows that exist, in their fixed order."""
    pos = F.lit(None).cast("int")
    for i, (provider, suffix) in reversed(list(enumerate(GAUGE_ROWS, 1))):
        pos = F.when((F.col("provider") == provider) & F.col("limit_id").endswith(suffix), i).otherwise(pos)
    rows = readings.withColumn("gauge_pos", pos).filter(F.col("gauge_pos").isNotNull())
    return rows.groupBy(*SNAPSHOT, "gauge_pos").agg(
        F.min_by(F.struct("provider", "limit_id", "util"), "position").alias("r")
    ).select(*SNAPSHOT, "gauge_pos", "r.*")

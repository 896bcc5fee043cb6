"""Registered queries: quota sources, projection, choice, alerts, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions import quota as q
from meterloom.functions.clock import local_timestamp
from meterloom.operators import alerts, choice, history, projection, readings
from meterloom.operators import usage as A
from meterloom.operators.counters import USAGE_COLUMNS
from meterloom.plans.landed import merge_quota_history
from meterloom.plans.snapshot import quota_snapshot
from meterloom.registry import adapters as T
from meterloom.registry.adapters import EVENTS_SQL, NOW
from meterloom.sources import quota as sources
from meterloom.sources.batches import drop_merged
from meterloom.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# One limit per user: five-day windows on a fixed grid, utilisation = value capped at 100.
# Events of a user lie hours apart, hence wide look-backs.
WINDOW = 432_000
LOOKBACK = 90_000
LANDING = 43_200
SUPPRESS = 200_000
HOUR = 3_600

READ_SQL = EVENTS_SQL + f""",
rd AS (SELECT scope, ts, event_id AS position, 'u' || CAST(user_id AS VARCHAR) AS limit_id,
  CASE WHEN user_id % 2 = 0 THEN 'anthropic' ELSE 'codex' END AS provider, least(value, 100) AS util,
  (ts // {WINDOW} + 1) * {WINDOW} AS resets_at, {WINDOW} AS window_secs,
  CASE event_type WHEN 'error' THEN 'source_failed' WHEN 'signup' THEN 'stale' ELSE 'normal' END AS status FROM ev),
lv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, limit_id, ts ORDER BY position) AS dup FROM rd WHERE status = 'normal') WHERE dup = 1),
sm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, limit_id, ts ORDER BY position) AS dup FROM rd) WHERE dup = 1)"""


def r(select: str) -> str:
    return f"WITH RECURSIVE {READ_SQL} {select}"


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return T.events(spark, sf_dir).select(
        "scope", "ts", F.col("event_id").alias("position"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("limit_id"),
        F.when(F.col("user_id") % 2 == 0, "anthropic").otherwise("codex").alias("provider"),
        F.concat(F.lit("Limit "), F.col("user_id").cast("string")).alias("label"),
        F.least("value", F.lit(100.0)).alias("util"),
        ((F.floor(ts / WINDOW) + 1) * WINDOW).cast("bigint").alias("resets_at"),
        F.lit(WINDOW).cast("bigint").alias("window_secs"),
        F.when(F.col("event_type") == "error", "source_failed")
        .when(F.col("event_type") == "signup", "stale").otherwise("normal").alias("status"),
    )


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading as a live sample."""
    return readings.live_samples(_readings(spark, sf_dir).withColumn("status", F.lit("normal")))


def _minus1(*names: str) -> list[Column]:
    return [F.coalesce(n, F.lit(-1)).alias(n) for n in names]


# ---------------------------------------------------------------- sources


def _rate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a Codex line with two windows; the file's time is that of its scope's hour."""
    reset = F.col("ts") + F.col("event_id") % 7 * 1000 - 1000
    short = F.struct(F.col("value").alias("used_percent"), F.lit(300).alias("window_minutes"), reset.alias("resets_at"))
    week = F.struct(F.col("value").alias("used_percent"), F.lit(10080).alias("window_minutes"), (F.col("ts") + 600_000).alias("resets_at"))
    limits = F.struct(F.lit("pro").alias("plan_type"), week.alias("main"), short.alias("other"))
    text = F.to_json(F.struct(F.lit("event").alias("type"), limits.alias("rate_limits")))
    return T.as_lines(T.events(spark, sf_dir), "codex", text)


@query(
    "s8_latest_rate_limits",
    f"""WITH {EVENTS_SQL}, f AS (SELECT scope, project, user_id, MAX(event_id) AS last_id FROM ev GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY '/logs/' || project || '/s' || CAST(user_id AS VARCHAR) || '.jsonl') AS n FROM f)
      SELECT scope, limit_id, status, round(util, 6) AS util, resets_at FROM (
        SELECT k.scope, 'codex.5h' AS limit_id, 'normal' AS status,
          CASE WHEN ev.ts + ev.event_id % 7 * 1000 - 1000 <= {NOW} THEN 0 ELSE value END AS util,
          CASE WHEN ev.ts + ev.event_id % 7 * 1000 - 1000 <= {NOW} THEN 0 ELSE ev.ts + ev.event_id % 7 * 1000 - 1000 END AS resets_at
          FROM k JOIN ev ON ev.event_id = last_id WHERE n = 1
        UNION ALL SELECT k.scope, 'codex.week', 'normal', CASE WHEN ev.ts + 600000 <= {NOW} THEN 0 ELSE value END,
          CASE WHEN ev.ts + 600000 <= {NOW} THEN 0 ELSE ev.ts + 600000 END FROM k JOIN ev ON ev.event_id = last_id WHERE n = 1)""",
)
def _(spark, sf_dir):
    """All files share one time, so the first path is the newest file."""
    found = sources.latest_rate_limits(_rate_lines(spark, sf_dir), NOW)
    return found.select("scope", "limit_id", "status", F.round("util", 6).alias("util"), "resets_at")


@query(
    "s8_rate_limits_of_older_files",
    f"""WITH {EVENTS_SQL}, f AS (SELECT scope, user_id, MAX(event_id) AS last_id FROM ev WHERE user_id % 8 = 7 GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY user_id) AS n FROM f)
      SELECT k.scope, 'codex.week' AS limit_id, CASE WHEN ev.ts + 600000 <= {NOW} THEN 0 ELSE value END AS util,
        CASE WHEN ev.ts + 600000 <= {NOW} THEN 0 ELSE ev.ts + 600000 END AS resets_at FROM k JOIN ev ON ev.event_id = last_id WHERE n = 1""",
)
def _(spark, sf_dir):
    """Files grow older with the user's number, and only every eighth user's file has a window."""
    user = F.regexp_extract("file_path", r"/s(\d+)\.jsonl", 1).cast("bigint")
    lines = _rate_lines(spark, sf_dir).withColumn("file_mtime", NOW - user).withColumn("value", F.when(user % 8 == 7, F.col("value")).otherwise("{}"))
    found = sources.latest_rate_limits(lines, NOW).filter("limit_id = 'codex.week'")
    return found.select("scope", "limit_id", F.round("util", 6).alias("util"), "resets_at")


@query(
    "s9_discover_windows",
    f"""WITH {EVENTS_SQL} SELECT event_id, 'main' AS slot, value AS used_percent, 10080::BIGINT AS window_minutes, ts + 600000 AS resets_at FROM ev
      UNION ALL SELECT event_id, 'other', value, 300, ts + event_id % 7 * 1000 - 1000 FROM ev""",
)
def _(spark, sf_dir):
    lines = _rate_lines(spark, sf_dir).select(
        F.col("line_seq").alias("event_id"), F.substring_index("value", sources.RATE_KEY, -1).alias("rl")
    )
    return sources.explode_windows(lines, "rl").drop("rl")


@query(
    "s10_usage_payload",
    f"""WITH {EVENTS_SQL} SELECT scope, ts, 'cc.5h' AS limit_id, 'Claude·5h' AS label, round(value, 6) AS util, ts + 3600 AS resets_at, 18000::BIGINT AS window_secs FROM ev WHERE event_type <> 'error'
      UNION ALL SELECT scope, ts, 'cc.w.fable', 'Claude·Fable', round(value / 2, 6), 0, 604800 FROM ev WHERE event_type <> 'error'
      UNION ALL SELECT scope, ts, 'cc.5h', 'Claude·5h', round(value, 6), ts + 3600, 18000 FROM ev WHERE event_type = 'error'
      UNION ALL SELECT scope, ts, 'cc.extra', 'Claude·Credits', round(value / 2000 * 100, 6), 0, 2592000 FROM ev WHERE event_type = 'purchase'""",
)
def _(spark, sf_dir):
    """Every event as a response; ``error`` events in the older shape, ``purchase`` with credits."""
    stamp = T.stamp_of(local_timestamp(F.col("ts") + 3600, "UTC"), "+00:00")
    rows = T.events(spark, sf_dir)
    none = F.lit(None).cast("string")

    def entry(kind: str, group: str, percent: Column, reset: Column, model: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(group).alias("group"), percent.alias("percent"), reset.alias("resets_at"),
            F.struct(F.struct(model.alias("display_name")).alias("model")).alias("scope"),
        )

    array = F.array(
        entry("session", "session", F.col("value"), stamp, none),
        entry("weekly_scoped", "weekly", F.col("value") / 2, none, F.lit("Fable")),
        entry("", "weekly", F.col("value"), none, none),
    )
    modern = F.when(F.col("event_type") != "error", array)
    older = F.struct(F.col("value").alias("utilization"), stamp.alias("resets_at"))
    extra = F.struct(
        (F.col("event_type") == "purchase").alias("is_enabled"), F.lit(2000).alias("monthly_limit"), F.col("value").alias("used_credits")
    )
    body = F.to_json(F.struct(modern.alias("limits"), older.alias("five_hour"), extra.alias("extra_usage")))
    parsed = sources.parse_usage_payload(rows.select("scope", F.col("ts").alias("observed_at"), body.alias("payload")))
    return parsed.select("scope", "ts", "limit_id", "label", F.round("util", 6).alias("util"), "resets_at", "window_secs")


@query(
    "s11_live_payload",
    f"""WITH {EVENTS_SQL}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, user_id, ts ORDER BY event_id) AS n FROM ev) WHERE n = 1)
      SELECT scope || '/' || CAST(user_id AS VARCHAR) AS scope, ts, 'codex.5h' AS limit_id, value AS util, ts + 100 AS resets_at, 18000::BIGINT AS window_secs FROM one
      UNION ALL SELECT scope || '/' || CAST(user_id AS VARCHAR), ts, 'codex.min60', value, ts + 300, 3600 FROM one""",
)
def _(spark, sf_dir):
    """Three windows per response, two of them with one id: the shorter one stays."""
    def window(secs: int, after: int) -> Column:
        return F.struct(F.col("value").alias("used_percent"), F.lit(secs).alias("limit_window_seconds"), (F.col("ts") + after).alias("reset_at"))

    limit = F.struct(window(19_800, 200).alias("secondary_window"), window(18_000, 100).alias("primary_window"), window(3_600, 300).alias("hourly"), F.lit(1).alias("credits"))
    rows = readings_dedup(T.events(spark, sf_dir))
    body = rows.select(
        F.concat("scope", F.lit("/"), F.col("user_id").cast("string")).alias("scope"),
        F.col("ts").alias("observed_at"), F.to_json(F.struct(limit.alias("rate_limit"))).alias("payload"),
    )
    return sources.parse_live_payload(body).select("scope", "ts", "limit_id", "util", "resets_at", "window_secs")


def readings_dedup(events: DataFrame) -> DataFrame:
    from meterloom.operators.ordered import first_of

    return first_of(events, ["scope", "user_id", "ts"], ["event_id"])


LAND_SQL = f""",
o AS (SELECT *, row_number() OVER (PARTITION BY scope, limit_id ORDER BY ts) AS n,
  lag(resets_at) OVER (PARTITION BY scope, limit_id ORDER BY ts) IS DISTINCT FROM resets_at AS forced FROM sm),
fold AS (
  SELECT scope, limit_id, n, ts, util, TRUE AS kept, ts AS kts, util AS kutil FROM o WHERE n = 1
  UNION ALL
  SELECT o.scope, o.limit_id, o.n, o.ts, o.util, d.due, CASE WHEN d.due THEN o.ts ELSE f.kts END, CASE WHEN d.due THEN o.util ELSE f.kutil END
  FROM fold f JOIN o ON o.scope = f.scope AND o.limit_id = f.limit_id AND o.n = f.n + 1,
  LATERAL (SELECT o.forced OR o.ts - f.kts >= {LANDING} OR abs(o.util - f.kutil) >= 40 AS due) d),
ld AS (SELECT scope, limit_id, ts, util FROM fold WHERE kept),
rs AS (SELECT scope, limit_id, ts, resets_at FROM o WHERE forced)"""


def _landed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    marked = history.with_reset_change(_samples(spark, sf_dir))
    return history.landed_samples(marked, LANDING, 40.0), history.reset_points(marked)


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The landed history as a written table, which is what cycles are computed from."""
    path = T.scratch(spark)
    sources.write_quota_history(*_landed(spark, sf_dir), path, 0)
    return sources.read_quota_history(spark, path)


@query("s16_quota_history_sink", r(LAND_SQL + " SELECT 'sample' AS kind, limit_id, ts, round(util, 6) AS value FROM ld UNION ALL SELECT 'reset', limit_id, ts, resets_at FROM rs"))
def _(spark, sf_dir):
    samples, resets = _stored(spark, sf_dir)
    return samples.select(F.lit("sample").alias("kind"), "limit_id", "ts", F.round("util", 6).alias("value")).unionByName(
        resets.select(F.lit("reset").alias("kind"), "limit_id", "ts", F.col("resets_at").cast("double").alias("value"))
    )


# ---------------------------------------------------------------- columns


@query("p8_filter_limits", r("SELECT provider, COUNT(*) AS n FROM rd WHERE provider = 'anthropic' GROUP BY provider"))
def _(spark, sf_dir):
    return readings.filter_limits(_readings(spark, sf_dir), ["claude", "grok"]).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p9_window_name",
    f"""WITH {EVENTS_SQL}, m AS (SELECT event_id * 7 % 50000 AS m FROM ev)
      SELECT CASE WHEN m BETWEEN 250 AND 360 THEN 'codex.5h' WHEN m BETWEEN 9000 AND 11000 THEN 'codex.week' ELSE 'codex.min' || CAST(m AS VARCHAR) END AS id,
      CASE WHEN m BETWEEN 250 AND 360 THEN 'Codex·5h' WHEN m BETWEEN 9000 AND 11000 THEN 'Codex·Weekly' WHEN m < 1440 THEN 'Codex·' || CAST(CAST(floor(m / 60 + 0.5) AS BIGINT) AS VARCHAR) || 'h'
      ELSE 'Codex·' || CAST(CAST(floor(m / 1440 + 0.5) AS BIGINT) AS VARCHAR) || 'd' END AS label, COUNT(*) AS n FROM m GROUP BY ALL""",
)
def _(spark, sf_dir):
    rows = T.events(spark, sf_dir).select(q.window_name(F.col("event_id") * 7 % 50_000).alias("w"))
    return rows.groupBy("w.id", "w.label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p10_snapshot_honesty",
    f"""WITH {EVENTS_SQL} SELECT event_id, CASE WHEN ts + 86400 <= 1705363200 THEN 0 ELSE value END AS util,
      CASE WHEN ts + 86400 <= 1705363200 THEN 0 ELSE ts + 86400 END AS resets_at,
      CASE WHEN ts + 86400 <= 1705363200 AND event_id % 2000 > 900 THEN 'idle' WHEN ts + 86400 <= 1705363200 THEN 'normal' WHEN event_id % 2000 > 900 THEN 'stale' ELSE 'normal' END AS status FROM ev""",
)
def _(spark, sf_dir):
    seen = q.honest_reading(F.col("value"), F.col("ts") + 86_400, F.col("event_id") % 2000, F.lit(1_705_363_200))
    return T.events(spark, sf_dir).select("event_id", seen.alias("s")).select("event_id", "s.*")


@query(
    "p11_live_status",
    r("SELECT position, CASE WHEN status <> 'normal' THEN status WHEN util >= 100 THEN 'locked' WHEN util >= 75 THEN 'near' ELSE 'normal' END AS status FROM rd"),
)
def _(spark, sf_dir):
    return readings.with_status(_readings(spark, sf_dir)).select("position", "status")


@query(
    "p12_pace",
    r(f"""SELECT position, round(util - 100 * (ts - resets_at + window_secs) / window_secs, 6) AS deficit, util - 100 * (ts - resets_at + window_secs) / window_secs > 1.0 AS in_deficit
      FROM rd WHERE status = 'normal' AND ts - resets_at + window_secs > 0"""),
)
def _(spark, sf_dir):
    paced = readings.with_pace(_readings(spark, sf_dir)).filter(F.col("pace").isNotNull())
    return paced.select("position", F.round("pace.deficit", 6).alias("deficit"), "pace.in_deficit")


@query("p13_window_progress", r("SELECT position, round((ts - resets_at + window_secs) / window_secs, 9) AS progress FROM rd WHERE status = 'normal' AND ts - resets_at + window_secs > 0"))
def _(spark, sf_dir):
    placed = readings.with_pace(_readings(spark, sf_dir)).filter(F.col("progress").isNotNull())
    return placed.select("position", F.round("progress", 9).alias("progress"))


@query(
    "p14_percent_left",
    r("""SELECT position, CASE WHEN status = 'source_failed' THEN -1 WHEN status = 'normal' AND util >= 100 THEN 0 ELSE CAST(greatest(floor(100 - util + 0.5), 0) AS BIGINT) END AS percent_left FROM rd"""),
)
def _(spark, sf_dir):
    rows = readings.with_status(_readings(spark, sf_dir)).withColumn("percent_left", q.percent_left())
    return rows.select("position", *_minus1("percent_left"))


@query(
    "p15_gauge_state",
    r("""SELECT position, CASE status WHEN 'source_failed' THEN 'degraded' WHEN 'stale' THEN 'stale' ELSE CASE WHEN util >= 100 THEN 'locked' WHEN util >= 75 THEN 'warn' ELSE 'safe' END END AS gauge_state FROM rd"""),
)
def _(spark, sf_dir):
    return readings.with_status(_readings(spark, sf_dir)).select("position", q.gauge_state().alias("gauge_state"))


# ---------------------------------------------------------------- joins


@query(
    "j2_reset_in_force",
    r("""SELECT s.limit_id, s.ts, COALESCE(p.resets_at, 0) AS in_force FROM sm s ASOF LEFT JOIN
      (SELECT scope, limit_id, ts, resets_at + position % 3 AS resets_at FROM sm WHERE status = 'stale') p
      ON s.scope = p.scope AND s.limit_id = p.limit_id AND s.ts >= p.ts"""),
)
def _(spark, sf_dir):
    """Stale readings serve as change points, so every sample looks back a varying distance."""
    one = readings.live_samples(_readings(spark, sf_dir).withColumns({"state": F.col("status"), "status": F.lit("normal")}))
    points = one.filter("state = 'stale'").select("scope", "limit_id", "ts", (F.col("resets_at") + F.col("position") % 3).alias("resets_at"))
    samples = one.select("scope", "limit_id", "ts", "util")
    return history.with_reset_in_force(samples, points).select("limit_id", "ts", "in_force")


@query(
    "j4_choose_source",
    f"""WITH {EVENTS_SQL}, sc AS (SELECT DISTINCT user_id, 's' || CAST(user_id AS VARCHAR) AS scope, CASE user_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'auto' ELSE 'live' END AS mode FROM ev),
      lv AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'click' AND value > 100)
      SELECT 's' || CAST(ev.user_id AS VARCHAR) AS scope, CASE WHEN mode = 'local' OR (mode = 'auto' AND lv.user_id IS NULL) THEN 'local' ELSE 'live' END AS limit_id, event_id AS position, 'normal' AS status
        FROM ev JOIN sc USING (user_id) LEFT JOIN lv USING (user_id)
        WHERE CASE WHEN mode = 'local' OR (mode = 'auto' AND lv.user_id IS NULL) THEN TRUE WHEN lv.user_id IS NULL THEN FALSE ELSE event_type = 'click' AND value > 100 END
      UNION ALL SELECT scope, l, p, 'source_failed' FROM sc LEFT JOIN lv USING (user_id), (VALUES ('codex.5h', 0), ('codex.week', 1)) v(l, p) WHERE mode = 'live' AND lv.user_id IS NULL""",
)
def _(spark, sf_dir):
    """One scope per user; large clicks are its live readings, all events its local ones."""
    rows = T.events(spark, sf_dir).withColumn("scope", F.concat(F.lit("s"), F.col("user_id").cast("string")))

    def as_readings(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "scope", "ts", F.col("event_id").alias("position"), F.lit(name).alias("limit_id"), F.lit("codex").alias("provider"),
            F.lit(name).alias("label"), F.col("value").alias("util"), F.lit(0).cast("bigint").alias("resets_at"),
            F.lit(0).cast("bigint").alias("window_secs"), F.lit("normal").alias("status"),
        )

    pick = F.col("user_id") % 3
    modes = rows.groupBy("scope", "user_id").agg(F.max("ts").alias("ts")).select(
        "scope", "ts", F.when(pick == 0, "local").when(pick == 1, "auto").otherwise("live").alias("mode")
    )
    live_rows = as_readings(rows.filter("event_type = 'click' AND value > 100"), "live")
    chosen = choice.choose_source(live_rows, as_readings(rows, "local"), modes)
    return chosen.select("scope", "limit_id", "position", "status")


@query(
    "j5_last_known_good",
    f"""WITH {EVENTS_SQL}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS n FROM ev) WHERE n = 1),
      k AS (SELECT *, last_value(CASE WHEN event_type NOT IN ('error', 'signup') THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM one)
      SELECT 's' || CAST(user_id AS VARCHAR) AS scope, ts, 'a' AS limit_id, CASE event_type WHEN 'signup' THEN 'stale' ELSE 'normal' END AS status, round(known, 6) AS util, '' AS action FROM k
        WHERE event_type <> 'error' AND known IS NOT NULL
      UNION ALL SELECT 's' || CAST(user_id AS VARCHAR), ts, l, 'source_failed', 0, CASE event_type WHEN 'error' THEN 'relogin' ELSE '' END FROM k, (VALUES ('cc.5h'), ('cc.week')) v(l)
        WHERE event_type = 'error' OR (event_type = 'signup' AND known IS NULL)""",
)
def _(spark, sf_dir):
    """``error`` events are login failures, ``signup`` events transient ones, the rest succeed."""
    rows = readings_dedup(T.events(spark, sf_dir))
    none = F.lit(None).cast("bigint")
    limits = F.array(
        F.struct(
            F.lit("a").alias("limit_id"), F.lit("A").alias("label"), F.col("value").alias("util"),
            F.lit(0).cast("bigint").alias("resets_at"), F.lit(0).cast("bigint").alias("window_secs"), none.alias("used"), none.alias("cap"),
        )
    )
    responses = rows.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("scope"), "ts", limits.alias("limits"),
        F.when(F.col("event_type") == "error", "usage_http_401").when(F.col("event_type") == "signup", "usage_http_429").alias("failure"),
    )
    shown = choice.last_known_good(responses)
    return shown.select("scope", "ts", "limit_id", "status", F.round("util", 6).alias("util"), F.coalesce("action", F.lit("")).alias("action"))


@query("d7_one_window_per_id", f"""WITH {EVENTS_SQL} SELECT user_id, CASE WHEN event_id % 120 + 250 <= 360 THEN 'codex.5h' ELSE 'codex.min' || CAST(event_id % 120 + 250 AS VARCHAR) END AS limit_id,
  MIN(event_id % 120 + 250) AS window_minutes FROM ev GROUP BY ALL""")
def _(spark, sf_dir):
    from meterloom.operators.ordered import first_of

    rows = T.events(spark, sf_dir).withColumn("window_minutes", F.col("event_id") % 120 + 250)
    named = rows.select("user_id", q.window_name("window_minutes")["id"].alias("limit_id"), "window_minutes", "event_id")
    return first_of(named, ["user_id", "limit_id"], ["window_minutes", "event_id"]).drop("event_id")


# ---------------------------------------------------------------- quota series


@query("q1_live_samples", r("SELECT limit_id, ts, round(util, 6) AS util FROM lv"))
def _(spark, sf_dir):
    return readings.live_samples(_readings(spark, sf_dir)).select("limit_id", "ts", F.round("util", 6).alias("util"))


HIST_SQL = f""", h AS (SELECT scope, limit_id, ts, util, resets_at, window_secs,
  least(COUNT(*) OVER t, COUNT(*) OVER w) AS n, greatest(first_value(ts) OVER t, first_value(ts) OVER w) AS front_ts,
  CASE WHEN first_value(ts) OVER t >= first_value(ts) OVER w THEN first_value(util) OVER t ELSE first_value(util) OVER w END AS front_util
  FROM lv WINDOW t AS (PARTITION BY scope, limit_id ORDER BY ts RANGE BETWEEN {LOOKBACK} PRECEDING AND CURRENT ROW),
  w AS (PARTITION BY scope, limit_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
rw AS (SELECT *, CASE WHEN n >= 3 AND ts > front_ts AND (util - front_util) / (ts - front_ts) > 1e-5
  THEN CAST(trunc(greatest(100 - util, 0) / ((util - front_util) / (ts - front_ts))) AS BIGINT) END AS runway FROM h)"""


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of at most four samples in 90,000 s."""
    live_rows = readings.live_samples(_readings(spark, sf_dir)).select("scope", "limit_id", "ts", "util", "resets_at", "window_secs")
    return readings.bounded_history(live_rows, LOOKBACK, 4)


@query("q2_bounded_history", r(HIST_SQL + " SELECT limit_id, ts, n, front_ts, round(front_util, 6) AS front_util FROM h"))
def _(spark, sf_dir):
    return _recent(spark, sf_dir).select("limit_id", "ts", "n", "front_ts", F.round("front_util", 6).alias("front_util"))


@query("q3_linear_runway", r(HIST_SQL + " SELECT limit_id, ts, COALESCE(runway, -1) AS runway_secs FROM rw"))
def _(spark, sf_dir):
    return readings.with_linear_runway(_recent(spark, sf_dir)).select("limit_id", "ts", *_minus1("runway_secs"))


@query("q4_landing_throttle", r(LAND_SQL + " SELECT limit_id, ts, round(util, 6) AS util FROM ld"))
def _(spark, sf_dir):
    return _landed(spark, sf_dir)[0].select("limit_id", "ts", F.round("util", 6).alias("util"))


@query("q5_reset_points", r(LAND_SQL + " SELECT limit_id, ts, resets_at FROM rs"))
def _(spark, sf_dir):
    return _landed(spark, sf_dir)[1].select("limit_id", "ts", "resets_at")


KEEP_SQL = f""", ck AS (SELECT scope, limit_id, COUNT(*) AS c, MIN(CASE WHEN n <= 3 THEN ts END) AS third FROM (
  SELECT *, row_number() OVER (PARTITION BY scope, limit_id ORDER BY ts DESC) AS n FROM rs WHERE ts >= {NOW} - 2000000) GROUP BY ALL)"""


@query("q6_retention", r(LAND_SQL + KEEP_SQL + f""" SELECT 'sample' AS kind, ld.limit_id, ld.ts FROM ld LEFT JOIN ck USING (scope, limit_id) WHERE ld.ts >= {NOW} - 2000000 AND (c IS NULL OR c <= 3 OR ld.ts >= third)
  UNION ALL SELECT 'reset', rs.limit_id, rs.ts FROM rs JOIN ck USING (scope, limit_id) WHERE rs.ts >= {NOW} - 2000000 AND (c <= 3 OR rs.ts >= third)"""))
def _(spark, sf_dir):
    """2,000,000 s and three reset points, so that both bounds bite."""
    samples, resets = history.retain(*_stored(spark, sf_dir), NOW, 2_000_000, 3)
    return samples.select(F.lit("sample").alias("kind"), "limit_id", "ts").unionByName(
        resets.select(F.lit("reset").alias("kind"), "limit_id", "ts")
    )


@query("s16_merged_history", ORACLES["q6_retention"])
def _(spark, sf_dir):
    """Four landed batches, a merge behind the second and the fourth, old folders removed in between."""
    path = T.scratch(spark)
    sources.write_quota_history(*_landed(spark, sf_dir), path, 0)
    whole, parted = sources.read_quota_history(spark, path), T.scratch(spark)
    for batch in range(4):
        some = (F.xxhash64("limit_id", "ts") % 4 + 4) % 4 == batch
        sources.write_quota_history(*[df.filter(some) for df in whole], parted, batch)
        if batch % 2:
            merge_quota_history(spark, parted, NOW, 2_000_000, 3)
            drop_merged(spark, parted)
    samples, resets = history.retain(*sources.read_quota_history(spark, parted), NOW, 2_000_000, 3)
    return samples.select(F.lit("sample").alias("kind"), "limit_id", "ts").unionByName(
        resets.select(F.lit("reset").alias("kind"), "limit_id", "ts")
    )


CYCLE_SQL = f""", af AS (SELECT ld.*, (SELECT rs.resets_at FROM rs WHERE rs.scope = ld.scope AND rs.limit_id = ld.limit_id AND rs.ts <= ld.ts ORDER BY rs.ts DESC LIMIT 1) AS in_force FROM ld),
pr AS (SELECT *, lag(ts) OVER w AS prev_ts, lag(util) OVER w AS prev_util, lag(in_force) OVER w AS pf FROM af WINDOW w AS (PARTITION BY scope, limit_id ORDER BY ts)),
bo AS (SELECT *, COALESCE(in_force > pf OR (prev_util > 20 AND util < 5), FALSE) AS boundary FROM pr),
cy AS (SELECT *, CAST(SUM(CASE WHEN boundary THEN 1 ELSE 0 END) OVER (PARTITION BY scope, limit_id ORDER BY ts) AS BIGINT) AS cycle_id FROM bo),
cc AS (SELECT scope, limit_id, cycle_id, MIN(ts) AS s, MAX(ts) AS e, COUNT(*) AS n, bool_or(util >= 100) AS hit, arg_min(util, ts) AS fu, arg_max(util, ts) AS lu
  FROM cy GROUP BY ALL HAVING COUNT(*) >= 2 AND MAX(ts) - MIN(ts) >= 0.8 * {WINDOW}),
sg AS (SELECT cy.*, s, (prev_ts - s) / {WINDOW}::DOUBLE AS p0, (ts - s) / {WINDOW}::DOUBLE AS p1 FROM cy JOIN cc USING (scope, limit_id, cycle_id) WHERE NOT boundary AND prev_ts IS NOT NULL),
gr AS (SELECT cc.*, b, b / 47.0::DOUBLE AS p, least((e - s) / {WINDOW}::DOUBLE, 1) AS lp FROM cc, (SELECT unnest(range(48)) AS b)),
cv AS (SELECT gr.scope, gr.limit_id, gr.cycle_id, gr.b, gr.hit, CASE WHEN p <= 0 THEN fu WHEN p >= lp THEN lu ELSE
  (SELECT arg_min(CASE WHEN p1 - p0 < 1e-12 THEN util ELSE prev_util * (1 - (p - p0) / (p1 - p0)) + util * ((p - p0) / (p1 - p0)) END, ts) FROM sg
   WHERE sg.scope = gr.scope AND sg.limit_id = gr.limit_id AND sg.cycle_id = gr.cycle_id AND p BETWEEN p0 AND p1) END AS v FROM gr)"""


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, resets = _stored(spark, sf_dir)
    placed = history.with_reset_in_force(samples, resets)
    return history.split_cycles(placed.withColumn("window_secs", F.lit(WINDOW)))


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = _cycles(spark, sf_dir)
    return history.cycle_curves(cycles, history.complete_cycles(cycles))


@query("q7_cycle_split", r(LAND_SQL + CYCLE_SQL + " SELECT limit_id, ts, cycle_id, boundary FROM cy"))
def _(spark, sf_dir):
    return _cycles(spark, sf_dir).select("limit_id", "ts", "cycle_id", "boundary")


@query("q8_complete_cycles", r(LAND_SQL + CYCLE_SQL + " SELECT limit_id, cycle_id, n, s AS cycle_start, e AS cycle_end, hit AS hit_locked FROM cc"))
def _(spark, sf_dir):
    return history.complete_cycles(_cycles(spark, sf_dir)).select("limit_id", "cycle_id", "n", "cycle_start", "cycle_end", "hit_locked")


@query("q9_cycle_curves", r(LAND_SQL + CYCLE_SQL + " SELECT limit_id, cycle_id, b AS bucket, round(v, 6) AS value FROM cv"))
def _(spark, sf_dir):
    rows = _curves(spark, sf_dir).select("limit_id", "cycle_id", F.posexplode("curve").alias("bucket", "value"))
    return rows.select("limit_id", "cycle_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("value", 6).alias("value"))


@query("q10_median_curve", r(LAND_SQL + CYCLE_SQL + """, iv AS (SELECT a.limit_id, a.v * 0.5 + b.v * 0.5 AS x FROM cv a JOIN cv b ON a.scope = b.scope AND a.limit_id = b.limit_id AND a.cycle_id = b.cycle_id AND a.b = 23 AND b.b = 24)
  SELECT limit_id, round(median(x), 6) AS expected_util FROM iv GROUP BY limit_id"""))
def _(spark, sf_dir):
    """Half way through the window, which lies between the 24th and 25th bucket."""
    per_limit = projection.limit_curves(_curves(spark, sf_dir))
    return per_limit.select("limit_id", F.round(projection.median_at(F.col("curves"), F.lit(0.5)), 6).alias("expected_util"))


@query("q11_run_out_probability", r(LAND_SQL + CYCLE_SQL + " SELECT limit_id, round(AVG(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS run_out_probability FROM cc GROUP BY limit_id"))
def _(spark, sf_dir):
    per_limit = projection.limit_curves(_curves(spark, sf_dir))
    return per_limit.select("limit_id", F.round("run_out_probability", 6).alias("run_out_probability"))


PROJ_SQL = f""", cur AS (SELECT * FROM (SELECT *, (ts - resets_at + window_secs) / window_secs::DOUBLE AS t, row_number() OVER (PARTITION BY scope, limit_id ORDER BY ts DESC) AS latest FROM sm) WHERE latest = 1),
st AS (SELECT cur.scope, cur.limit_id, i, (1 - t) * (i / 240.0::DOUBLE) AS dp, least(t + (1 - t) * (i / 240.0::DOUBLE), 1.0) * 47 AS x FROM cur, (SELECT unnest(range(0, 241)) AS i)),
md AS (SELECT st.scope, st.limit_id, st.i, st.dp, median(CASE WHEN floor(x) >= 47 THEN a.v ELSE a.v * (1 - (x - floor(x))) + b.v * (x - floor(x)) END) AS m
  FROM st JOIN cv a ON a.scope = st.scope AND a.limit_id = st.limit_id AND a.b = CAST(floor(x) AS BIGINT)
  LEFT JOIN cv b ON b.scope = a.scope AND b.limit_id = a.limit_id AND b.cycle_id = a.cycle_id AND b.b = a.b + 1 GROUP BY ALL),
ba AS (SELECT scope, limit_id, m AS base FROM md WHERE i = 0),
hi AS (SELECT md.scope, md.limit_id, MIN(md.i) AS i FROM md JOIN ba USING (scope, limit_id) JOIN cur USING (scope, limit_id) WHERE md.i >= 1 AND cur.util + (m - base) >= 100 GROUP BY ALL),
hr AS (SELECT cur.scope, cur.limit_id, cur.util, cur.t, CASE WHEN cur.util >= 100 THEN 0 ELSE CAST(trunc((1 - t) * (hi.i / 240.0::DOUBLE) * {WINDOW}) AS BIGINT) END AS secs,
  (SELECT COUNT(*) FROM cc WHERE cc.scope = cur.scope AND cc.limit_id = cur.limit_id) AS cycles FROM cur LEFT JOIN hi USING (scope, limit_id))"""


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = _samples(spark, sf_dir).groupBy("scope", "limit_id").agg(
        F.max_by(F.struct("ts", "util", "resets_at", "window_secs", "status"), "ts").alias("c")
    )
    return readings.with_pace(latest.select("scope", "limit_id", "c.*"))


@query("q12_historical_runway", r(LAND_SQL + CYCLE_SQL + PROJ_SQL + " SELECT limit_id, COALESCE(secs, -1) AS runway_secs FROM hr WHERE cycles > 0"))
def _(spark, sf_dir):
    joined = _current(spark, sf_dir).join(projection.limit_curves(_curves(spark, sf_dir)), ["scope", "limit_id"])
    secs = projection.historical_runway(F.col("curves"), F.col("pieces"), F.col("progress"), F.col("util"), F.col("window_secs"))
    return joined.select("limit_id", F.coalesce(secs, F.lit(-1)).alias("runway_secs"))


@query(
    "q13_projection_switch",
    r(LAND_SQL + CYCLE_SQL + PROJ_SQL + """ SELECT hr.limit_id, CASE WHEN cycles >= 2 AND secs IS NOT NULL THEN 'historical' ELSE 'linear' END AS pace_basis,
      CASE WHEN cycles >= 2 AND secs IS NOT NULL THEN secs ELSE 4242 END AS runway_secs,
      CASE WHEN cycles >= 2 THEN round((SELECT AVG(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FROM cc WHERE cc.scope = hr.scope AND cc.limit_id = hr.limit_id), 6) ELSE -1 END AS run_out_probability FROM hr"""),
)
def _(spark, sf_dir):
    """The linear side is a marker value, so that the switch itself shows."""
    rows = projection.project(_current(spark, sf_dir).withColumn("linear_secs", F.lit(4242)), _curves(spark, sf_dir))
    return rows.select(
        "limit_id", "pace_basis", "runway_secs",
        F.coalesce(F.round("run_out_probability", 6), F.lit(-1.0)).alias("run_out_probability"),
    )


# Hourly snapshots per scope: one limit per event type, utilisation = greatest value of the hour.
SNAP_SQL = EVENTS_SQL + """,
sn AS (SELECT scope, ts // 3600 * 3600 AS ts, event_type AS limit_id, MIN(event_id) AS position, MAX(least(value, 100)) AS util,
  CASE event_type WHEN 'click' THEN 'anthropic' WHEN 'view' THEN 'anthropic' WHEN 'error' THEN 'grok' ELSE 'codex' END AS provider FROM ev GROUP BY ALL)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = T.events(spark, sf_dir).groupBy(
        "scope", (F.floor(F.col("ts") / HOUR) * HOUR).cast("bigint").alias("ts"), kind.alias("limit_id")
    ).agg(F.min("event_id").alias("position"), F.max(F.least("value", F.lit(100.0))).alias("util"))
    name = F.col("limit_id")
    return rows.select(
        "scope", "ts", "position", "limit_id",
        F.when(name.isin("click", "view"), "anthropic").when(name == "error", "grok").otherwise("codex").alias("provider"),
        F.concat(F.lit("Limit "), name).alias("label"), "util",
        (F.col("ts") + 18_000).alias("resets_at"), F.lit(18_000).cast("bigint").alias("window_secs"),
        F.lit("normal").alias("status"), F.lit(None).cast("string").alias("hint"),
    )


STICKY_SQL = SNAP_SQL + """,
tp AS (SELECT scope, ts, arg_max(limit_id, (util, position)) AS top, MAX(util) AS top_util, map_from_entries(list((limit_id, util))) AS utils,
  row_number() OVER (PARTITION BY scope ORDER BY ts) AS n FROM sn GROUP BY scope, ts),
fo AS (SELECT scope, n, ts, top AS cur, ts AS since FROM tp WHERE n = 1
  UNION ALL SELECT tp.scope, tp.n, tp.ts, CASE WHEN d.sw THEN tp.top ELSE fo.cur END, CASE WHEN d.sw THEN tp.ts ELSE fo.since END
  FROM fo JOIN tp ON tp.scope = fo.scope AND tp.n = fo.n + 1,
  LATERAL (SELECT NOT map_contains(tp.utils, fo.cur) OR (tp.top <> fo.cur AND tp.top_util - tp.utils[fo.cur] >= 5 AND tp.ts - fo.since >= 9000) AS sw) d)"""


@query("q14_sticky_worst", f"WITH RECURSIVE {STICKY_SQL} SELECT scope, ts, cur AS worst_id FROM fo")
def _(spark, sf_dir):
    """Dwell of 9,000 s, since snapshots are hourly."""
    return choice.sticky_worst(_snapshots(spark, sf_dir), dwell=9_000)


RANKED = "CASE WHEN util >= 100 THEN 2 WHEN util >= 75 THEN 1 ELSE 0 END"


@query("q15_worst_per_provider", f"WITH {SNAP_SQL} SELECT scope, ts, provider, limit_id FROM (SELECT *, row_number() OVER (PARTITION BY scope, ts, provider ORDER BY {RANKED} DESC, util DESC, position) AS n FROM sn) WHERE n = 1")
def _(spark, sf_dir):
    return choice.worst_per_provider(readings.with_status(_snapshots(spark, sf_dir))).select("scope", "ts", "provider", "limit_id")


@query(
    "q16_pinned_choice",
    f"""WITH {SNAP_SQL}, k AS (SELECT DISTINCT scope, ts FROM sn), p AS (SELECT * FROM k, (VALUES ('anthropic', 'auto'), ('anthropic', 'model:view'), ('codex', '5h')) v(provider, pin)),
      w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, ts, provider ORDER BY {RANKED} DESC, util DESC, position) AS n FROM sn) WHERE n = 1)
      SELECT p.scope, p.ts, p.provider, p.pin, COALESCE(CASE pin WHEN 'auto' THEN w.limit_id WHEN 'model:view' THEN (SELECT 'view' FROM sn s WHERE s.scope = p.scope AND s.ts = p.ts AND s.limit_id = 'view') END, '-') AS limit_id
      FROM p LEFT JOIN w ON w.scope = p.scope AND w.ts = p.ts AND w.provider = p.provider""",
)
def _(spark, sf_dir):
    """No limit is called ``codex.5h`` here, so that pin must stay empty."""
    rows = readings.with_status(_snapshots(spark, sf_dir))
    pairs = [("anthropic", "auto"), ("anthropic", "model:view"), ("codex", "5h")]
    pin = F.explode(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(v).alias("pin")) for p, v in pairs]))
    pins = rows.select("scope", "ts").distinct().select("scope", "ts", pin.alias("p")).select("scope", "ts", "p.*")
    return choice.pinned_choice(rows, pins).withColumn("limit_id", F.coalesce("limit_id", F.lit("-")))


@query(
    "q17_quota_board",
    f"""WITH {SNAP_SQL}, b AS (SELECT *, CASE WHEN util >= 100 THEN 1 WHEN util >= 75 THEN 2 ELSE 5 END AS pr FROM sn)
      SELECT scope, ts, limit_id, CASE WHEN util >= 100 THEN 0 ELSE CAST(greatest(floor(100 - util + 0.5), 0) AS BIGINT) END AS percent_left,
      CASE pr WHEN 1 THEN 'locked' WHEN 2 THEN 'warn' ELSE 'safe' END AS gauge_state, 18000::BIGINT AS reset_in_secs,
      CASE MIN(pr) OVER (PARTITION BY scope, ts, provider) WHEN 1 THEN 'locked' WHEN 2 THEN 'warn' ELSE 'safe' END AS provider_state FROM b""",
)
def _(spark, sf_dir):
    board = choice.quota_board(readings.with_status(_snapshots(spark, sf_dir)))
    return board.select("scope", "ts", "limit_id", "percent_left", "gauge_state", "reset_in_secs", "provider_state")


@query(
    "q18_quota_gauge",
    f"""WITH {SNAP_SQL} SELECT scope, ts, CAST(CASE limit_id WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS BIGINT) AS gauge_pos, round(util, 6) AS util FROM sn WHERE limit_id IN ('click', 'view', 'purchase')""",
)
def _(spark, sf_dir):
    """Three of the limits take the names of the gauge windows."""
    name = F.col("limit_id")
    named = F.when(name == "click", "cc.5h").when(name == "view", "cc.week").when(name == "purchase", "codex.week").otherwise(name)
    gauge = choice.quota_gauge(_snapshots(spark, sf_dir).withColumn("limit_id", named))
    return gauge.select("scope", "ts", F.col("gauge_pos").cast("bigint").alias("gauge_pos"), F.round("util", 6).alias("util"))


@query(
    "q19_quota_snapshot",
    f"""WITH RECURSIVE {STICKY_SQL.replace("util - tp.utils", "util - tp.utils").replace(">= 9000", ">= 45")}, lt AS (SELECT scope, MAX(ts) AS ts FROM sn GROUP BY scope)
      SELECT sn.scope, sn.ts, sn.limit_id, CASE WHEN util >= 100 THEN 'locked' WHEN util >= 75 THEN 'near' ELSE 'normal' END AS status, fo.cur AS worst_id
      FROM sn JOIN lt USING (scope, ts) JOIN fo USING (scope, ts)""",
)
def _(spark, sf_dir):
    snap = quota_snapshot(_snapshots(spark, sf_dir), NOW)
    return snap.select("scope", "ts", "limit_id", "status", "worst_id")


# ---------------------------------------------------------------- alerts


ALERT_SQL = f""", lvls AS (SELECT *, CASE WHEN status = 'locked' OR util >= 90 THEN 'critical' WHEN util >= 75 THEN 'warning' END AS level FROM rd WHERE status <> 'source_failed'),
al AS (SELECT *, row_number() OVER (PARTITION BY scope, limit_id ORDER BY ts) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY scope, limit_id, ts ORDER BY position) AS k FROM lvls WHERE level IS NOT NULL) WHERE k = 1),
fire AS (SELECT scope, limit_id, n, ts, level, TRUE AS fired, ts AS last FROM al WHERE n = 1
  UNION ALL SELECT al.scope, al.limit_id, al.n, al.ts, al.level, al.ts - f.last >= {SUPPRESS}, CASE WHEN al.ts - f.last >= {SUPPRESS} THEN al.ts ELSE f.last END
  FROM fire f JOIN al ON al.scope = f.scope AND al.limit_id = f.limit_id AND al.n = f.n + 1)"""
ALERTS = r(ALERT_SQL + " SELECT limit_id, ts, level FROM fire WHERE fired")


@query("n1_threshold_alerts", ALERTS)
def _(spark, sf_dir):
    """Suppression of 200,000 s, since a user's readings lie hours apart."""
    return alerts.threshold_alerts(_readings(spark, sf_dir), secs=SUPPRESS).drop("scope")


FAIL_SQL = SNAP_SQL + f""",
st AS (SELECT k.scope, k.ts, v.provider, (SELECT arg_min('Limit ' || s.limit_id || ' usage unavailable', s.position) FROM sn s WHERE s.scope = k.scope AND s.ts = k.ts AND s.provider = v.provider AND s.util > 60) AS body
  FROM (SELECT DISTINCT scope, ts FROM sn) k, (VALUES ('anthropic'), ('codex'), ('grok')) v(provider)),
so AS (SELECT *, row_number() OVER (PARTITION BY scope, provider ORDER BY ts) AS n FROM st),
ff AS (SELECT scope, provider, n, ts, body, body IS NOT NULL AS fired, CASE WHEN body IS NOT NULL THEN ts END AS last FROM so WHERE n = 1
  UNION ALL SELECT so.scope, so.provider, so.n, so.ts, so.body, d.due, CASE WHEN so.body IS NULL THEN NULL WHEN d.due THEN so.ts ELSE ff.last END
  FROM ff JOIN so ON so.scope = ff.scope AND so.provider = ff.provider AND so.n = ff.n + 1,
  LATERAL (SELECT so.body IS NOT NULL AND (ff.last IS NULL OR so.ts - ff.last >= 21600) AS due) d)"""
NOTICES = f"WITH RECURSIVE {FAIL_SQL} SELECT scope, provider, ts, body FROM ff WHERE fired"


def _failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit above 60 stands for a failed source."""
    return _snapshots(spark, sf_dir).withColumn("status", F.when(F.col("util") > 60, "source_failed").otherwise("normal"))


@query("n2_source_failure_notices", NOTICES)
def _(spark, sf_dir):
    return alerts.source_failure_notices(_failing(spark, sf_dir))


# ---------------------------------------------------------------- streams


def _feed(spark: SparkSession, rows: DataFrame, start, days: int = 10, close: bool = False) -> None:
    """Let ``rows`` arrive in slots of ``days`` days; ``start(stream)`` runs after each arrival.

    Every run continues from the same checkpoint and takes the new slot as one micro-batch.  The
    readings of one scope lag a slot behind the others, and the snapshot on the border of two slots
    is split between them.  ``close`` ends every scope with a closing row.
    """
    path = T.scratch(spark)
    slots = -(-30 // days) + 1
    if close:
        ends = rows.groupBy("scope").agg((F.max("ts") + 1).alias("ts"))
        rows = rows.unionByName(ends, allowMissingColumns=True)
    early = F.when(F.col("position") % 2 == 0, 1).otherwise(0) if "position" in rows.columns else F.lit(0)
    lag = F.when(F.col("scope") == "org1", 1).otherwise(0)
    number_of = F.floor((F.col("ts") - T.START - early) / (days * 86_400))
    slot = F.least(F.greatest(number_of, F.lit(0)) + lag, F.lit(slots - 1))
    for number in range(slots):
        rows.filter(slot == number).write.parquet(f"{path}/{number:03d}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(path)
        start(stream).awaitTermination()


def _drained(spark: SparkSession, rows: DataFrame, transform, close: bool = False) -> DataFrame:
    path, checkpoint = T.scratch(spark), T.scratch(spark)
    _feed(spark, rows, lambda stream: live.land_stream(transform(stream), path, checkpoint), close=close)
    return spark.read.parquet(path)


@query(
    "n3_stream_projection",
    r(HIST_SQL + """ SELECT limit_id, ts, CASE WHEN util >= 100 THEN 'locked' WHEN util >= 75 THEN 'near' ELSE 'normal' END AS status,
      COALESCE(runway, -1) AS runway_secs, COALESCE(round(util - 100 * (ts - resets_at + window_secs) / window_secs, 6), 0) AS deficit FROM rw"""),
)
def _(spark, sf_dir):
    done = _drained(spark, _readings(spark, sf_dir), lambda stream: live.stream_projection(stream, LOOKBACK, 4))
    return done.select("limit_id", "ts", "status", *_minus1("runway_secs"), F.coalesce(F.round("pace.deficit", 6), F.lit(0.0)).alias("deficit"))


@query("n1_stream_alerts", ALERTS)
def _(spark, sf_dir):
    fired = _drained(spark, _readings(spark, sf_dir), lambda stream: live.stream_alerts(stream, secs=SUPPRESS))
    return fired.select("limit_id", "ts", "level")


@query("n2_stream_source_notices", NOTICES)
def _(spark, sf_dir):
    return _drained(spark, _failing(spark, sf_dir), live.stream_source_notices, close=True).select("scope", "provider", "ts", "body")


@query("n4_stream_sticky_worst", ORACLES["q14_sticky_worst"])
def _(spark, sf_dir):
    shown = _drained(spark, _snapshots(spark, sf_dir), lambda stream: live.stream_sticky_worst(stream, dwell=9_000), close=True)
    return shown.select("scope", "ts", "worst_id")


@query("n5_stream_landing", ORACLES["s16_quota_history_sink"])
def _(spark, sf_dir):
    path, checkpoint = T.scratch(spark), T.scratch(spark)
    _feed(
        spark,
        _readings(spark, sf_dir).withColumn("status", F.lit("normal")),
        lambda stream: live.land_quota_history(stream, path, checkpoint, secs=LANDING, delta=40.0),
    )
    samples, resets = sources.read_quota_history(spark, path)
    return samples.select(F.lit("sample").alias("kind"), "limit_id", "ts", F.round("util", 6).alias("value")).unionByName(
        resets.select(F.lit("reset").alias("kind"), "limit_id", "ts", F.col("resets_at").cast("double").alias("value"))
    )


@query("n6_incremental_usage", f"WITH {T.USAGE_SQL} SELECT scope, CAST(day AS VARCHAR) AS date, model, SUM(total)::BIGINT AS tokens FROM u GROUP BY ALL")
def _(spark, sf_dir):
    path, checkpoint = T.scratch(spark), T.scratch(spark)
    _feed(
        spark,
        T.usage(spark, sf_dir).select(*USAGE_COLUMNS),
        lambda stream: live.maintain_usage_cube(stream, path, checkpoint),
    )
    daily = A.daily_tokens_by(live.read_usage_cube(spark, path), T.SPAN, "model")
    return daily.withColumn("date", F.col("date").cast("string"))

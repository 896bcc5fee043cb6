"""Quota readings from logs and stored responses, and the landed quota history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterloom.functions.clock import as_col, epoch_of_rfc3339
from meterloom.functions.quota import honest_reading, window_name
from meterloom.functions.text import slug
from meterloom.operators.ordered import first_of
from meterloom.sources.batches import batch_folders
from meterloom.sources.logs import file_order

# The key and the fields of a quota window in logs and in stored responses.
RATE_KEY = '"rate_limits":'
WINDOW = "used_percent double, window_minutes bigint, resets_at bigint"
LIVE_WINDOW = "used_percent double, limit_window_seconds bigint, reset_at bigint"


def explode_windows(df: DataFrame, json: str, schema: str = WINDOW) -> DataFrame:
    """One row per window-shaped object under any key of the JSON object in column ``json``.

    Adds ``slot`` (the key) and the fields of ``schema``; other values are skipped.
    """
    slots = F.from_json(json, "map<string,string>")
    rows = df.select("*", F.explode(slots).alias("slot", "_text"))
    rows = rows.withColumn("w", F.from_json("_text", schema)).drop("_text")
    fields = [f.split()[0] for f in schema.split(", ")]
    complete = F.lit(True)
    for f in fields:
        complete = complete & F.col(f"w.{f}").isNotNull()
    return rows.filter(complete).select(*[c for c in rows.columns if c != "w"], "w.*")


def latest_rate_limits(lines: DataFrame, now: int, n: int | None = None) -> DataFrame:
    """Readings of the newest quota snapshot in the Codex logs of each scope.

    The last ``rate_limits`` object of each file counts, and the newest file whose object has a
    window wins; with ``n`` only the ``n`` newest files are asked.
    """
    codex = lines.filter(F.col("source") == "codex").withColumn("_file", file_order())
    files = codex.groupBy("scope", "file_path", "_file").agg(
        F.max("file_mtime").alias("file_mtime"),
        # text behind the last key of the last line that has one
        F.max_by(
            F.substring_index("value", RATE_KEY, -1),
            F.when(F.col("value").contains(RATE_KEY), F.struct("block_start", "line_seq")),
        ).alias("rate_limits"),
    )
    if n is not None:
        newest = Window.partitionBy("scope").orderBy(F.desc("file_mtime"), "_file")
        files = files.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")
    found = explode_windows(files.filter(F.ltrim("rate_limits").startswith("{")), "rate_limits").drop("rate_limits")
    # a partial aggregate finds the file, and its few windows are joined back
    found = found.withColumn("_age", F.struct(-F.col("file_mtime"), F.col("_file")))
    winner = found.groupBy("scope").agg(F.min("_age").alias("_win")).withColumnRenamed("scope", "_scope")
    won = found.join(winner, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("_age") == F.col("_win")))
    return snapshot_limits(won, now)


def snapshot_limits(windows: DataFrame, now: int) -> DataFrame:
    """Windows of a log snapshot as readings: shortest first, one per id, aged honestly."""
    named = windows.withColumn("_name", window_name("window_minutes")).withColumn("limit_id", F.col("_name.id"))
    one = first_of(named, ["scope", "limit_id"], ["window_minutes", "slot"])
    seen = honest_reading(
        F.col("used_percent"), F.col("resets_at"), now - F.col("file_mtime"), F.lit(now).cast("bigint")
    )
    rows = one.withColumn("_seen", seen)
    return rows.select(
        "scope",
        F.lit(now).cast("bigint").alias("ts"),
        F.col("window_minutes").alias("position"),
        "limit_id",
        F.lit("codex").alias("provider"),
        F.col("_name.label").alias("label"),
        F.col("_seen.util").alias("util"),
        F.col("_seen.resets_at").alias("resets_at"),
        (F.col("window_minutes") * 60).alias("window_secs"),
        F.col("_seen.status").alias("status"),
    )


def parse_live_payload(df: DataFrame) -> DataFrame:
    """Codex account responses (``scope, observed_at, payload``): one reading per window id.

    A payload without a usable window gives no row.
    """
    body = df.select("scope", F.col("observed_at").alias("ts"), F.from_json("payload", "rate_limit string")["rate_limit"].alias("rate_limit"))
    rows = explode_windows(body, "rate_limit", LIVE_WINDOW)
    named = rows.withColumn("_name", window_name(F.floor(F.col("limit_window_seconds") / 60).cast("bigint")))
    named = named.withColumn("limit_id", F.col("_name.id")).drop("rate_limit")
    one = first_of(named, ["scope", "ts", "limit_id"], ["limit_window_seconds", "slot"])
    return one.select(
        "scope", "ts",
        F.col("limit_window_seconds").alias("position"),
        "limit_id",
        F.lit("codex").alias("provider"),
        F.col("_name.label").alias("label"),
        F.col("used_percent").alias("util"),
        F.col("reset_at").alias("resets_at"),
        F.col("limit_window_seconds").alias("window_secs"),
        F.lit("normal").alias("status"),
    )


# The fields of a usage response.
_LEGACY = "struct<utilization: double, resets_at: string>"
_PAYLOAD = f"""limits array<struct<kind: string, `group`: string, percent: double, resets_at: string,
    scope: struct<model: struct<display_name: string>>>>,
  five_hour {_LEGACY}, seven_day {_LEGACY}, seven_day_opus {_LEGACY},
  extra_usage struct<is_enabled: boolean, monthly_limit: double, used_credits: double>"""

# Window seconds by group, and the older responses' fields.
GROUP_SECS = {"session": 5 * 3_600, "weekly": 7 * 86_400}
LEGACY_WINDOWS = [
    ("five_hour", "cc.5h", "Claude·5h", 5 * 3_600),
    ("seven_day", "cc.week", "Claude·Weekly", 7 * 86_400),
    ("seven_day_opus", "cc.opus", "Claude·Opus", 7 * 86_400),
]
EXTRA_SECS = 30 * 86_400


def _limit(name, label, util, resets_at, window, used=None, cap=None) -> Column:
    def text(v):
        return F.lit(v) if isinstance(v, str) else v

    return F.struct(
        text(name).alias("limit_id"), text(label).alias("label"), util.alias("util"),
        F.coalesce(resets_at, F.lit(0)).cast("bigint").alias("resets_at"),
        window.cast("bigint").alias("window_secs"),
        (F.lit(None) if used is None else used).cast("bigint").alias("used"),
        (F.lit(None) if cap is None else cap).cast("bigint").alias("cap"),
    )


def usage_limits(payload: Column | str) -> Column:
    """Array of limits in an Anthropic usage response; empty when it has none."""
    body = F.from_json(as_col(payload), _PAYLOAD)

    def modern(e: Column) -> Column:
        kind = F.coalesce(e["kind"], F.lit(""))
        model = e["scope"]["model"]["display_name"]
        scoped = (kind == "weekly_scoped") & model.isNotNull()
        opus = scoped & (F.lower(model) == "opus")
        name = (
            F.when(kind == "session", "cc.5h").when(kind == "weekly_all", "cc.week")
            .when(opus, "cc.opus").when(scoped, F.concat(F.lit("cc.w."), slug(model)))
            .otherwise(F.concat(F.lit("cc."), slug(kind)))
        )
        label = (
            F.when(kind == "session", "Claude·5h").when(kind == "weekly_all", "Claude·Weekly")
            .when(opus, "Claude·Opus").when(scoped, F.concat(F.lit("Claude·"), model))
            .otherwise(F.concat(F.lit("Claude·"), kind))
        )
        window = F.lit(0)
        for group, secs in GROUP_SECS.items():
            window = F.when(e["group"] == group, secs).otherwise(window)
        usable = e["percent"].isNotNull() & (kind != "")
        return F.when(usable, _limit(name, label, e["percent"], epoch_of_rfc3339(e["resets_at"]), window))

    array = F.transform(
        F.coalesce(body["limits"], F.from_json(F.lit("[]"), "array<struct<kind:string,`group`:string,percent:double,resets_at:string,scope:struct<model:struct<display_name:string>>>>")),
        modern,
    )
    array = F.filter(array, lambda x: x.isNotNull())
    legacy = F.filter(
        F.array(
            *[
                F.when(
                    body[f]["utilization"].isNotNull(),
                    _limit(name, label, body[f]["utilization"], epoch_of_rfc3339(body[f]["resets_at"]), F.lit(secs)),
                )
                for f, name, label, secs in LEGACY_WINDOWS
            ]
        ),
        lambda x: x.isNotNull(),
    )
    extra = body["extra_usage"]
    used = F.coalesce(extra["used_credits"], F.lit(0.0))
    cap = F.coalesce(extra["monthly_limit"], F.lit(0.0))
    util = F.when(cap > 0, used / cap * 100).otherwise(0.0)
    credit = _limit(
        "cc.extra", "Claude·Credits", util, F.lit(0), F.lit(EXTRA_SECS),
        F.greatest(used, F.lit(0.0)), F.greatest(cap, F.lit(0.0)),
    )
    credits = F.filter(F.array(F.when(extra["is_enabled"], credit)), lambda x: x.isNotNull())
    return F.concat(F.when(F.size(array) > 0, array).otherwise(legacy), credits)


def parse_usage_payload(df: DataFrame) -> DataFrame:
    """Anthropic usage responses (``scope, observed_at, payload``) as readings."""
    rows = df.select(
        "scope", F.col("observed_at").alias("ts"), F.posexplode(usage_limits("payload")).alias("position", "l")
    )
    return rows.select(
        "scope", "ts", F.col("position").cast("bigint").alias("position"), "l.limit_id",
        F.lit("anthropic").alias("provider"), "l.label", "l.util", "l.resets_at", "l.window_secs",
        F.lit("normal").alias("status"), "l.used", "l.cap",
    )


# ---------------------------------------------------------------- landed history


POINTS = "scope string, limit_id string, ts bigint, kind string, util double, resets_at bigint"


def landed_points(samples: DataFrame, resets: DataFrame) -> DataFrame:
    """Samples and reset points as rows of kind sample or reset."""
    keys = ["scope", "limit_id", "ts"]
    return samples.select(*keys, F.lit("sample").alias("kind"), "util").unionByName(
        resets.select(*keys, F.lit("reset").alias("kind"), "resets_at"), allowMissingColumns=True
    )


def write_quota_history(samples: DataFrame, resets: DataFrame, path: str, batch: int) -> None:
    """Land one batch of samples and reset points in one commit; repeating a batch replaces it whole."""
    land_points(landed_points(samples, resets), path, batch)


def land_points(points: DataFrame, path: str, batch: int) -> None:
    """Land rows of kind sample or reset (scope, limit_id, ts, kind, util, resets_at) as one batch."""
    points.select("scope", "limit_id", "ts", "kind", "util", "resets_at").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_quota_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed samples (scope, limit_id, ts, util) and reset points (scope, limit_id, ts, resets_at)."""
    return history_of(spark, batch_folders(spark, path))


def history_of(spark: SparkSession, folders: list[str]) -> tuple[DataFrame, DataFrame]:
    """Samples and reset points of some landed folders; none are empty tables."""
    keys = ["scope", "limit_id", "ts"]
    points = spark.read.schema(POINTS).parquet(*folders) if folders else spark.createDataFrame([], POINTS)
    return points.filter("kind = 'sample'").select(*keys, "util"), points.filter("kind = 'reset'").select(*keys, "resets_at")

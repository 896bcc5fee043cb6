"""Mapping of the shared test tables to the engine's inputs.

``events`` row -> usage: scope ``org<user % 3>``, file per user, project ``p<user % 12>``, model
and kind by event type, tokens ``floor(value * 100)`` split by integer division.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.config import AGENTS
from meterloom.functions.clock import epoch_of_wall_utc
from meterloom.operators.counters import USAGE_COLUMNS
from meterloom.operators.ordered import carry_scan
from meterloom.operators.pricing import claude_cost, codex_cost, with_rate

# The instant the reports are made, and their time zone: 2024-01-30 23:59:59 UTC.
NOW = 1_706_659_199
TZ = "UTC"
RANGE = "month"
SPAN = ("2024-01-01", "2024-01-30")
START = 1_704_067_200

MODELS = {
    "click": "claude-opus-4",
    "view": "claude-sonnet-4",
    "purchase": "claude-haiku-4",
    "signup": "gpt-5-codex",
    "error": "grok-4",
}
SOURCES = {"click": "claude", "view": "claude", "purchase": "claude", "signup": "codex", "error": "grok"}
KINDS = {"click": "edit", "view": "read", "purchase": "run"}
TOOLS = {"click": "Edit", "view": "Read", "purchase": "Bash"}
HOUR = 3_600


def _mapped(mapping: dict[str, str]) -> Column:
    pairs = list(mapping.items())
    col = F.col("event_type")
    chain = reduce(lambda a, kv: a.when(col == kv[0], kv[1]), pairs[1:], F.when(col == pairs[0][0], pairs[0][1]))
    return chain


def stamp_of(wall: Column | str, zone: str) -> Column:
    """RFC 3339 text of a zone-less timestamp, independent of the session's time zone."""
    wall = F.col(wall) if isinstance(wall, str) else wall
    return F.concat(F.translate(F.substring(wall.cast("string"), 1, 19), " ", "T"), F.lit(zone))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file_path() -> Column:
    user = F.col("user_id").cast("string")
    return F.concat(F.lit("/logs/p"), (F.col("user_id") % 12).cast("string"), F.lit("/s"), user, F.lit(".jsonl"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with scope, epoch second, file, project, model and tokens."""
    return as_events(table(spark, sf_dir, "events"))


def as_events(rows: DataFrame, *more: str) -> DataFrame:
    """Rows of the table as ``events``, with ``more`` of their columns."""
    return rows.select(
        "event_id", "user_id", "event_type", "value", *more,
        F.concat(F.lit("org"), (F.col("user_id") % 3).cast("string")).alias("scope"),
        _mapped(SOURCES).alias("source"),
        _file_path().alias("file_path"),
        F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string")).alias("project"),
        epoch_of_wall_utc("ts").alias("ts"),
        stamp_of("ts", "Z").alias("stamp"),
        _mapped(MODELS).alias("model"),
        _mapped(KINDS).alias("kind"),
        F.floor(F.col("value") * 100).cast("bigint").alias("tokens"),
    )


def _parts(tokens: str = "tokens") -> dict[str, Column]:
    t = F.col(tokens)
    cached, output, reasoning = (F.floor(t / n).cast("bigint") for n in (3, 4, 10))
    codex = F.col("source") == "codex"
    reasoning = F.when(codex, reasoning).otherwise(0)
    return {"input": t - cached - output - reasoning, "cached": cached, "output": output, "reasoning": reasoning}


def usage(spark: SparkSession, sf_dir: str, rules: DataFrame | None = None) -> DataFrame:
    """Priced usage rows straight from the events; cached tokens count as cache reads."""
    split = F.col("source") != "grok"
    rows = events(spark, sf_dir).withColumns(
        {k: F.when(split, v).otherwise(0) for k, v in _parts().items()}
    )
    agent = reduce(
        lambda a, s: a.when(F.col("source") == s, AGENTS[s]), ["codex", "grok"],
        F.when(F.col("source") == "claude", AGENTS["claude"]),
    )
    zero = F.lit(0).cast("bigint")
    priced = with_rate(rows, rules).withColumns(
        {"agent": agent, "cache_read": F.col("cached"), "cache_write_5m": zero, "cache_write_1h": zero}
    )
    cost = (
        F.when(F.col("source") == "claude", claude_cost())
        .when(F.col("source") == "codex", codex_cost())
        .otherwise(0.0)
    )
    return (
        priced.withColumns({"total": F.col("tokens"), "cost": cost})
        .filter(F.col("total") > 0)
        .select(*USAGE_COLUMNS)
    )


def as_lines(df: DataFrame, source: str, value: Column, path: Column | None = None) -> DataFrame:
    """Log lines: hour of the day as split offset, event id as position.

    The text is built in a generator, so that filters on it do not build it again.
    """
    return df.select("*", F.explode(F.array(value)).alias("_text")).select(
        "scope",
        F.lit(source).alias("source"),
        (F.col("file_path") if path is None else path).alias("file_path"),
        (F.floor(F.col("ts") / HOUR) * HOUR).cast("bigint").alias("block_start"),
        F.col("event_id").alias("line_seq"),
        F.lit(NOW).cast("bigint").alias("file_mtime"),
        F.lit(0).cast("bigint").alias("file_size"),
        F.col("_text").alias("value"),
    )


def claude_json() -> Column:
    """One Claude line; the event id is the request id, its type names the tool used."""
    p = _parts()
    usage_part = F.struct(
        p["input"].alias("input_tokens"), p["output"].alias("output_tokens"),
        p["cached"].alias("cache_read_input_tokens"),
    )
    content = F.array(
        F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("name")),
        F.struct(F.lit("tool_use").alias("type"), _mapped(TOOLS).alias("name")),
    )
    message = F.struct(F.col("model").alias("model"), usage_part.alias("usage"), content.alias("content"))
    request = F.concat(F.lit("r"), F.col("event_id").cast("string"))
    return F.to_json(F.struct(F.col("stamp").alias("timestamp"), request.alias("requestId"), message.alias("message")))


def claude_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as Claude messages (every event type, so that whole tables are parsed)."""
    rows = events(spark, sf_dir).withColumn("source", F.lit("claude"))
    return as_lines(rows, "claude", claude_json())


def claude_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows behind ``claude_lines`` with ``file_path`` and ``line_seq`` (the event id); ``claude_text`` makes their text."""
    return table(spark, sf_dir, "events").select(
        _file_path().alias("file_path"), F.col("event_id").alias("line_seq"), "user_id", "ts", "event_type", "value")


def claude_text(rows: DataFrame) -> DataFrame:
    """``file, value`` of rows of ``claude_rows`` that know their ``file``."""
    ours = as_events(rows.withColumnRenamed("line_seq", "event_id"), "file").withColumn("source", F.lit("claude"))
    return ours.select("file", claude_json().alias("value"))


def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the running sum of each part per user, as a counter log would hold."""
    rows = events(spark, sf_dir).withColumn("source", F.lit("codex"))
    rows = rows.withColumns(_parts()).withColumn("chunk", F.floor(F.col("ts") / HOUR))
    parts = ["input", "cached", "output", "reasoning", "tokens"]
    return carry_scan(
        rows, ["scope", "user_id"], ["chunk"], ["event_id"], running={f"c_{p}": p for p in parts}
    )


def codex_json() -> Column:
    total = F.struct(
        F.col("c_input").alias("input_tokens"), F.col("c_cached").alias("cached_input_tokens"),
        F.col("c_output").alias("output_tokens"), F.col("c_reasoning").alias("reasoning_output_tokens"),
    )
    info = F.struct(total.alias("total_token_usage"))
    payload = F.struct(F.lit("token_count").alias("type"), F.concat(F.lit("/work/"), F.col("project")).alias("cwd"), info.alias("info"))
    return F.to_json(F.struct(F.col("stamp").alias("timestamp"), payload.alias("payload")))


def codex_lines(spark: SparkSession, sf_dir: str, folder: str = "/logs") -> DataFrame:
    path = F.concat(F.lit(folder + "/rollout-"), F.col("user_id").cast("string"), F.lit(".jsonl"))
    return as_lines(cumulative(spark, sf_dir), "codex", codex_json(), path)


def grok_json() -> Column:
    """A token reading; an ``error`` event also names the model in force from then on."""
    named = F.when(F.col("event_type") == "error", F.concat(F.lit("grok-"), (F.col("event_id") % 5).cast("string")))
    return F.to_json(
        F.struct(
            F.col("ts").alias("timestamp"),
            F.struct(
                F.struct(F.col("c_total").alias("totalTokens")).alias("_meta"),
                F.struct(F.struct(named.alias("modelId")).alias("_meta")).alias("update"),
            ).alias("params"),
        )
    )


def resetting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running tokens per user that restart at every event whose id is a multiple of 50."""
    rows = events(spark, sf_dir).withColumn("chunk", F.floor(F.col("ts") / HOUR))
    rows = rows.withColumn("mark", F.when(F.col("event_id") % 50 == 0, 1).otherwise(0))
    keys, chunk, seq = ["scope", "user_id"], ["chunk"], ["event_id"]
    summed = carry_scan(rows, keys, chunk, seq, running={"run": "tokens"})
    base = F.when(F.col("mark") == 1, F.col("run") - F.col("tokens"))
    based = carry_scan(summed.withColumn("base0", base), keys, chunk, seq, last={"base": "base0"})
    return based.withColumn("c_total", F.col("run") - F.coalesce("base", F.lit(0)))


def grok_lines(spark: SparkSession, sf_dir: str, folder: str = "/logs") -> DataFrame:
    path = F.concat(
        F.lit(folder + "/%2Fhome%2F"), F.col("project"), F.lit("/s"),
        F.col("user_id").cast("string"), F.lit("/updates.jsonl"),
    )
    return as_lines(resetting(spark, sf_dir), "grok", grok_json(), path)


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared folder of the cluster; a session in one process may use its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/meterloom-{uuid.uuid4().hex}"


def by_file(lines: DataFrame, *order: Column | str) -> DataFrame:
    """The rows of a ``file`` together and in order; the parts are not joined, as many small files are work."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(parts, "file").sortWithinPartitions("file", *order)


def write_files(lines: DataFrame, root: str) -> None:
    """Write every ``file`` below ``root`` from its rows ``file, value``, which stand in order and together in one partition.

    Text that is made behind ``by_file`` is neither shuffled nor sorted, so it is on disk once, in its file.

    A task holds one open file and one Arrow batch.  Spark's own writer takes a folder, a checksum and a
    rename for each of the many small files.
    """

    def write(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        name, stream, made = None, None, set()
        for batch in batches:
            files, values = batch.column(0), batch.column(1)
            cuts = [i + 1 for i in pc.indices_nonzero(pc.not_equal(files[1:], files[:-1])).to_pylist()] if len(files) else []
            for first, end in zip([0, *cuts], [*cuts, len(files)] if len(files) else []):
                if stream is None or files[first].as_py() != name:
                    if stream is not None:
                        stream.close()
                    name = files[first].as_py()
                    folder = f"{base}/{name}".rpartition("/")[0]
                    if folder not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    stream = system.open_output_stream(f"{base}/{name}")
                stream.write("".join(f"{text}\n" for text in values[first:end].to_pylist()).encode())
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["value"])

    lines.select("file", "value").mapInArrow(write, "value string").write.format("noop").mode("overwrite").save()


def put_files(lines: DataFrame, root: str, text=lambda rows: rows) -> None:
    """Write every ``file`` anew from its lines (early ones, then late ones, by ``line_seq``), whose ``value`` is what ``text`` makes of them."""
    rows = lines.withColumn("file", F.coalesce("file", F.lit("None")))
    write_files(text(by_file(rows, F.col("late").asc_nulls_last(), F.col("line_seq").asc_nulls_last())), root)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- SQL side

EVENTS_SQL = """
ev AS (
  SELECT event_id, user_id, event_type, value,
    'org' || CAST(user_id % 3 AS VARCHAR) AS scope,
    'p' || CAST(user_id % 12 AS VARCHAR) AS project,
    CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(ts AS DATE) AS day, CAST(hour(ts) AS BIGINT) AS hr,
    CASE event_type WHEN 'signup' THEN 'codex' WHEN 'error' THEN 'grok' ELSE 'claude' END AS source,
    CASE event_type WHEN 'click' THEN 'claude-opus-4' WHEN 'view' THEN 'claude-sonnet-4'
      WHEN 'purchase' THEN 'claude-haiku-4' WHEN 'signup' THEN 'gpt-5-codex' ELSE 'grok-4' END AS model,
    CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'run' END AS kind,
    CAST(floor(value * 100) AS BIGINT) AS tokens
  FROM events)"""

USAGE_SQL = EVENTS_SQL + """,
pt AS (
  SELECT *, CASE source WHEN 'claude' THEN 'Claude Code' WHEN 'codex' THEN 'Codex CLI' ELSE 'Grok CLI' END AS agent,
    tokens // 3 AS ca, tokens // 4 AS ou, CASE WHEN source = 'codex' THEN tokens // 10 ELSE 0 END AS re
  FROM ev WHERE tokens > 0),
u AS (
  SELECT *, tokens AS total,
    CASE WHEN source = 'grok' THEN 0 ELSE tokens - ca - ou - re END AS input,
    CASE WHEN source = 'grok' THEN 0 ELSE ca END AS cached,
    CASE WHEN source = 'grok' THEN 0 ELSE ou END AS output,
    re AS reasoning,
    CASE event_type
      WHEN 'click' THEN ((tokens-ca-ou) * 5.0::DOUBLE + ou * 25.0::DOUBLE + ca * 0.5::DOUBLE) / 1e6
      WHEN 'view' THEN ((tokens-ca-ou) * 3.0::DOUBLE + ou * 15.0::DOUBLE + ca * 0.3::DOUBLE) / 1e6
      WHEN 'purchase' THEN ((tokens-ca-ou) * 1.0::DOUBLE + ou * 5.0::DOUBLE + ca * 0.1::DOUBLE) / 1e6
      WHEN 'signup' THEN (greatest(tokens-ca-ou-re-ca, 0) * 5.0::DOUBLE + ca * 0.5::DOUBLE + (ou+re) * 5.0::DOUBLE) / 1e6
      ELSE 0.0 END AS cost
  FROM pt)"""

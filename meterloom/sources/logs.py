"""Session logs: reading lines with a stable order, parsing them, counting the ingest.

A log line frame has the columns of ``LINE_COLUMNS``.  The order of lines is
``file_order(file_path)``, ``block_start``, ``line_seq``: files in path order, splits of a file
by offset, lines of a split as read.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from meterloom.config import DEFAULT_CLAUDE_MODEL
from meterloom.functions.clock import as_col, epoch_of_rfc3339, epoch_of_variant
from meterloom.functions.text import basename, dominant_kind, path_part, percent_decode
from meterloom.sources.ranges import SPLIT, read_ranges
from meterloom.sources.tree import files_below, has_more_files, tree_root

# File name pattern of each log source.
PATTERNS = {"claude": "*.jsonl", "codex": "rollout-*.jsonl", "grok": "updates.jsonl"}

# Files that Spark's readers may index on the driver (more are listed and read by tasks), and what they unpack.
INDEXED = 10_000
PACKED = r"\.(?:gz|bz2|deflate|lz4|snappy|zst|zstd)$"

# Text a line must contain to be worth parsing.
CANDIDATE_TEXT = {
    "claude": ['"usage"'],
    "codex": ["token_count"],
    "grok": ["totalTokens", "modelId"],
}

LINE_COLUMNS = [
    "scope", "source", "file_path", "block_start", "line_seq", "file_mtime", "file_size", "value",
]
PLACE = ["scope", "source", "file_path", "block_start", "line_seq", "file_mtime"]

# The fields each parser reads.
_CLAUDE = """timestamp string, requestId string, uuid string, message struct<
  id: string, model: string,
  usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint,
    cache_creation_input_tokens: bigint,
    cache_creation: struct<ephemeral_1h_input_tokens: bigint, ephemeral_5m_input_tokens: bigint>>,
  content: array<struct<type: string, name: string>>>"""
_CODEX_USAGE = (
    "struct<input_tokens: bigint, cached_input_tokens: bigint, output_tokens: bigint,"
    " reasoning_output_tokens: bigint>"
)
_CODEX = (
    "timestamp variant, payload struct<type: string, cwd: string,"
    f" info: struct<total_token_usage: {_CODEX_USAGE}>, total_token_usage: {_CODEX_USAGE}>"
)
_META = "struct<totalTokens: bigint, modelId: string>"
_GROK = (
    f"timestamp variant, _meta {_META},"
    f" params struct<_meta: {_META}, update: struct<_meta: {_META}>>"
)
SCHEMAS = {"claude": _CLAUDE, "codex": _CODEX, "grok": _GROK}


def file_order(path: Column | str = "file_path") -> Column:
    """Sort key that orders paths component by component ('/' below every other character)."""
    return F.translate(as_col(path), "/", "\u0001")


def _reader(spark: SparkSession, source: str, pattern: str | None, since: int | None):
    reader = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern or PATTERNS[source])
    )
    if since is not None and since > 0:
        # Prunes whole files while listing; the option is exclusive, hence one second earlier.
        after = datetime.fromtimestamp(since - 1, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
        reader = reader.option("timeZone", "UTC").option("modifiedAfter", after)
    return reader


def _lineage(scope: Column | str, source: str, since: int | None, df: DataFrame) -> DataFrame:
    meta = F.col("_metadata")
    uri = F.regexp_replace(meta["file_path"], "^file:/+", "/")
    path = F.when(meta["file_path"].contains("%"), percent_decode(uri)).otherwise(uri)
    df = df.select(
        "*",
        F.lit(source).alias("source"),
        path.alias("file_path"),
        F.unix_micros(meta["file_modification_time"]).alias("_mtime_us"),
        meta["file_size"].alias("file_size"),
        meta["file_block_start"].alias("block_start"),
    ).withColumn("file_mtime", F.floor(F.col("_mtime_us") / 1_000_000).cast("bigint"))
    return _scoped(scope, since, df)


def _scoped(scope: Column | str, since: int | None, df: DataFrame) -> DataFrame:
    if since is not None:
        df = df.filter(F.col("file_mtime") >= since)
    return df.withColumn("scope", F.lit(scope) if isinstance(scope, str) else scope)


def _many_files(
    spark: SparkSession, root: str, source: str, since: int | None, scope: Column | str, pattern: str | None
) -> DataFrame | None:
    """The rows of ``list_files`` for a tree of more files than the driver may index, listed by tasks; else None."""
    name = pattern or PATTERNS[source]
    base = tree_root(spark, root)
    if base is None or not has_more_files(spark, base, INDEXED):
        return None
    listed = files_below(spark, base, name).withColumns(
        {"source": F.lit(source), "file_mtime": F.floor(F.col("mtime_us") / 1_000_000).cast("bigint")})
    return _scoped(scope, since, listed).select("scope", "source", "file_path", "file_size", "file_mtime", "mtime_us")


def read_log_lines(
    spark: SparkSession,
    root: str,
    source: str,
    *,
    since: int | None = None,
    scope: Column | str = "",
    pattern: str | None = None,
) -> DataFrame:
    """Lines of every log file of ``source`` below ``root``.

    ``since`` skips whole files last modified before it.  ``scope`` is the user or
    organisation: a constant, or a column computed from ``file_path``.

    Spark's reader indexes the files on the driver; those of a large tree are listed and read by tasks.
    """
    files = _many_files(spark, root, source, since, scope, pattern)
    if files is not None and files.filter(F.col("file_path").rlike(PACKED)).isEmpty():
        split = min(SPLIT, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
        lines = read_ranges(files.withColumn("begin", F.lit(0).cast("bigint")), split)
        marked = (F.col("block_start") == 0) & (F.col("line_seq") == 0) & F.col("value").startswith("\ufeff")  # as Spark's reader drops it
        return lines.withColumn("value", F.when(marked, F.expr("substring(value, 2)")).otherwise(F.col("value"))).select(*LINE_COLUMNS)
    raw = _reader(spark, source, pattern, since).text(root)
    raw = raw.select("value", "_metadata", F.monotonically_increasing_id().alias("line_seq"))
    return _lineage(scope, source, since, raw).select(*LINE_COLUMNS)


def list_files(
    spark: SparkSession,
    root: str,
    source: str,
    *,
    since: int | None = None,
    scope: Column | str = "",
    pattern: str | None = None,
) -> DataFrame:
    """Manifest of log files: scope, source, file_path, file_size, file_mtime, mtime_us.

    Only the listing is used; the ``content`` column is never asked for.  A large tree is listed by tasks.
    """
    files = _many_files(spark, root, source, since, scope, pattern)
    if files is not None:
        return files
    raw = _reader(spark, source, pattern, since).format("binaryFile").load(root)
    listed = _lineage(scope, source, since, raw.select("_metadata"))
    return listed.select(
        "scope", "source", "file_path", "file_size", "file_mtime", F.col("_mtime_us").alias("mtime_us")
    )


def manifest_fingerprint(files: DataFrame) -> DataFrame:
    """Order-free fingerprint of a manifest: equal rows mean that no file changed."""
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(
            F.bit_xor(F.xxhash64("source", "file_path", "mtime_us", "file_size")), F.lit(0)
        ).alias("fingerprint"),
    )


def select_sources(df: DataFrame, sources: list[str]) -> DataFrame:
    """Rows of the listed sources; an unknown name selects nothing, an empty list no row at all."""
    wanted = [s for s in dict.fromkeys(sources) if s in PATTERNS]
    return df.filter(F.col("source").isin(wanted) if wanted else F.lit(False))


def _is_candidate(source: str) -> Column:
    hits = [F.col("value").contains(t) for t in CANDIDATE_TEXT[source]]
    return hits[0] if len(hits) == 1 else hits[0] | hits[1]


def _typed(source: str) -> Column:
    """Typed line.  ``_bad`` is set when any field has the wrong type."""
    return F.from_json(
        "value", SCHEMAS[source] + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}
    )


def _whole(typed: Column) -> Column:
    """The whole line is one well-typed object: one wrong field drops the line."""
    return F.coalesce(typed["_bad"].isNull() & F.rtrim("value").endswith("}"), F.lit(False))


def _candidates(lines: DataFrame, source: str) -> DataFrame:
    """Parsed candidate lines as column ``j``.

    The parse sits in a generator: filters on ``j`` stay above it, so a line is parsed once.
    """
    return _parsed(lines, source, _is_candidate(source))


def _parsed(lines: DataFrame, source: str, wanted: Column) -> DataFrame:
    rows = lines.filter((F.col("source") == source) & wanted)
    if "_typed" in lines.columns:  # parsed while it was counted
        return rows.withColumnRenamed("_typed", "j").filter(_whole(F.col("j")))
    return rows.select("*", F.explode(F.array(_typed(source))).alias("j")).filter(_whole(F.col("j")))


def _wanted(source: str) -> Column:
    """Lines a parser reads: Codex lines also for the folder they name."""
    return _is_candidate(source) | F.col("value").contains('"cwd"') if source == "codex" else _is_candidate(source)


def _counter(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def _no_negative(*columns: Column) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.coalesce(c, F.lit(0)) >= 0)
    return ok


def tool_names(content: Column) -> Column:
    """Names of the tools a message used, from its ``content`` parts."""
    parts = F.coalesce(content, F.array().cast("array<struct<type:string,name:string>>"))
    used = F.filter(parts, lambda p: (p["type"] == "tool_use") & p["name"].isNotNull())
    return F.transform(used, lambda p: p["name"])


def parse_claude(lines: DataFrame) -> DataFrame:
    """One row per line that carries ``message.usage``."""
    u, m = F.col("j.message.usage"), F.col("j.message")
    split = u["cache_creation"]
    counters = [
        u["input_tokens"], u["output_tokens"], u["cache_read_input_tokens"],
        u["cache_creation_input_tokens"], split["ephemeral_1h_input_tokens"],
        split["ephemeral_5m_input_tokens"],
    ]
    rows = _candidates(lines, "claude").filter(u.isNotNull() & _no_negative(*counters))
    creation = _counter(u["cache_creation_input_tokens"])
    write_1h = _counter(split["ephemeral_1h_input_tokens"])
    return rows.select(
        *PLACE,
        F.coalesce("j.requestId", "j.message.id", "j.uuid").alias("dedup_key"),
        F.coalesce(epoch_of_rfc3339("j.timestamp"), F.lit(0).cast("bigint")).alias("ts"),
        F.coalesce(m["model"], F.lit(DEFAULT_CLAUDE_MODEL)).alias("model"),
        path_part("file_path", 2).alias("project"),
        dominant_kind(tool_names(m["content"])).alias("kind"),
        _counter(u["input_tokens"]).alias("input"),
        _counter(u["output_tokens"]).alias("output"),
        _counter(u["cache_read_input_tokens"]).alias("cache_read"),
        F.coalesce(
            split["ephemeral_5m_input_tokens"], F.greatest(creation - write_1h, F.lit(0))
        ).alias("cache_write_5m"),
        write_1h.alias("cache_write_1h"),
        (_counter(u["cache_read_input_tokens"]) + creation).alias("cached"),
    )


def observed_lines(lines: DataFrame, source: str, seen: Observation) -> DataFrame:
    """The lines of one source, counted while they are parsed: ``lines, candidates, parsed``."""
    typed = lines.select("*", F.explode(F.array(F.when(_wanted(source), _typed(source)))).alias("_typed"))
    return typed.observe(
        seen, F.count(F.lit(1)).alias("lines"), F.count_if(_is_candidate(source)).alias("candidates"),
        F.count_if(_is_candidate(source) & _whole(F.col("_typed"))).alias("parsed"),
    )


def parse_codex_lines(lines: DataFrame) -> DataFrame:
    """One row per line with a counter event or a folder: each line is read and parsed once for both.

    ``ts`` and the counters are NULL on a row that only names a folder, ``folder`` on one without.
    """
    usage = F.coalesce("j.payload.info.total_token_usage", "j.payload.total_token_usage")
    every = [
        F.col(f"j.payload.{place}.{f}")
        for place in ("info.total_token_usage", "total_token_usage")
        for f in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
    ]
    rows = _parsed(lines, "codex", _wanted("codex"))
    counts = _is_candidate("codex") & (F.col("j.payload.type") == "token_count") & _no_negative(*every) & usage.isNotNull()
    named = basename("j.payload.cwd")
    rows = rows.select(
        *PLACE, F.when(counts, epoch_of_variant("j.timestamp")).alias("ts"), usage.alias("u"), F.when(named != "", named).alias("folder"))
    parts = {"input": "input_tokens", "cached": "cached_input_tokens", "output": "output_tokens", "reasoning": "reasoning_output_tokens"}
    return rows.select(
        *PLACE, "ts", *[F.when(F.col("ts").isNotNull(), _counter(F.col(f"u.{f}"))).alias(c) for c, f in parts.items()], "folder",
    ).filter(F.col("ts").isNotNull() | F.col("folder").isNotNull())


def codex_counters(rows: DataFrame) -> DataFrame:
    """Counter rows of ``parse_codex_lines`` with the project of their file: the first folder named in it."""
    files = rows.filter(F.col("folder").isNotNull()).groupBy("scope", "file_path").agg(
        F.min_by("folder", F.struct("block_start", "line_seq")).alias("project"))
    counters = rows.filter(F.col("ts").isNotNull()).drop("folder").join(files, ["scope", "file_path"], "left")
    return counters.withColumn("project", F.coalesce("project", F.lit("")))


def parse_codex(lines: DataFrame) -> DataFrame:
    """One row per cumulative counter event."""
    usage = F.coalesce("j.payload.info.total_token_usage", "j.payload.total_token_usage")
    every = [
        F.col(f"j.payload.{place}.{f}")
        for place in ("info.total_token_usage", "total_token_usage")
        for f in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
    ]
    rows = (
        _candidates(lines, "codex")
        .filter((F.col("j.payload.type") == "token_count") & _no_negative(*every))
        .withColumn("u", usage)
        .filter(F.col("u").isNotNull())
    )
    return rows.select(
        *PLACE,
        epoch_of_variant("j.timestamp").alias("ts"),
        _counter(F.col("u.input_tokens")).alias("input"),
        _counter(F.col("u.cached_input_tokens")).alias("cached"),
        _counter(F.col("u.output_tokens")).alias("output"),
        _counter(F.col("u.reasoning_output_tokens")).alias("reasoning"),
    ).filter(F.col("ts").isNotNull())


def codex_project(lines: DataFrame, head: int | None = None) -> DataFrame:
    """Project per file: first non-empty folder name of ``payload.cwd``, anywhere in the file.

    Only lines that name a folder are parsed, and a file's first one is a partial aggregate: no text
    is sorted or shuffled.  With ``head`` only the first ``head`` lines of a file count.
    """
    named = F.col("value").contains('"cwd"')
    mine = lines.filter(F.col("source") == "codex")
    place = F.struct("block_start", "line_seq")
    if head is not None:
        in_file = Window.partitionBy("scope", "file_path").orderBy("block_start", "line_seq")
        mine = mine.withColumn("n", F.row_number().over(in_file)).filter(F.col("n") <= head)
    parsed = mine.filter(named).select(
        "scope", "file_path", "value", place.alias("place"), F.explode(F.array(_typed("codex"))).alias("j"))
    project = F.when(_whole(F.col("j")), basename("j.payload.cwd"))
    found = parsed.select("scope", "file_path", "place", project.alias("project")).filter(F.col("project") != "")
    return found.groupBy("scope", "file_path").agg(F.min_by("project", "place").alias("project"))


def parse_grok(lines: DataFrame) -> DataFrame:
    """One row per model update or cumulative token reading (``cumulative`` NULL without one)."""
    model = F.coalesce("j.params.update._meta.modelId", "j.params._meta.modelId", "j._meta.modelId")
    total = F.coalesce("j._meta.totalTokens", "j.params._meta.totalTokens")
    every = [
        F.col(f"j.{place}.totalTokens") for place in ("_meta", "params._meta", "params.update._meta")
    ]
    ts = epoch_of_variant("j.timestamp")
    rows = _candidates(lines, "grok").filter(_no_negative(*every))
    return rows.select(
        *PLACE,
        basename(percent_decode(path_part("file_path", 3))).alias("project"),
        F.when(model != "", model).alias("model_update"),
        F.when(total.isNotNull(), ts).alias("ts"),
        F.when(ts.isNotNull(), total).alias("cumulative"),
    ).filter(F.col("model_update").isNotNull() | F.col("cumulative").isNotNull())


def ingest_metrics(lines: DataFrame, files: DataFrame | None = None, since: int | None = None) -> DataFrame:
    """Counters per source: files considered and read, eligible bytes, lines, candidates, JSON ok.

    ``files`` is the manifest before the ``since`` gate; without it, files are those that
    contributed a line.
    """
    if since is not None:
        lines = lines.filter(F.col("file_mtime") >= since)
    candidate, parsed = F.lit(False), F.lit(None).cast("boolean")
    for source in PATTERNS:
        here = F.col("source") == source
        candidate = F.when(here, _is_candidate(source)).otherwise(candidate)
        parsed = F.when(here & _is_candidate(source), _whole(_typed(source))).otherwise(parsed)
    per_file = lines.groupBy("source", "scope", "file_path").agg(
        F.max("file_size").alias("bytes"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(candidate).alias("candidates"),
        F.count_if(parsed).alias("parsed"),
    )
    counted = per_file.groupBy("source").agg(
        F.count(F.lit(1)).alias("files_read"),
        F.sum("bytes").alias("eligible_file_bytes"),
        F.sum("lines").alias("lines_read"),
        F.sum("candidates").alias("candidate_lines"),
        F.sum("parsed").alias("json_parse_ok"),
    )
    if files is None:
        return counted.withColumn("files_considered", F.col("files_read"))
    gate = F.lit(True) if since is None else F.col("file_mtime") >= since
    seen = files.groupBy("source").agg(
        F.count(F.lit(1)).alias("files_considered"),
        F.count_if(gate).alias("files_read"),
        F.coalesce(F.sum(F.when(gate, F.col("file_size"))), F.lit(0)).alias("eligible_file_bytes"),
    )
    zero = F.lit(0).cast("bigint")
    return seen.join(counted.drop("files_read", "eligible_file_bytes"), "source", "left").select(
        "source", "files_considered", "files_read", "eligible_file_bytes",
        *[F.coalesce(c, zero).alias(c) for c in ("lines_read", "candidate_lines", "json_parse_ok")],
    )

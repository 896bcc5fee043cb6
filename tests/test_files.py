"""Files: reading, pruning, counters, price files, incremental refresh, quota history tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from helpers import claude, codex, grok_model, grok_token
from meterloom.operators.counters import book_claude
from meterloom.plans.maintained import read_usage_days, refresh_usage_days
from meterloom.plans.report import usage_events, usage_events_from_silver
from meterloom.sources import logs
from meterloom.sources.prices import load_price_rules
from meterloom.sources.quota import read_quota_history, write_quota_history
from meterloom.sources.refresh import PARSER_VERSION, current_events, current_manifest, drop_superseded, merge_refreshes, refresh_events, refresh_metrics

T0 = 1_784_000_000


def put(root, path, texts, mtime=T0 + 1_000):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write("".join(t + "\n" for t in texts))
    os.utime(full, (mtime, mtime))
    return full


def test_names_patterns_and_encoded_paths(spark, tmp_path):
    root = str(tmp_path)
    put(root, "sessions/2026/rollout-a.jsonl", [codex(T0, 5), "{}"])
    put(root, "sessions/2026/other.jsonl", [codex(T0, 9)])
    put(root, "sessions/C%3A%5Cwork%5Cmy+proj x/s1/updates.jsonl", [grok_token(T0, 7)])
    got = logs.read_log_lines(spark, root, "codex").orderBy("line_seq").collect()
    assert [r["value"] for r in got] == [codex(T0, 5), "{}"] and got[0]["file_path"] == f"{root}/sessions/2026/rollout-a.jsonl"
    assert got[0]["file_mtime"] == T0 + 1_000 and got[0]["block_start"] == 0
    row = logs.parse_grok(logs.read_log_lines(spark, root, "grok")).first()
    assert row["project"] == "my+proj x" and row["cumulative"] == 7
    by_path = F.regexp_extract("file_path", r"/sessions/(\d+)/", 1)
    assert logs.read_log_lines(spark, root, "codex", scope=by_path).first()["scope"] == "2026"


def test_line_order_across_splits(spark, tmp_path):
    put(str(tmp_path), "p/a.jsonl", [f'{{"n":{i},"pad":"{"x" * 50}"}}' for i in range(3_000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        lines = logs.read_log_lines(spark, str(tmp_path), "claude")
        rows = lines.select("block_start", "line_seq", F.get_json_object("value", "$.n").cast("int").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r["block_start"] for r in rows}) > 3
    assert [r["n"] for r in sorted(rows, key=lambda r: (r["block_start"], r["line_seq"]))] == list(range(3_000))


def test_old_files_are_skipped_whole(spark, tmp_path):
    root = str(tmp_path)
    put(root, "p/old.jsonl", [claude(mid="k", input_tokens=5, ts="2030-01-01T00:00:00Z")], mtime=T0 - 1)
    put(root, "p/edge.jsonl", [claude(mid="k", input_tokens=7, ts="2030-01-01T00:00:00Z")], mtime=T0)
    lines = logs.read_log_lines(spark, root, "claude", since=T0)
    assert [os.path.basename(r["file_path"]) for r in lines.collect()] == ["edge.jsonl"]
    assert book_claude(logs.parse_claude(lines)).first()["total"] == 7
    files = logs.list_files(spark, root, "claude")
    assert files.count() == 2 and logs.list_files(spark, root, "claude", since=T0).count() == 1
    stats = logs.ingest_metrics(logs.read_log_lines(spark, root, "claude"), files, T0).first().asDict()
    assert stats == {
        "source": "claude", "files_considered": 2, "files_read": 1, "eligible_file_bytes": os.path.getsize(f"{root}/p/edge.jsonl"),
        "lines_read": 1, "candidate_lines": 1, "json_parse_ok": 1,
    }


def test_ingest_counters(spark, tmp_path):
    put(str(tmp_path), "p/a.jsonl", [claude(input_tokens=1), '{"usage":1}', '{"usage": broken', "plain"])
    row = logs.ingest_metrics(logs.read_log_lines(spark, str(tmp_path), "claude")).first()
    assert (row["lines_read"], row["candidate_lines"], row["json_parse_ok"]) == (4, 3, 2)


def test_manifest_is_listing_only_and_fingerprint_is_order_free(spark, tmp_path):
    root = str(tmp_path)
    put(root, "p/a.jsonl", ["a"]), put(root, "p/b.jsonl", ["b"])
    files = logs.list_files(spark, root, "claude")
    first = logs.manifest_fingerprint(files).first()
    assert logs.manifest_fingerprint(files.orderBy(F.desc("file_path"))).first() == first
    put(root, "p/b.jsonl", ["b", "c"])
    assert logs.manifest_fingerprint(logs.list_files(spark, root, "claude")).first() != first
    assert logs.manifest_fingerprint(files.filter("false")).first()["files"] == 0


def test_price_file(spark, tmp_path):
    path = str(tmp_path / "prices.json")
    assert load_price_rules(spark, path)[0].count() == 0
    with open(path, "w") as f:
        json.dump({"models": {"Opus": {"blended": 2}}}, f, indent=2)
    assert [(r["key"], r["blended"]) for r in load_price_rules(spark, path)[0].collect()] == [("opus", 2.0)]
    with open(path, "a") as f:
        f.write(" " * 1024 * 1024)
    assert load_price_rules(spark, path)[0].count() == 1  # the size of a file does not matter


def totals(df):
    rows = df.groupBy("agent", "model", "project").agg(F.sum("total").alias("t"), F.round(F.sum("cost"), 9).alias("c")).collect()
    return sorted(map(tuple, rows))


def direct(spark, root):
    lines = None
    for source in ("claude", "codex", "grok"):
        part = logs.read_log_lines(spark, root, source, pattern={"claude": "c-*.jsonl"}.get(source))
        lines = part if lines is None else lines.unionByName(part)
    return usage_events(lines, ["claude", "codex", "grok"])


def refreshed(spark, root, silver):
    counts = [refresh_events(spark, root, silver, s, pattern={"claude": "c-*.jsonl"}.get(s)) for s in ("claude", "codex", "grok")]
    return counts, usage_events_from_silver({s: current_events(spark, silver, s) for s in ("claude", "codex", "grok")})


def test_incremental_refresh_equals_full_scan(spark, tmp_path):
    root, silver = str(tmp_path / "logs"), str(tmp_path / "silver")
    shared = claude(mid="same", model="claude-opus-4", input_tokens=10)
    cwd = json.dumps({"payload": {"cwd": "/work/alpha"}})
    put(root, "p/c-1.jsonl", [shared, claude(mid="x", input_tokens=1)])
    put(root, "p/c-2.jsonl", [shared])
    put(root, "s/rollout-1.jsonl", [cwd, codex(T0, 100), codex(T0 + 5, 250)])
    put(root, "g/%2Fw%2Fproj/s1/updates.jsonl", [grok_model(T0, "grok-4.5"), grok_token(T0 + 1, 40)])
    counts, rows = refreshed(spark, root, silver)
    assert counts == [2, 1, 1] and totals(rows) == totals(direct(spark, root))

    counts, rows = refreshed(spark, root, silver)
    assert counts == [0, 0, 0] and totals(rows) == totals(direct(spark, root))

    # append to one file, add another, remove the file that held the first copy
    put(root, "s/rollout-1.jsonl", [cwd, codex(T0, 100), codex(T0 + 5, 250), codex(T0 + 9, 300)], mtime=T0 + 2_000)
    put(root, "p/c-3.jsonl", [claude(mid="y", input_tokens=6)], mtime=T0 - 50)
    os.remove(f"{root}/p/c-1.jsonl")
    counts, rows = refreshed(spark, root, silver)
    assert counts == [1, 1, 0] and totals(rows) == totals(direct(spark, root))
    names = sorted(os.path.basename(r["file_path"]) for r in current_manifest(spark, silver, "claude").collect())
    assert names == ["c-2.jsonl", "c-3.jsonl"]

    # a new parser version parses everything again; a refresh that died leaves no trace
    assert refresh_events(spark, root, silver, "codex", parser=PARSER_VERSION + 1) == 1
    assert totals(usage_events_from_silver({"codex": current_events(spark, silver, "codex")})) == [("Codex CLI", "gpt-5-codex", "alpha", 300, 0.0015)]


def test_maintained_days_equal_full_scan(spark, tmp_path):
    """Appended, removed and copied files: only touched days are booked again, and the sums stay those of a full scan."""
    root, silver, cube = (str(tmp_path / d) for d in ("logs", "silver", "cube"))
    day = 86_400
    stamp = lambda k: f"2026-07-1{k}T01:00:00Z"

    def step():
        for s in ("claude", "codex"):
            refresh_events(spark, root, silver, s, pattern={"claude": "c-*.jsonl"}.get(s))
        run = refresh_usage_days(spark, silver, cube, ["claude", "codex"])
        assert totals(read_usage_days(spark, cube)) == totals(direct(spark, root))
        return run

    put(root, "p/c-1.jsonl", [claude(mid="same", input_tokens=10, ts=stamp(1)), claude(mid="x", input_tokens=1, ts=stamp(2))])
    put(root, "p/c-2.jsonl", [claude(mid="same", input_tokens=10, ts=stamp(3)), claude(mid="z", input_tokens=3, ts=stamp(5))])
    put(root, "s/rollout-1.jsonl", [codex(T0, 100), codex(T0 + day, 250)])
    assert step() == 0
    assert refresh_usage_days(spark, silver, cube, ["claude", "codex"]) == -1
    put(root, "s/rollout-1.jsonl", [codex(T0, 100), codex(T0 + day, 250), codex(T0 + day + 9, 300)], mtime=T0 + 2_000)
    os.remove(f"{root}/p/c-1.jsonl")  # the copy of its first message, two days later, counts from now on
    put(root, "p/c-3.jsonl", [claude(mid="z", input_tokens=3, ts=stamp(5))], mtime=T0 + 5)
    assert step() == 1
    booked = {str(r["date"]) for r in spark.read.parquet(f"{cube}/days/run=1").select("date").distinct().collect()}
    assert {"2026-07-13", "2026-07-15"} <= booked and not booked & {"2026-07-11", "2026-07-12"}


def test_interrupted_refresh_is_invisible_and_repeatable(spark, tmp_path):
    root, silver = str(tmp_path / "logs"), str(tmp_path / "silver")
    put(root, "p/a.jsonl", [claude(mid="x", input_tokens=1)])
    refresh_events(spark, root, silver, "claude")
    put(root, "p/b.jsonl", [claude(mid="y", input_tokens=2)])
    refresh_events(spark, root, silver, "claude")
    os.remove(f"{silver}/claude/manifest/refresh=1/_SUCCESS")  # died before the commit
    assert current_events(spark, silver, "claude").count() == 1
    assert refresh_events(spark, root, silver, "claude") == 1
    assert current_events(spark, silver, "claude").count() == 2
    assert current_events(spark, silver, "claude", since=T0 + 1_001).count() == 0


def test_quota_history_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "history")
    samples = spark.createDataFrame([("s", "a", 1, 2.0)], "scope string, limit_id string, ts long, util double")
    resets = spark.createDataFrame([("s", "a", 1, 9)], "scope string, limit_id string, ts long, resets_at long")
    for batch in (0, 1, 1):
        write_quota_history(samples, resets, path, batch)
    kept, points = read_quota_history(spark, path)
    assert kept.count() == 2 and points.count() == 2 and kept.columns == ["scope", "limit_id", "ts", "util"]


def test_empty_sources(spark):
    none = spark.createDataFrame([], "scope string, source string, file_path string, block_start long, line_seq long, file_mtime long, file_size long, value string")
    assert usage_events(none, []).count() == 0
    assert logs.select_sources(none, []).count() == 0
    with pytest.raises(KeyError):
        logs.read_log_lines(spark, "/nowhere", "unknown")


def counters(spark, silver, source):
    return [tuple(r) for r in refresh_metrics(spark, silver, source).orderBy("refresh").select("files_read", "files_grown", "lines_read", "candidate_lines", "json_parse_ok").collect()]


def test_a_grown_file_is_read_from_its_old_end(spark, tmp_path):
    root, silver = str(tmp_path / "logs"), str(tmp_path / "silver")
    old = [claude(mid=f"m{k}", input_tokens=k + 1) for k in range(200)]
    put(root, "p/a.jsonl", old), put(root, "p/b.jsonl", old[:1])
    assert refresh_events(spark, root, silver, "claude") == 2
    put(root, "p/a.jsonl", [*old, claude(mid="new", input_tokens=7)], mtime=T0 + 2_000)
    assert refresh_events(spark, root, silver, "claude") == 1 and refresh_events(spark, root, silver, "claude") == 0
    put(root, "p/a.jsonl", [*old, claude(mid="new", input_tokens=7), "other", '{"usage": broken'], mtime=T0 + 3_000)
    assert refresh_events(spark, root, silver, "claude") == 1
    assert counters(spark, silver, "claude") == [(2, 0, 201, 201, 201), (1, 1, 1, 1, 1), (0, 0, 0, 0, 0), (1, 1, 2, 1, 0)]
    rows = current_events(spark, silver, "claude")
    assert rows.count() == 202 and [r["input"] for r in rows.filter("file_path LIKE '%a.jsonl'").orderBy("block_start", "line_seq").collect()] == [*range(1, 201), 7]


def test_a_rewrite_of_equal_size_and_time_is_noticed(spark, tmp_path):
    root, silver = str(tmp_path / "logs"), str(tmp_path / "silver")
    put(root, "p/a.jsonl", [claude(mid="k", input_tokens=5)])
    refresh_events(spark, root, silver, "claude")
    put(root, "p/a.jsonl", [claude(mid="k", input_tokens=8)])
    assert refresh_events(spark, root, silver, "claude") == 1
    assert [r["input"] for r in current_events(spark, silver, "claude").collect()] == [8]


@pytest.mark.parametrize("change", ["other head", "open end"])
def test_growth_of_another_kind_means_the_whole_file(spark, tmp_path, change):
    root, silver = str(tmp_path / "logs"), str(tmp_path / "silver")
    full = put(root, "p/a.jsonl", [claude(mid="k", input_tokens=5), claude(mid="l", input_tokens=6)])
    if change == "open end":
        os.truncate(full, os.path.getsize(full) - 9)
    refresh_events(spark, root, silver, "claude")
    put(root, "p/a.jsonl", [claude(mid="k" if change == "open end" else "j", input_tokens=5), claude(mid="l", input_tokens=6), claude(mid="m", input_tokens=9)], mtime=T0 + 5_000)
    assert refresh_events(spark, root, silver, "claude") == 1
    assert sorted(r["input"] for r in current_events(spark, silver, "claude").collect()) == [5, 6, 9]
    assert counters(spark, silver, "claude")[1][:2] == (1, 0)


def test_lines_of_ranges_equal_the_files(spark, tmp_path):
    from meterloom.sources.ranges import read_ranges

    texts = ["", "é" * 500, "short", "", "x" * 3_000, "y\u2028z", *[f"line {k}" for k in range(400)], "no end"]
    full = put(str(tmp_path), "p/a.jsonl", texts)
    os.truncate(full, os.path.getsize(full) - 1)
    put(str(tmp_path), "p/empty.jsonl", [])
    files = logs.list_files(spark, str(tmp_path), "claude").withColumn("begin", F.lit(0).cast("bigint"))
    for split in (1, 7, 64, 1_000, 1 << 20):
        got = read_ranges(files, split).orderBy("block_start", "line_seq").collect() if split > 60 else read_ranges(files.filter("file_size > 0").withColumn("begin", F.col("file_size") - 200), split).orderBy("block_start", "line_seq").collect()
        want = texts if split > 60 else "\n".join(texts).encode()[-200:].decode().split("\n")
        assert [r["value"] for r in got] == want, split


def test_project_named_before_or_after_the_growth(spark, tmp_path):
    root, silver = str(tmp_path / "logs"), str(tmp_path / "silver")
    cwd = json.dumps({"payload": {"cwd": "/work/alpha"}})
    put(root, "s/rollout-1.jsonl", [cwd, codex(T0, 100)]), put(root, "s/rollout-2.jsonl", [codex(T0 + 1, 30)])
    refresh_events(spark, root, silver, "codex")
    put(root, "s/rollout-1.jsonl", [cwd, codex(T0, 100), codex(T0 + 5, 250)], mtime=T0 + 2_000)
    put(root, "s/rollout-2.jsonl", [codex(T0 + 1, 30), cwd, codex(T0 + 9, 50)], mtime=T0 + 2_000)
    assert refresh_events(spark, root, silver, "codex") == 2
    rows = usage_events_from_silver({"codex": current_events(spark, silver, "codex")})
    assert totals(rows) == totals(usage_events(logs.read_log_lines(spark, root, "codex"), ["codex"])) and {r["project"] for r in rows.collect()} == {"alpha"}


def test_merged_refreshes_hold_the_rows_in_force(spark, tmp_path):
    root, silver = str(tmp_path / "logs"), str(tmp_path / "silver")
    put(root, "p/a.jsonl", [claude(mid="a", input_tokens=1)]), put(root, "p/b.jsonl", [claude(mid="b", input_tokens=2)])
    refresh_events(spark, root, silver, "claude")
    put(root, "p/a.jsonl", [claude(mid="a", input_tokens=1), claude(mid="c", input_tokens=4)], mtime=T0 + 2_000)
    put(root, "p/b.jsonl", [claude(mid="b", input_tokens=3)], mtime=T0 + 2_000)
    refresh_events(spark, root, silver, "claude")
    before = current_events(spark, silver, "claude")
    want = sorted(r["input"] for r in before.collect())
    assert want == [1, 3, 4] and drop_superseded(spark, silver, "claude") == []
    merge_refreshes(spark, silver, "claude")
    assert sorted(r["input"] for r in before.collect()) == want  # a reader from before still finds its folders
    merged = current_events(spark, silver, "claude")
    assert sorted(r["input"] for r in merged.collect()) == want
    assert drop_superseded(spark, silver, "claude", keep=1) == [0, 1] and sorted(r["input"] for r in current_events(spark, silver, "claude").collect()) == want
    put(root, "p/a.jsonl", [claude(mid="a", input_tokens=1), claude(mid="c", input_tokens=4), claude(mid="d", input_tokens=9)], mtime=T0 + 3_000)
    assert refresh_events(spark, root, silver, "claude") == 1 and sorted(r["input"] for r in current_events(spark, silver, "claude").collect()) == [1, 3, 4, 9]


def test_maintained_days_after_growth_and_merge(spark, tmp_path):
    root, silver, sums = (str(tmp_path / d) for d in ("logs", "silver", "sums"))
    first = claude(mid="a", input_tokens=1, ts="2026-07-01T10:00:00Z")
    put(root, "p/a.jsonl", [first]), put(root, "p/b.jsonl", [claude(mid="b", input_tokens=2, ts="2026-07-02T10:00:00Z")])
    refresh_events(spark, root, silver, "claude")
    refresh_usage_days(spark, silver, sums, ["claude"])
    put(root, "p/a.jsonl", [first, claude(mid="b", input_tokens=2, ts="2026-07-03T10:00:00Z")], mtime=T0 + 2_000)
    refresh_events(spark, root, silver, "claude")
    run = refresh_usage_days(spark, silver, sums, ["claude"])
    days = {str(r["date"]) for r in spark.read.parquet(f"{sums}/runs/run={run}").filter("date IS NOT NULL").collect()}
    assert days == {"2026-07-02", "2026-07-03"}  # the grown line's day and that of its copy elsewhere
    merge_refreshes(spark, silver, "claude")
    refresh_usage_days(spark, silver, sums, ["claude"])
    got = {(str(r["date"]), r["total"]) for r in read_usage_days(spark, sums).collect()}
    full = usage_events_from_silver({"claude": current_events(spark, silver, "claude")})
    assert got == {(d, t) for d, t in (("2026-07-01", 1), ("2026-07-03", 2))} and full.agg(F.sum("total")).first()[0] == 3


def test_user_files_reach_the_reader_whole(spark):
    """One plain file per user and million of event ids, without a folder and a checksum for each; none is hidden from the reader."""
    from pathlib import Path

    from meterloom.registry.usage_queries import _written_lines
    from meterloom.sources.logs import read_log_lines

    rows = [(path, n, f"{path} {n}") for path, ns in (("/logs/p1/s1.jsonl", [7, 3, 1_000_001]), ("/logs/p2/s2.jsonl", [5]), (None, [9])) for n in ns]
    root = _written_lines(spark, spark.createDataFrame(rows, "file_path string, line_seq long, value string"))
    files = [p for p in Path(root).rglob("*") if p.is_file()]
    assert len(files) == 4 and all(p.suffix == ".txt" for p in files)
    got = [r["value"] for r in read_log_lines(spark, root, "claude", pattern="*.txt").orderBy("file_path", "block_start", "line_seq").collect()]
    assert sorted(got) == sorted(v for *_, v in rows)
    assert got.index("/logs/p1/s1.jsonl 3") < got.index("/logs/p1/s1.jsonl 7")


def test_a_file_is_listed_once_to_be_sampled(spark, tmp_path):
    from meterloom.sources.logs import list_files
    from meterloom.sources.refresh import MANIFEST, _plan

    root = str(tmp_path / "logs")
    put(root, "p/a.jsonl", [claude(mid="a", input_tokens=1)])
    plan = _plan(list_files(spark, root, "claude"), spark.createDataFrame([], MANIFEST), 0, 1)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Scan binaryFile") == 1
    assert plan.select("begin", "parts").collect() == [(0, [0])]


def test_many_short_files_are_listed_in_few_tasks_and_read_in_few_batches(spark, tmp_path, monkeypatch):
    from meterloom.sources import ranges
    from meterloom.sources.logs import list_files
    from meterloom.sources.refresh import MANIFEST, _plan

    root = str(tmp_path / "logs")
    put(root, "p/a.jsonl", [claude(mid="a", input_tokens=1)])
    plan = _plan(list_files(spark, root, "claude"), spark.createDataFrame([], MANIFEST), 0, 1)
    assert f"Coalesce {4 * spark.sparkContext.defaultParallelism}" in plan._jdf.queryExecution().executedPlan().toString()

    row = lambda n: {"scope": None, "source": "claude", "file_path": f"f{n}", "first": n, "file_mtime": 1, "file_size": 2}
    pieces = [(row(n), 5 * n, [b"x"] * (n % 3) + [b"\xff"] * (n == 7)) for n in range(100)]
    (batch,) = ranges.line_batches(iter(pieces))
    got = [(r["file_path"], r["block_start"], r["line_seq"], r["value"]) for r in batch.to_pylist()]
    assert got == [(f"f{n}", n, first + k, v.decode("utf-8", "replace")) for n, (_, first, lines) in enumerate(pieces) for k, v in enumerate(lines)]
    monkeypatch.setattr(ranges, "STEP", 10)
    assert max(b.num_rows for b in ranges.line_batches(iter(pieces))) < 10 and list(ranges.line_batches(iter([]))) == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_large_tree_is_listed_by_tasks_as_spark_lists_it(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "my logs%")
    for k in range(30):
        put(root, f"p{k % 7}/é {k % 3}/{k}.jsonl", ["x" * k], mtime=T0 + k)
    for path in ("p0/_left.jsonl", "p0/.left.jsonl", "_left/a.jsonl", ".left/a.jsonl", "p0/a._COPYING_", "p0/other.json", "_k=1/in.jsonl"):
        put(root, path, ["y"])
    os.utime(f"{root}/p1/é 1/1.jsonl", ns=(0, T0 * 10**9 + 123_456_789))
    put(root, "empty.jsonl", []), os.symlink(f"{root}/p2", f"{root}/linked")
    user = F.regexp_extract("file_path", r"/p(\d+)/", 1)
    shown = lambda pattern=None, since=None, at=root: sorted(map(tuple, logs.list_files(spark, at, "claude", pattern=pattern, since=since, scope=user).collect()))
    cases = [(None, None), ("[12]*.{jsonl,json}", None), ("1?.json*", T0 + 12), ("nothing", None)]
    indexed = [shown(*case) for case in cases]
    monkeypatch.setattr(logs, "INDEXED", 5)
    for case, want in zip(cases, indexed):
        got = shown(*case)
        assert (sorted(set(got) - set(want)), sorted(set(want) - set(got)), len(got)) == ([], [], len(want)), case
    assert len(indexed[0]) > 30
    assert shown(at=f"file://{tmp_path}/my logs%/") == indexed[0] and shown(at=f"{tmp_path}/my*") == indexed[0]
    listed = logs.list_files(spark, root, "claude")
    assert "binaryFile" not in plan_of(listed)
    put(root, "later.jsonl", ["z"])  # a listing stays what it was, as Spark's index does
    assert listed.count() == len(indexed[0]) and logs.list_files(spark, root, "claude").count() == len(indexed[0]) + 1


def test_refresh_of_a_large_tree_indexes_nothing_on_the_driver(spark, tmp_path, monkeypatch):
    from meterloom.sources import refresh

    monkeypatch.setattr(logs, "INDEXED", 2)
    root, silver = str(tmp_path / "logs"), str(tmp_path / "silver")
    for k in range(5):
        put(root, f"flat/{k}.jsonl", [claude(mid=f"m{k}", input_tokens=k + 1)])
    plans, plan = [], refresh._plan
    monkeypatch.setattr(refresh, "_plan", lambda *a: plans.append(p := plan(*a)) or p)
    assert refresh_events(spark, root, silver, "claude") == 5 and refresh_events(spark, root, silver, "claude") == 0
    put(root, "flat/1.jsonl", [claude(mid="m1", input_tokens=2), claude(mid="n", input_tokens=10)], mtime=T0 + 2_000)
    os.remove(f"{root}/flat/0.jsonl"), os.remove(f"{root}/flat/4.jsonl")
    assert refresh_events(spark, root, silver, "claude") == 1
    assert sorted(r["input"] for r in current_events(spark, silver, "claude").collect()) == [2, 3, 4, 10]
    os.remove(f"{root}/flat/2.jsonl")  # few enough for the index: the files that stay are known
    assert refresh_events(spark, root, silver, "claude") == 0 and current_events(spark, silver, "claude").count() == 3
    assert len(plans) == 4 and ["binaryFile" in plan_of(p) for p in plans] == [False, False, False, True]


@pytest.mark.parametrize("name", ["claude_rows behind _written_lines", "claude_rows behind put_files"])
def test_log_text_is_made_behind_the_shuffle(spark, tmp_path, monkeypatch, name):
    from meterloom.registry import adapters as T
    from meterloom.registry.usage_queries import _two_states, _written_lines

    wall = "timestamp_ntz'2024-01-02 03:04:05.6'"
    events = spark.sql(f"SELECT id AS event_id, {wall} AS ts, if(id = 7, NULL, id % 3) AS user_id, 'click' AS event_type, id * 1.5D AS value, 'p' AS props FROM range(40)")
    events.union(events.filter("event_id IN (3, 11)")).write.parquet(f"{tmp_path}/events.parquet")
    want = sorted(r["value"] for r in T.claude_lines(spark, str(tmp_path)).select("value").collect())
    frame = type(events)
    plans, held, write = [], [], frame.mapInArrow

    def seen(df, run, schema, *more):
        plans.append(plan_of(df))
        return write(df, run, schema, *more)

    monkeypatch.setattr(frame, "mapInArrow", seen)
    text = lambda root: sorted(r["value"] for r in spark.read.option("recursiveFileLookup", True).text(root).collect())
    if "_written_lines" in name:
        assert text(_written_lines(spark, T.claude_rows(spark, str(tmp_path)), T.claude_text)) == want
    else:
        _two_states(spark, str(tmp_path), lambda root: held.append(text(root)))
        late = lambda line: int(json.loads(line)["requestId"][1:]) % 10 == 0
        user = lambda line: int(json.loads(line)["requestId"][1:]) % 3
        assert held == [[v for v in want if not late(v)], [v for v in want if not late(v) or user(v) == 1]]
    assert plans
    for plan in plans:
        assert "StructsToJson" in plan and plan.rindex("StructsToJson") < plan.index("Exchange")


def test_lines_of_a_large_tree_are_read_by_tasks_as_spark_reads_them(spark, tmp_path, monkeypatch):
    import gzip

    root = str(tmp_path)
    for k in range(12):
        put(root, f"p{k % 3}/{k}.jsonl", [f"{k} {n} é" + "x" * n for n in range(k)] + ["", "last"])
    for name, raw in (("mark", "﻿one\r\ntwo\rthree\n﻿four"), ("blank", "\n\n")):
        with open(put(root, f"p9/{name}.jsonl", []), "wb") as f:
            f.write(raw.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    try:
        def read(**more):
            rows = logs.read_log_lines(spark, root, "claude", scope=F.regexp_extract("file_path", r"/p(\d+)/", 1), **more)
            got = rows.orderBy("file_path", "block_start", "line_seq").collect()
            return rows, [(r["scope"], r["source"], r["file_path"], r["file_mtime"], r["file_size"], r["value"]) for r in got]

        indexed, want = read()
        monkeypatch.setattr(logs, "INDEXED", 3)
        dealt, got = read()
        assert got == want and len(want) > 90
        assert "FileScan text" in plan_of(indexed) and "FileScan" not in plan_of(dealt) and dealt.agg(F.max("block_start")).first()[0] >= 128
        with gzip.open(put(root, "p9/packed.jsonl.gz", []), "wt") as f:
            f.write("packed\n")
        assert [r[-1] for r in read(pattern="packed*")[1]] == ["packed"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_old_files_of_a_large_tree_are_not_read(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for k in range(8):
        put(root, f"p/{k}.jsonl", [f"line {k}"], mtime=T0 - 4 + k)
    monkeypatch.setattr(logs, "INDEXED", 3)
    lines = logs.read_log_lines(spark, root, "claude", since=T0)
    for k in range(4):
        os.remove(f"{root}/p/{k}.jsonl")  # a read of a file that has gone would fail
    assert sorted(r["value"] for r in lines.collect()) == [f"line {k}" for k in range(4, 8)] and "FileScan" not in plan_of(lines)
    assert sorted(r["value"] for r in logs.read_log_lines(spark, root, "claude", since=0).collect()) == [f"line {k}" for k in range(4, 8)]


@pytest.mark.parametrize("name", ["n6_reparsed_files", "s13_appended_and_removed_files"])
def test_queries_over_two_states_index_no_large_tree_on_the_driver(spark, tmp_path, monkeypatch, name):
    from meterloom.registry.usage_queries import QUERIES

    wall = "timestamp_ntz'2024-01-02 03:04:05' + make_dt_interval(0, cast(id % 40 as int))"
    spark.sql(f"SELECT id AS event_id, {wall} AS ts, id % 8 AS user_id, if(id % 2 = 0, 'click', 'view') AS event_type, id / 4D AS value FROM range(200)").write.parquet(f"{tmp_path}/events.parquet")
    want = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
    monkeypatch.setattr(logs, "INDEXED", 1)
    monkeypatch.setattr(logs, "_reader", None)  # Spark's reader, which indexes the files
    assert len(want) > 2 and sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == want

"""Log lines to usage rows: the literal cases of parsing, deduplication, counters and prices; expected tokens and dollars of the cases are fixed values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import claude, codex, epoch, grok, grok_model, grok_token, lines
from meterloom.functions.clock import range_start
from meterloom.operators import counters
from meterloom.operators.usage import hourly, with_clock
from meterloom.plans.report import usage_events
from meterloom.sources import logs
from meterloom.sources.logs import codex_project
from meterloom.sources.prices import price_rules

FILE = "/r/projects/slug/a.jsonl"


def book(spark, source, files, start=0, rules=None, block=1_000_000):
    df = lines(spark, source, files, block=block)
    return usage_events(df, [source], start, rules)


def total(df, column="total"):
    return df.agg(F.sum(column)).first()[0] or 0


def by_hour(df, tz="UTC"):
    return {r["hour"]: r["tokens"] for r in hourly(with_clock(df, tz)).collect() if r["tokens"]}


def test_codex_cumulative_becomes_deltas(spark):
    stamps = [f"2026-07-17T0{h}:00:00Z" for h in (1, 2, 3, 4)]
    rows = book(spark, "codex", {"/r/rollout-1.jsonl": [codex(t, n) for t, n in zip(stamps, (100, 250, 250, 400))]})
    assert total(rows, "input") == 400
    assert by_hour(rows) == {1: 100, 2: 150, 4: 150}


@pytest.mark.parametrize("block", [1, 2, 3])
def test_codex_deltas_cross_file_splits(spark, block):
    values = [100, 250, 250, 400, 390, 500]
    texts = [codex(f"2026-07-17T0{i}:00:00Z", v) for i, v in enumerate(values)]
    rows = book(spark, "codex", {"/r/rollout-1.jsonl": texts}, block=block)
    assert sorted(r["total"] for r in rows.collect()) == sorted([100, 150, 150, 110])


def test_codex_cached_input_is_discounted(spark):
    texts = [
        codex("2026-07-17T01:00:00Z", input_tokens=500, cached_input_tokens=300, output_tokens=50),
        codex("2026-07-17T02:00:00Z", input_tokens=1000, cached_input_tokens=800, output_tokens=100),
    ]
    assert total(book(spark, "codex", {"/r/rollout-1.jsonl": texts}), "cost") == pytest.approx(0.0019, abs=1e-12)
    plain = book(spark, "codex", {"/r/rollout-1.jsonl": [codex("2026-07-17T01:00:00Z", 1000)]})
    assert total(plain, "cost") == pytest.approx(0.005, abs=1e-12)


def test_codex_across_local_midnight(spark):
    tz = "Asia/Taipei"
    texts = [codex(epoch("2026-07-16T23:59:00", tz), 100), codex(epoch("2026-07-17T00:01:00", tz) * 1000, 250)]
    rows = with_clock(book(spark, "codex", {"/r/rollout-1.jsonl": texts}), tz)
    assert {str(r["date"]): r["total"] for r in rows.collect()} == {"2026-07-16": 100, "2026-07-17": 150}


def test_codex_fork_replays_once_and_drop_saturates(spark):
    head = [codex("2026-07-17T01:00:00Z", 100), codex("2026-07-17T02:00:00Z", 250)]
    fork = head + [codex("2026-07-17T03:00:00Z", 400)]
    assert total(book(spark, "codex", {"/r/rollout-1.jsonl": head, "/r/rollout-2.jsonl": fork})) == 400
    drop = book(spark, "codex", {"/r/rollout-1.jsonl": [head[1], codex("2026-07-17T03:00:00Z", 100)]})
    assert total(drop) == 250


def test_codex_replay_reserves_even_out_of_range(spark):
    """A row before the range still moves the baseline of its file."""
    texts = [codex("2026-07-17T01:00:00Z", 100), codex("2026-07-17T02:00:00Z", 250)]
    rows = book(spark, "codex", {"/r/rollout-1.jsonl": texts}, start=epoch("2026-07-17T01:30:00"))
    assert total(rows) == 150


def test_codex_project_is_first_named_folder_of_the_file(spark):
    meta = json.dumps({"payload": {"cwd": ""}})
    named = json.dumps({"payload": {"cwd": "C:\\work\\alpha\\"}})
    later = json.dumps({"payload": {"cwd": "/work/beta"}})
    filler = ["{}"] * 19
    files = {
        "/r/rollout-1.jsonl": [meta, named, later, codex("2026-07-17T01:00:00Z", 1)],
        "/r/rollout-2.jsonl": [*filler, later, codex("2026-07-17T02:00:00Z", 2)],
    }
    got = {r["file_path"]: r["project"] for r in book(spark, "codex", files).collect()}
    assert got == {"/r/rollout-1.jsonl": "alpha", "/r/rollout-2.jsonl": "beta"}
    head = codex_project(lines(spark, "codex", files), 8).collect()
    assert [(r["file_path"], r["project"]) for r in head] == [("/r/rollout-1.jsonl", "alpha")]


def test_codex_usage_falls_back_to_the_payload(spark):
    text = json.dumps({"timestamp": 5, "payload": {"type": "token_count", "total_token_usage": {"output_tokens": 7}}})
    other = json.dumps({"timestamp": 5, "payload": {"type": "note", "total_token_usage": {"output_tokens": 9}, "x": "token_count"}})
    assert total(book(spark, "codex", {"/r/rollout-1.jsonl": [text, other]})) == 7


def test_claude_component_price(spark):
    text = claude(model="claude-opus-4-8", input_tokens=1000, output_tokens=500, cache_read_input_tokens=100_000, cache_creation_input_tokens=2000)
    row = book(spark, "claude", {FILE: [text]}).first()
    assert row["cost"] == pytest.approx(0.08, abs=1e-12)
    assert (row["project"], row["kind"], row["cached"], row["agent"]) == ("slug", "other", 102_000, "Claude Code")


def test_claude_one_hour_cache_write(spark):
    text = claude(
        model="claude-opus-4-8", cache_creation_input_tokens=2000,
        cache_creation={"ephemeral_5m_input_tokens": 0, "ephemeral_1h_input_tokens": 2000},
    )
    assert total(book(spark, "claude", {FILE: [text]}), "cost") == pytest.approx(0.02, abs=1e-12)


def test_claude_keys(spark):
    same = claude(mid="a", input_tokens=100)
    assert total(book(spark, "claude", {"/r/p/a.jsonl": [same], "/r/p/b.jsonl": [same]})) == 100
    first, second = claude(request="r", mid="a", input_tokens=100), claude(request="r", mid="b", input_tokens=200)
    assert total(book(spark, "claude", {"/r/p/a.jsonl": [first], "/r/p/b.jsonl": [second]})) == 100
    plain = claude(input_tokens=100)
    assert total(book(spark, "claude", {"/r/p/a.jsonl": [plain], "/r/p/b.jsonl": [plain]})) == 200
    assert total(book(spark, "claude", {"/r/p/a.jsonl": [claude(uuid="u", input_tokens=1), claude(uuid="u", input_tokens=5)]})) == 1


def test_claude_zero_row_in_range_reserves_its_key_and_old_row_does_not(spark):
    zero, real = claude(mid="a"), claude(mid="a", input_tokens=100)
    assert total(book(spark, "claude", {"/r/p/a.jsonl": [zero, real]})) == 0
    old = claude(ts="2026-07-01T00:00:00Z", mid="a", input_tokens=7)
    assert total(book(spark, "claude", {"/r/p/a.jsonl": [old, real]}, start=epoch("2026-07-10T00:00:00"))) == 100


def test_claude_order_is_by_path_component(spark):
    """'/r/p/a' sorts before '/r/p-x/a' although '-' is below '/'."""
    a, b = claude(mid="k", input_tokens=1), claude(mid="k", input_tokens=5)
    assert total(book(spark, "claude", {"/r/p-x/a.jsonl": [b], "/r/p/a.jsonl": [a]})) == 1


def test_scopes_do_not_share_keys(spark):
    text = claude(mid="a", input_tokens=100)
    both = lines(spark, "claude", {FILE: [text]}, scope="x").unionByName(lines(spark, "claude", {FILE: [text]}, scope="y"))
    assert total(usage_events(both, ["claude"])) == 200


@pytest.mark.parametrize(
    "text",
    [
        '{"message":{"usage":{"input_tokens":-5}}}',
        '{"message":{"usage":{"input_tokens":1.5}}}',
        '{"message":{"usage":{"input_tokens":"7"}}}',
        '{"message":{"content":"plain text","usage":{"input_tokens":7}}}',
        '{"message":{"usage":{"input_tokens":7}}} trailing',
        '{"message":{"usage":{"input_tokens":7}}',
        '{"message":{"usage":null}}',
        '{"usage":{"input_tokens":7}}',
    ],
)
def test_one_wrong_field_drops_the_line(spark, text):
    assert logs.parse_claude(lines(spark, "claude", {FILE: [text]})).count() == 0


def test_claude_kind(spark):
    def kind(*tools):
        return logs.parse_claude(lines(spark, "claude", {FILE: [claude(tools=tools, input_tokens=1)]})).first()["kind"]

    assert kind() == "other"
    assert kind("Read", "Edit") == "edit"
    assert kind("Bash", "Read", "Bash") == "run"
    assert kind("mcp__a", "AgentX", "mcp__b") == "mcp"
    assert kind("edit") == "other"


def test_grok_models_resets_and_forks(spark):
    path = "/r/sessions/%2Fhome%2Fme%2Fproj/s1/updates.jsonl"
    t = [epoch(f"2026-07-17T0{h}:00:00") for h in range(6)]

    def by_model(texts, **more):
        rows = book(spark, "grok", {path: texts, **more}).collect()
        out = {}
        for r in rows:
            out[r["model"]] = out.get(r["model"], 0) + r["total"]
        return out

    assert by_model([grok_model(t[0], "grok-4.5"), grok_token(t[1], 100), grok_token(t[2], 400)]) == {"grok-4.5": 400}
    assert by_model([grok_token(t[1], 250)]) == {"grok": 250}
    assert by_model([grok_model(t[0], "grok-4.5"), grok_token(t[1], 100), grok_model(t[2], "grok-4"), grok_token(t[3], 300)]) == {"grok-4.5": 100, "grok-4": 200}
    assert by_model([grok(t[1], 300, "g"), grok(t[2], 120, "g")]) == {"g": 420}
    head = [grok(t[1], 100, "g"), grok(t[2], 250, "g")]
    assert by_model(head, **{"/r/sessions/x/s2/updates.jsonl": head + [grok(t[3], 400, "g")]}) == {"g": 400}
    row = book(spark, "grok", {path: head}).first()
    assert (row["project"], row["cost"], row["input"], row["kind"]) == ("proj", 0.0, 0, None)


def test_grok_meta_places(spark):
    def parsed(obj):
        rows = logs.parse_grok(lines(spark, "grok", {"/g/x/s/updates.jsonl": [json.dumps(obj)]})).collect()
        return [(r["model_update"], r["ts"], r["cumulative"]) for r in rows]

    nested = {"timestamp": 1_784_343_597, "_meta": {}, "params": {"_meta": {"totalTokens": 10_093, "modelId": "grok-4.5"}}}
    assert parsed(nested) == [("grok-4.5", 1_784_343_597, 10_093)]
    assert parsed({"timestamp": 1, "_meta": {}, "params": {"_meta": {}, "note": "totalTokens"}}) == []
    empty_first = {"timestamp": 1, "_meta": {"modelId": "late"}, "params": {"update": {"_meta": {"modelId": ""}}}}
    assert parsed(empty_first) == []


def test_random_order_does_not_matter(spark):
    rng = random.Random(5)
    texts, value = [], 0
    for i in range(60):
        value = value + rng.randint(0, 50) if rng.random() > 0.1 else rng.randint(0, 20)
        texts.append(codex(1_784_000_000 + i * 60, value))
    df = lines(spark, "codex", {"/r/rollout-1.jsonl": texts, "/r/rollout-2.jsonl": texts[:30]}, block=7)
    want = sorted(map(tuple, usage_events(df, ["codex"]).collect()))
    for seed in (1, 2):
        shuffled = df.repartition(7).orderBy(F.rand(seed))
        assert sorted(map(tuple, usage_events(shuffled, ["codex"]).collect())) == want


def rules_of(spark, text):
    return price_rules(spark.createDataFrame([(text,)], "value string"))


def cost_with(spark, text, model="claude-sonnet-4-x"):
    rules = None if text is None else rules_of(spark, text)[0]
    return total(book(spark, "claude", {FILE: [claude(model=model, input_tokens=1_000_000)]}, rules=rules), "cost")


def test_override_precedence(spark):
    exact = '{"models":{"sonnet":{"input":7.0,"output":15.0},"Claude-Sonnet-4-X":{"input":20.0,"output":15.0}}}'
    assert cost_with(spark, None) == pytest.approx(3.0)
    assert cost_with(spark, '{"models":{"sonnet":{"input":7.0,"output":15.0}}}') == pytest.approx(7.0)
    assert cost_with(spark, exact) == pytest.approx(20.0)
    assert cost_with(spark, '{"models":{"sonnet":{"input":-3.0,"output":15.0}}}') == pytest.approx(3.0)
    assert cost_with(spark, '{"models":{"zz":{"blended":9}}}') == pytest.approx(3.0)
    assert cost_with(spark, '{"models":{"sonnet":{"blended":9}}}') == pytest.approx(9.0)


def test_rules_cost_no_second_pass(spark):
    """With rules, the lines are scanned and deduplicated once, and no row is joined."""
    rules = rules_of(spark, '{"models":{"sonnet":{"input":7.0,"output":15.0}}}')[0]
    frame = book(spark, "claude", {FILE: [claude(mid=f"m{k}", input_tokens=1) for k in range(20)]}, rules=rules)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Join" not in plan and plan.count("partial_min_by") <= 2 and "Broadcast" not in plan


def test_bad_rule_files_give_no_rules(spark):
    for text in ("not json {{{", "{}", '{"models": 3}', '{"models":{}}'):
        assert rules_of(spark, text)[0].count() == 0
    assert [tuple(r) for r in rules_of(spark, "not json {{{")[1].collect()] == [(None, "not json {{{")]
    many = ",".join(f'"m{k}":{{"blended":{k}}}' for k in range(60_000))
    assert len(many) > 1024 * 1024 and rules_of(spark, '{"models":{' + many + "}}")[0].count() == 60_000
    valid, rejected = rules_of(
        spark,
        '{"models":{"a":{"input":10,"output":1},"b":{"input":1},"c":{"input":"1","output":2},"d":{"blended":-1},"e":4,"f":{"input":1,"output":1,"cache_read":null}}}',
    )
    row = valid.first()
    assert (row["key"], row["cache_read"], row["cache_write_5m"], row["cache_write_1h"]) == ("a", 1.0, 12.5, 20.0)
    assert sorted(r["raw_key"] for r in rejected.collect()) == ["b", "c", "d", "e", "f"]


def test_range_start():
    now = epoch("2026-07-17T10:00:00")
    assert range_start("today", now, "UTC") == epoch("2026-07-17T00:00:00")
    assert range_start("week", now, "UTC") == epoch("2026-07-11T00:00:00")
    assert range_start("month", now, "UTC") == epoch("2026-06-18T00:00:00")
    assert range_start("today", now, "Asia/Taipei") == epoch("2026-07-16T16:00:00")


def test_hot_key_and_keyless_rows_spread(spark):
    """A third of all rows share one key; keyless rows do not meet each other."""
    texts = [claude(mid="hot", input_tokens=1) for _ in range(300)] + [claude(input_tokens=1) for _ in range(300)]
    rows = book(spark, "claude", {FILE: texts + [claude(mid=f"m{i}", input_tokens=1) for i in range(300)]})
    assert total(rows) == 601
    kept = counters.dedup_messages(logs.parse_claude(lines(spark, "claude", {FILE: texts})))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan

import json
from datetime import datetime
from zoneinfo import ZoneInfo

LINE = "scope string, source string, file_path string, block_start long, line_seq long, file_mtime long, file_size long, value string"


def lines(spark, source, files, mtime=2_000_000_000, scope="s", block=1_000_000):
    """``files`` maps a path to its lines; ``block`` lines make one split."""
    rows = [
        (scope, source, path, i // block * 100, i, mtime, 0, text)
        for path, texts in files.items()
        for i, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, LINE)


def epoch(text, tz="UTC"):
    return int(datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(tz)).timestamp())


def codex(ts, total=None, **parts):
    usage = {"input_tokens": total} if total is not None else parts
    return json.dumps({"timestamp": ts, "payload": {"type": "token_count", "info": {"total_token_usage": usage}}})


def claude(ts="2026-07-17T00:00:00Z", model="claude-test", mid=None, request=None, uuid=None, tools=(), **usage):
    message = {"model": model, "usage": usage, "content": [{"type": "tool_use", "name": t} for t in tools]}
    if mid:
        message["id"] = mid
    line = {"timestamp": ts, "message": message}
    if request:
        line["requestId"] = request
    if uuid:
        line["uuid"] = uuid
    return json.dumps(line)


def grok_model(ts, model):
    return json.dumps({"timestamp": ts, "params": {"update": {"_meta": {"modelId": model}}, "_meta": {"eventId": "e"}}})


def grok_token(ts, total):
    return json.dumps({"timestamp": ts, "params": {"update": {"x": 1}, "_meta": {"totalTokens": total}}})


def grok(ts, total, model):
    return json.dumps({"timestamp": ts, "_meta": {"totalTokens": total, "modelId": model}})

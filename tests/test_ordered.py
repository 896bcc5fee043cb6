"""Chunked ordered operators against plain windows, with one hot series."""

import random
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import queries
from meterloom.operators.ordered import carry_scan, first_of, time_chunk


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    rows = []
    for key, n in (("hot", 4_000), ("b", 300), ("c", 1), (None, 50)):
        t = 0
        for _ in range(n):
            t += rng.choice([1, 15, 60, 4_000])
            rows.append((key, t, rng.random() if rng.random() < 0.3 else None, rng.randint(0, 9)))
    df = spark.createDataFrame(rows, "k string, ts long, m double, v long")
    return df.withColumn("chunk", time_chunk("ts", 7_200)).repartition(6)


def test_carry_scan_equals_plain_windows(series):
    got = carry_scan(
        series, ["k"], ["chunk"], ["ts"], lag={"pv": "v", "pt": "ts", "pm": "m"}, last={"lm": "m"}, prior={"bm": "m"}, running={"rs": "v"}
    )
    w = Window.partitionBy("k").orderBy("ts")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = series.withColumn("k", F.coalesce("k", F.lit(""))).select(
        "*", F.lag("v").over(w).alias("pv"), F.lag("ts").over(w).alias("pt"), F.lag("m").over(w).alias("pm"),
        F.last("m", True).over(upto).alias("lm"), F.last("m", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("bm"),
        F.sum("v").over(upto).alias("rs"),
    )
    cols = want.columns
    assert sorted(map(repr, got.select(*cols).collect())) == sorted(map(repr, want.collect()))


def test_carry_scan_shuffles_rows_once(series, spark):
    path_rows = carry_scan(series, ["k"], ["chunk"], ["ts"], running={"rs": "v"}).select("k", "rs")
    path_rows.collect()
    plan = path_rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_first_of_aggregates_before_the_shuffle(series):
    firsts = first_of(series.filter("k is not null").select("k", "ts", "v"), ["k"], ["ts"])
    want = series.groupBy("k").agg(F.min("ts").alias("ts")).filter("k is not null")
    assert sorted(tuple(r) for r in firsts.select("k", "ts").collect()) == sorted(tuple(r) for r in want.collect())
    assert "partial_min_by" in firsts._jdf.queryExecution().executedPlan().toString()


def test_carry_scan_never_broadcasts_the_chunks(series):
    """The chunks may be as many as the rows, whatever Spark's estimate says."""
    got = carry_scan(series, ["k"], ["chunk"], ["ts"], prior={"bm": "m"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def run_query(spark, folder, name):
    """Result and final plan of a query over own events: two users, hours apart, readings of 1 to 4 tokens, a NULL value."""
    rows = [
        (i, datetime(2024, 1, 1 + i // 24, i % 24), i % 2, "error" if i % 7 == 0 else "view", None if i == 33 else (1 + i % 4) / 100, None)
        for i in range(1, 120)
    ]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{folder}/events.parquet")
    got = queries()[name](spark, str(folder))
    result = sorted(got.collect(), key=lambda r: r["ts"])
    return rows, result, got._jdf.queryExecution().executedPlan().toString()


def test_counter_deltas_query_merges_chunk_tails(spark, tmp_path):
    """One row per file and hour comes out of the lines of d3; sent to the driver to be broadcast, they outgrow it."""
    _, result, plan = run_query(spark, tmp_path, "d3_counter_deltas")
    assert len(result) == 119 and {r["input"] + r["cached"] + r["output"] + r["reasoning"] - r["grown"] for r in result} == {0}
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_counter_with_reset_query_merges_chunk_tails(spark, tmp_path):
    """Three scans in a row (d4): the counter, its base and the growth; none may send its chunk tails to the driver."""
    rows, result, plan = run_query(spark, tmp_path, "d4_counter_with_reset")
    assert [r["grown"] for r in result] == [round(100 * (r[4] or 0)) for r in rows]
    assert plan.count("SortMergeJoin") >= 3 and "Broadcast" not in plan


def test_sticky_model_query_merges_chunk_tails(spark, tmp_path):
    """As d4, with the last named model (d5) instead of the growth."""
    rows, result, plan = run_query(spark, tmp_path, "d5_sticky_model")
    named, want = {}, []
    for i, _, user, kind, *_ in rows:
        named |= {user: f"grok-{i % 5}"} if kind == "error" else {}
        want.append(named.get(user, "grok"))
    assert [r["model"] for r in result] == want
    assert plan.count("SortMergeJoin") >= 3 and "Broadcast" not in plan

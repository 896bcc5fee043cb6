"""Records and streaks from merged parts equal those over the usage rows."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from helpers import claude
from meterloom.operators import record_parts, records
from meterloom.plans.maintained import read_record_months, read_usage_days, refresh_record_months, refresh_usage_days
from meterloom.sources.refresh import refresh_events
from test_files import T0, put

SLOT = "scope string, date date, hour int, total long"


def rows(df):
    return sorted(map(tuple, df.collect()))


def agree(parts, facts, today, hour, first=None):
    inside = facts if first is None else facts.filter(F.col("date") >= F.lit(first).cast("date"))
    assert rows(record_parts.record_day(parts)) == rows(records.record_day(facts))
    assert rows(record_parts.record_hour(parts)) == rows(records.record_hour(facts))
    assert rows(record_parts.streak(parts, today, first=first)) == rows(records.streak(inside, today))
    assert rows(record_parts.new_record_now(parts, today, hour)) == rows(records.new_record_now(facts, today, hour))


@pytest.mark.parametrize("seed", range(3))
def test_random_days_over_three_months(spark, seed):
    rng = random.Random(seed)
    base, data = dt.date(2026, 5, 20), []
    for k in range(30):  # some scopes are active nearly every day, so runs cross the ends of months
        share = rng.choice((0.2, 0.9, 0.97))
        for d in range(60):
            if rng.random() < share:
                data += [(f"s{k}", base + dt.timedelta(d), rng.randrange(24), rng.randrange(1, 6)) for _ in range(rng.randrange(1, 4))]
    facts = spark.createDataFrame(data, SLOT).cache()
    months = record_parts.month_parts(facts).cache()
    for today in ("2026-06-01", "2026-07-18"):
        agree(months, facts, today, 5, "2026-05-28")
    # any grouping of the days gives the same
    odd = record_parts.day_parts(facts).withColumn("part", F.pmod(F.xxhash64("date", F.lit(seed)), F.lit(5)))
    agree(record_parts.merged(odd, ["scope", "part"]), facts, "2026-07-10", 3)


def test_run_across_two_months_and_ties(spark):
    day = dt.date.fromisoformat
    facts = spark.createDataFrame(
        [("s", day("2026-06-29"), 4, 5), ("s", day("2026-06-30"), 4, 5), ("s", day("2026-07-01"), 3, 5), ("s", day("2026-07-02"), 1, 9), ("z", day("2026-08-01"), 0, 1)], SLOT)
    parts = record_parts.month_parts(facts)
    assert rows(record_parts.streak(parts, "2026-07-02")) == [("s", 4)]  # z has no day yet
    assert rows(record_parts.streak(parts, "2026-07-02", first="2026-06-30")) == [("s", 3)]
    assert rows(record_parts.streak(parts, "2026-07-01")) == [("s", 3)] and rows(record_parts.streak(parts, "2026-07-04")) == [("s", 0)]
    agree(parts, facts, "2026-07-02", 1), agree(parts, facts, "2026-08-01", 0)
    june = facts.filter("date < '2026-07-02' AND scope = 's'")
    agree(record_parts.month_parts(june), june, "2026-07-01", 3)  # three equal hours: the earliest, and no record now
    none = facts.limit(0)
    agree(record_parts.month_parts(none), none, "2026-07-01", 3)


def test_maintained_months_follow_the_files(spark, tmp_path):
    root, silver, sums = (str(tmp_path / d) for d in ("logs", "silver", "sums"))
    line = lambda mid, n, ts: claude(mid=mid, input_tokens=n, ts=f"2026-{ts}T01:00:00Z")

    def step():
        refresh_events(spark, root, silver, "claude")
        refresh_usage_days(spark, silver, sums, ["claude"])
        run = refresh_record_months(spark, sums)
        facts = read_usage_days(spark, sums)
        agree(read_record_months(spark, sums), facts, "2026-07-02", 1)
        return run, {str(r[0]) for r in read_record_months(spark, sums).select("month").collect()}

    with pytest.raises(ValueError):
        read_record_months(spark, sums)
    a = [line("a", 4, "06-30"), line("b", 5, "07-01")]
    put(root, "p/a.jsonl", a), put(root, "p/b.jsonl", [line("c", 9, "05-03")])
    assert step() == (0, {"2026-05-01", "2026-06-01", "2026-07-01"})
    assert refresh_record_months(spark, sums) == -1
    put(root, "p/a.jsonl", [*a, line("d", 7, "07-02")], mtime=T0 + 2_000)
    os.remove(f"{root}/p/b.jsonl")
    assert step() == (1, {"2026-06-01", "2026-07-01"})
    again = spark.read.parquet(f"{sums}/months/run=1").select("month", "gone")
    assert {(str(m), g) for m, g in again.collect()} == {("2026-05-01", True), ("2026-07-01", False)}  # June stands

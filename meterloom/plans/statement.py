"""The usage statement: splits and header taken from finished report rows.

Project columns of the report are never read here: a statement may be shown to others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.operators.shares import splits


def usage_statement(report: DataFrame) -> DataFrame:
    """Positive agents and models with their share of the period total (``dim``, ``name``)."""
    parts = report.select(
        "scope",
        F.explode(
            F.concat(
                F.transform(F.map_entries("by_agent"), lambda x: F.struct(F.lit("agent").alias("dim"), x["key"].alias("name"), x["value"].alias("tokens"))),
                F.transform(F.map_entries("by_model"), lambda x: F.struct(F.lit("model").alias("dim"), x["key"].alias("name"), x["value"].alias("tokens"))),
            )
        ).alias("s"),
        F.col("total_tokens").alias("whole"),
    )
    rows = parts.select("scope", "s.dim", "s.name", "s.tokens", "whole")
    totals = report.select(
        "scope", F.explode(F.array(F.lit("agent"), F.lit("model"))).alias("dim"),
        F.col("total_tokens").alias("tokens"),
    )
    return splits(rows.drop("whole"), "name", totals, by=["scope", "dim"])


def statement_header(report: DataFrame) -> DataFrame:
    """Dates and numbers of the statement's head; wording is left to the reader.

    ``short_history_from`` is set when a month report starts later than its nominal first day.
    """
    first, last = F.element_at("daily", 1)["date"], F.element_at("daily", -1)["date"]
    short = (F.col("range") == "month") & (F.col("range_start_day") != first)
    return report.select(
        "scope",
        "range",
        first.alias("first_day"),
        last.alias("last_day"),
        F.when(short, F.col("range_start_day")).alias("short_history_from"),
        F.date_format(last, "yyyy-MMdd").alias("document_no"),
        F.date_format(last, "yyyy-MM").alias("document_month"),
        "sessions",
        F.col("records.streak_days").alias("streak_days"),
        F.col("records.max_day.tokens").alias("max_day_tokens"),
        F.col("records.max_hour.hour").alias("peak_hour"),
        "total_tokens",
        "total_cost",
        F.size("by_agent").alias("agent_count"),
    )

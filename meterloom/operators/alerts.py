"""Suppressed alerts over recorded readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.config import ALERT_SECS, CRIT_PCT, PROVIDER_OF_SOURCE, SOURCE_FAIL_SECS, WARN_PCT
from meterloom.operators.folds import Thinning, run_fold
from meterloom.operators.ordered import first_of


def alert_level(warn: float = WARN_PCT, crit: float = CRIT_PCT) -> Column:
    """``critical``, ``warning`` or NULL; a failed reading is no quota signal."""
    critical = (F.col("status") == "locked") | (F.col("util") >= crit)
    level = F.when(critical, "critical").when(F.col("util") >= warn, "warning")
    return F.when(F.col("status") != "source_failed", level)


def threshold_alerts(
    readings: DataFrame,
    warn: float = WARN_PCT,
    crit: float = CRIT_PCT,
    secs: int = ALERT_SECS,
    width: int | None = None,
) -> DataFrame:
    """Alerts that fire (scope, limit_id, ts, level): at most one per limit in ``secs``."""
    keys = ["scope", "limit_id"]
    rows = readings.withColumn("level", alert_level(warn, crit)).filter(F.col("level").isNotNull())
    rows = first_of(rows.select(*keys, "ts", "position", "level"), [*keys, "ts"], ["position"])
    rule = Thinning(secs, emit="level")
    return run_fold(rows.drop("position"), keys, rule, width=width, out="level", out_type="string")


def provider_failures(readings: DataFrame) -> DataFrame:
    """Per snapshot and provider: the notice of its first failed limit, NULL when none failed.

    Every snapshot speaks for every provider; one that is absent has recovered.
    """
    notice = F.coalesce("hint", F.concat("label", F.lit(" usage unavailable")))
    providers = list(PROVIDER_OF_SOURCE.values())

    def failing(provider: str) -> Column:
        here = (F.col("provider") == provider) & (F.col("status") == "source_failed")
        return F.min_by(notice, F.when(here, F.col("position")))

    states = readings.groupBy("scope", "ts").agg(*[failing(p).alias(p) for p in providers])
    entries = F.array(*[F.struct(F.lit(p).alias("provider"), F.col(p).alias("body")) for p in providers])
    return states.select("scope", "ts", F.explode(entries).alias("e")).select("scope", "ts", "e.*")


def source_failure_notices(
    readings: DataFrame, secs: int = SOURCE_FAIL_SECS, width: int | None = None
) -> DataFrame:
    """Failure notices that fire (scope, provider, ts, body): one per provider in ``secs``,
    and again at once after a recovery."""
    states = provider_failures(readings).withColumn("clears", F.col("body").isNull())
    rule = Thinning(secs, emit="body")
    return run_fold(states, ["scope", "provider"], rule, width=width, out="body", out_type="string")

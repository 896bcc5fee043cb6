"""Time columns.

Instants are epoch seconds (``bigint``).  Local dates and hours are derived through
``TIMESTAMP_NTZ`` arithmetic, so no result depends on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterloom.config import DAYS_BACK, DAYS_BACK_DEFAULT

# An instant beyond year 9999 has no calendar date in Spark; such a row is not booked.
MAX_EPOCH = 253_402_300_799

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_timestamp(epoch: Column | str, tz: str) -> Column:
    """Wall clock (``timestamp_ntz``) of an epoch second in ``tz``."""
    utc = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), as_col(epoch).cast("decimal(18,6)")
    )
    return utc if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def local_date(epoch: Column | str, tz: str) -> Column:
    return F.to_date(local_timestamp(epoch, tz))


def local_hour(epoch: Column | str, tz: str) -> Column:
    return F.hour(local_timestamp(epoch, tz))


def epoch_of_wall_utc(ts: Column | str) -> Column:
    """Epoch seconds of a zone-less timestamp column that holds UTC wall time."""
    ts = as_col(ts)
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * 86_400
        + F.hour(ts) * 3_600
        + F.minute(ts) * 60
        + F.second(ts)
    )


def epoch_of_rfc3339(text: Column | str) -> Column:
    """Epoch seconds of RFC 3339 text, NULL for anything else (date only, no zone, time only)."""
    parsed = F.unix_seconds(F.upper(as_col(text)).try_cast("timestamp"))
    return F.when(as_col(text).rlike(RFC3339), parsed)


def epoch_of_json(value: Column | str) -> Column:
    """Epoch seconds of a JSON scalar read as text.

    A bare integer above 1e10 is milliseconds, any other integer seconds; anything else must
    be RFC 3339.
    """
    raw = F.trim(as_col(value))
    number = F.when(raw.rlike(r"^-?\d+$"), raw.try_cast("bigint"))
    whole = F.when(number > 10_000_000_000, ((number - number % 1000) / 1000).cast("bigint"))
    return F.coalesce(whole, number, epoch_of_rfc3339(raw))


def epoch_of_variant(value: Column | str) -> Column:
    """Epoch seconds of a JSON scalar that kept its type: an integer as in ``epoch_of_json``, or RFC 3339 text.

    Digits in quotes are text, and a number with a fraction is neither.
    """
    value = as_col(value)
    kind = F.schema_of_variant(value)
    number = F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    whole = F.when(number > 10_000_000_000, ((number - number % 1000) / 1000).cast("bigint"))
    return F.coalesce(whole, number, epoch_of_rfc3339(text))


def days_back(range_name: str) -> int:
    return DAYS_BACK.get(range_name, DAYS_BACK_DEFAULT)


def day_span(range_name: str, now: int, tz: str) -> tuple[str, str]:
    """First and last calendar day (ISO text) of a range that ends on the day of ``now``."""
    today = datetime.fromtimestamp(now, ZoneInfo(tz)).date()
    return (today - timedelta(days=days_back(range_name))).isoformat(), today.isoformat()


def range_start(range_name: str, now: int, tz: str) -> int:
    """Epoch of the local midnight that opens the range: calendar days back from today."""
    first, _ = day_span(range_name, now, tz)
    return int(datetime.fromisoformat(first).replace(tzinfo=ZoneInfo(tz)).timestamp())


def hour_of(now: int, tz: str) -> int:
    return datetime.fromtimestamp(now, ZoneInfo(tz)).hour

"""Ordered computations over long series, split so that no task owns a whole series.

A series (one session file, one quota limit, one user) may hold a large part of all rows.
A plain ``Window.partitionBy(series)`` would hand all of it to one task.  Here each series is
cut into chunks (a file split, a day); rows are ordered inside a chunk, and only one small
row per chunk travels along the series to carry ``lag``, ``last`` or a running sum across
the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.config import CHUNK_SECS
from meterloom.functions.clock import as_col


def time_chunk(ts: Column | str, width: int = CHUNK_SECS) -> Column:
    return F.floor(as_col(ts) / width).cast("bigint")


def _never_null(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    zero = F.lit("") if kind.typeName() == "string" else F.lit(0).cast(kind)
    return F.coalesce(F.col(name), zero)


def carry_scan(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[str],
    seq: Sequence[str],
    *,
    lag: dict[str, str] | None = None,
    last: dict[str, str] | None = None,
    prior: dict[str, str] | None = None,
    running: dict[str, str] | None = None,
) -> DataFrame:
    """Add ordered columns to every row of each series.

    ``keys`` name the series, ``chunk`` its cuts, ``seq`` the order inside a chunk; the whole
    order is ``chunk`` then ``seq``; a NULL key counts as '' or 0.  ``lag`` takes the previous row's
    value, ``last`` the latest non-NULL value up to this row, ``prior`` the latest non-NULL value
    before this row, ``running`` the sum up to this row; each maps a new column to an existing
    one.

    One shuffle moves the rows, by (keys, chunk).  The chunk tails are aggregated on that
    same placement; only they move once more, by keys, and back.
    """
    lag, last, prior, running = lag or {}, last or {}, prior or {}, running or {}
    known = {**last, **prior}
    keys, chunk, seq = list(keys), list(chunk), list(seq)
    frame = keys + chunk + seq
    rest = [c for c in df.columns if c not in frame]
    # Never-NULL join keys: Spark would otherwise filter NULLs on one reader of the shuffle only.
    df = df.withColumns({c: _never_null(df, c) for c in keys + chunk})

    def val(name: str) -> Column:
        return F.col(f"_row.{name}") if name in rest else F.col(name)

    # The payload travels as one struct that both readers of the shuffle use whole, whatever
    # columns the caller needs later; so Spark runs the shuffle once (ReusedExchange).
    packed = df.select(*frame, F.struct(*rest).alias("_row")).repartition(*keys, *chunk)

    inside = Window.partitionBy(*keys, *chunk).orderBy(*seq)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = packed.select(
        *frame,
        F.last("_row").over(inside.rowsBetween(0, 0)).alias("_cur"),
        *[F.lag(F.struct(val(c).alias("v"))).over(inside).alias(f"_lag_{o}") for o, c in lag.items()],
        *[F.last(val(c), ignorenulls=True).over(upto).alias(f"_last_{o}") for o, c in last.items()],
        *[F.last(val(c), ignorenulls=True).over(ahead).alias(f"_last_{o}") for o, c in prior.items()],
        *[F.sum(val(c)).over(upto).alias(f"_run_{o}") for o, c in running.items()],
    )

    order = F.struct(*seq)
    tails = packed.groupBy(*keys, *chunk).agg(
        F.max_by("_row", order).alias("_row"),
        F.max(order).alias("_seq"),
        *[
            F.max_by(val(c), F.when(val(c).isNotNull(), order)).alias(f"_last_{o}")
            for o, c in known.items()
        ],
        *[F.sum(val(c)).alias(f"_run_{o}") for o, c in running.items()],
    )

    def tail(name: str) -> Column:
        return F.col(f"_seq.{name}") if name in seq else F.col(name) if name in frame else F.col(f"_row.{name}")

    def whole(name: str) -> Column:
        return F.when(F.col("_row").isNotNull(), F.col(name))

    across = Window.partitionBy(*keys).orderBy(*chunk)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(
        *keys,
        *chunk,
        *[F.lag(F.struct(tail(c).alias("v"))).over(across).alias(f"_clag_{o}") for o, c in lag.items()],
        *[F.last(whole(f"_last_{o}"), ignorenulls=True).over(before).alias(f"_clast_{o}") for o in known],
        *[F.sum(whole(f"_run_{o}")).over(before).alias(f"_crun_{o}") for o in running],
    )
    # There may be as many chunks as rows, and behind a parsed text Spark's estimate is far too small: never broadcast.
    joined = rows.join(carry.hint("merge"), keys + chunk, "left")

    def seen(value: Column) -> Column:
        return F.when(F.col("_cur").isNotNull(), value)

    return joined.select(
        *[F.col(c) if c in frame else F.col(f"_cur.{c}").alias(c) for c in df.columns],
        *[seen(F.coalesce(f"_lag_{o}", f"_clag_{o}")["v"]).alias(o) for o in lag],
        *[seen(F.coalesce(f"_last_{o}", f"_clast_{o}")).alias(o) for o in known],
        *[
            seen(F.coalesce(f"_run_{o}", F.lit(0)) + F.coalesce(f"_crun_{o}", F.lit(0))).alias(o)
            for o in running
        ],
    )


def with_lookback(df: DataFrame, ts: str, lookback: int, width: int | None = None) -> DataFrame:
    """Give every row to its own time chunk and to each later chunk that looks back at it.

    Adds ``chunk`` and ``own``.  A window bounded by ``lookback`` seconds can then run per
    (series, chunk); keep the rows with ``own`` afterwards.
    """
    width = width or max(CHUNK_SECS, 4 * lookback)
    home = time_chunk(ts, width)
    reach = time_chunk(F.col(ts) + lookback, width)
    return df.withColumn("_home", home).withColumn(
        "chunk", F.explode(F.sequence("_home", reach))
    ).withColumn("own", F.col("chunk") == F.col("_home")).drop("_home")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key in the given order.

    An aggregate, not a window: copies collapse before the shuffle, so a key that holds a
    third of all rows costs each task one row.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return picked.select(
        *[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns]
    )

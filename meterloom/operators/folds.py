"""Sequential rules ("keep if far enough from the last kept row") run chunk by chunk.

Such a rule depends on its own earlier answers, so no window expresses it.  Running it one
series per task would leave a hot series to a single task.  Instead:

1. every chunk of a series is folded from each state it could possibly be entered with; the
   rules forget after a bounded time, so those states come from a short look-back;
2. the small table "entered with -> left with" is walked once per series;
3. every chunk is folded again from its true entry state, now emitting rows.

All steps read sorted partitions as a stream of Arrow batches; no group is held in memory.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.config import CHUNK_SECS, DWELL_SECS, HYSTERESIS_PCT
from meterloom.operators.ordered import with_lookback

State = tuple | None
LONG_AGO = -(2**62)


class Fold:
    """One sequential rule.  ``memory`` is the time after which an old state acts like any older one."""

    memory: int

    def entries(self, halo: list[dict], first: dict) -> Iterable[State]:
        """States, besides ``None``, in which a chunk starting at row ``first`` may be entered."""
        raise NotImplementedError

    def settle(self, state: State, chunk_start: int) -> State:
        """Equivalent state as seen from the start of a chunk."""
        raise NotImplementedError

    def step(self, state: State, row: dict) -> tuple[State, Any]:
        """Next state and the emitted value, ``None`` for no row."""
        raise NotImplementedError

    def due(self, state: State) -> int | None:
        """Time before which no row but a ``touching`` one changes the state; None if any row may."""
        return None

    def touching(self, row: dict) -> bool:
        """Whether the row may change every state."""
        return True

    def vanishes(self, state: State) -> bool:
        """Whether a state may be one that no chunk expects: what it stands for is gone."""
        return False


class Thinning(Fold):
    """Keep a row if nothing was kept yet, if it is ``forced``, if ``memory`` seconds have
    passed since the last kept row, or if its value moved by ``delta``.  A row marked
    ``clears`` is never kept and forgets the last kept row.  ``emit`` names the column a kept
    row is reported with."""

    def __init__(self, memory: int, delta: float | None = None, emit: str = "value"):
        self.memory, self.delta, self.emit = memory, delta, emit

    def entries(self, halo, first):
        return [(r["ts"], r.get("value")) for r in halo if not r.get("clears")]

    def settle(self, state, chunk_start):
        return None if state is None or state[0] <= chunk_start - self.memory else state

    def step(self, state, row):
        if row.get("clears"):
            return None, None
        due = (
            state is None
            or row.get("forced")
            or row["ts"] - state[0] >= self.memory
            or (self.delta is not None and abs(row["value"] - state[1]) >= self.delta)
        )
        return ((row["ts"], row.get("value")), row[self.emit]) if due else (state, None)

    def due(self, state):
        return LONG_AGO if state is None else state[0] + self.memory

    def touching(self, row):
        return bool(self.delta is not None or row.get("clears") or row.get("forced"))


class Tracks:
    """The states that a chunk may be in, each with the entry states it came from.

    States wait in order of the time at which they are due, so a row costs only those it changes.
    """

    def __init__(self, rule: Fold, starts: Iterable[State]):
        self.rule, self.origins = rule, {s: [s] for s in starts}
        self.waiting = [(due, k, s) for k, s in enumerate(self.origins) if (due := rule.due(s)) is not None]
        self.lazy, self.count = len(self.waiting) == len(self.origins), len(self.waiting)
        heapify(self.waiting)

    def step(self, row: dict) -> None:
        if not self.lazy or self.rule.touching(row):
            moved: dict[State, list[State]] = {}
            for state, origins in self.origins.items():
                moved.setdefault(self.rule.step(state, row)[0], []).extend(origins)
            if self.lazy and moved.keys() != self.origins.keys():
                self.waiting = [(self.rule.due(s), k, s) for k, s in enumerate(moved)]
                self.count = len(self.waiting)
                heapify(self.waiting)
            self.origins = moved
            return
        while self.waiting and self.waiting[0][0] <= row["ts"]:
            state = heappop(self.waiting)[2]
            reached, origins = self.rule.step(state, row)[0], self.origins.pop(state)
            if reached in self.origins:
                small, large = sorted((origins, self.origins[reached]), key=len)
                large.extend(small)
                self.origins[reached] = large
            else:
                self.origins[reached] = origins
                self.count += 1
                heappush(self.waiting, (self.rule.due(reached), self.count, reached))


class StickyWorst(Fold):
    """Worst limit of successive snapshots with hysteresis.

    A row is one snapshot: parallel lists ``ids`` and ``utils`` in display order.  The greatest
    utilisation leads, the last of equals.  The shown limit gives way when it vanishes, or when
    the leader is ``margin`` points ahead and the shown one has stood for ``memory`` seconds.
    """

    def __init__(self, margin: float = HYSTERESIS_PCT, memory: int = DWELL_SECS):
        self.margin, self.memory = margin, memory

    @staticmethod
    def leader(row: dict) -> tuple[str, float]:
        util, _, name = max(zip(row["utils"], range(len(row["ids"])), row["ids"]))
        return name, util

    def entries(self, halo, first):
        recent = [(self.leader(r)[0], r["ts"]) for r in halo]
        return recent + [(name, LONG_AGO) for name in first["ids"]]

    def settle(self, state, chunk_start):
        if state is not None and state[1] <= chunk_start - self.memory:
            return (state[0], LONG_AGO)
        return state

    def vanishes(self, state):
        return True  # the shown limit is in no snapshot of the look-back or of the first row

    def step(self, state, row):
        name, util = self.leader(row)
        if state is None or state[0] not in row["ids"]:
            return (name, row["ts"]), name
        shown = row["utils"][row["ids"].index(state[0])]
        if name != state[0] and util - shown >= self.margin and row["ts"] - state[1] >= self.memory:
            return (name, row["ts"]), name
        return state, state[0]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for values in zip(*[column.to_pylist() for column in batch.columns]):
            yield dict(zip(names, values))


def _emit(rows: Iterable[tuple], schema: pa.Schema, size: int = 8_192) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema
            )
            part = []
    if part:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema
        )


def _dump(state: State) -> str:
    return json.dumps(state)


def _load(text: str) -> State:
    value = json.loads(text)
    return None if value is None else tuple(value)


def run_fold(
    df: DataFrame,
    keys: Sequence[str],
    rule: Fold,
    *,
    width: int | None = None,
    out: str = "value",
    out_type: str = "double",
) -> DataFrame:
    """Run ``rule`` over every series; returns keys, ``ts`` and the emitted value.

    ``df`` holds the keys, ``ts`` (unique per series) and what the rule reads.
    """
    keys = list(keys)
    width = width or max(CHUNK_SECS, 4 * rule.memory)
    if width < rule.memory:
        raise ValueError("a chunk must be at least as long as the rule's memory")
    place = keys + ["chunk"]
    key_fields = [df.schema[k] for k in keys]
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    key_types = _arrow_fields(df, keys)

    # Python work is bound by rows, not bytes: keep the session's partition count, which adaptive
    # execution would otherwise shrink to the small byte size.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = with_lookback(df, "ts", rule.memory, width)
    sorted_rows = spread.repartition(parts, *place).sortWithinPartitions(*place, "ts")

    # 1. entered with -> left with, per chunk
    map_schema = pa.schema([*key_types, ("chunk", pa.int64()), ("entry", pa.string()), ("exit", pa.string())])

    def explore(batches):
        def rows():
            for where, group in groupby(_records(batches), key=lambda r: tuple(r[k] for k in place)):
                halo: list[dict] = []
                tracks: Tracks | None = None
                for row in group:
                    if not row["own"]:
                        halo.append(row)
                        continue
                    if tracks is None:
                        tracks = Tracks(rule, dict.fromkeys([None, *rule.entries(halo, row)]))
                    tracks.step(row)
                for state, origins in (tracks.origins if tracks else {}).items():
                    for origin in origins:
                        yield (*where, _dump(origin), _dump(state))

        yield from _emit(rows(), map_schema)

    moves = sorted_rows.mapInArrow(explore, f"{key_ddl}, chunk bigint, entry string, exit string")

    # 2. true entry state of every chunk
    entry_schema = pa.schema([*key_types, ("chunk", pa.int64()), ("entry", pa.string())])

    def walk(batches):
        def rows():
            by_key = groupby(_records(batches), key=lambda r: tuple(r[k] for k in keys))
            for where, series in by_key:
                state: State = None
                for chunk, group in groupby(series, key=lambda r: r["chunk"]):
                    exits = {_load(r["entry"]): r["exit"] for r in group}
                    entry = rule.settle(state, chunk * width)
                    if entry not in exits:
                        if not rule.vanishes(entry):
                            raise ValueError(f"chunk {chunk} of {where} is entered with {entry}, which was not explored")
                        entry = None
                    yield (*where, chunk, _dump(entry))
                    state = _load(exits[entry])

        yield from _emit(rows(), entry_schema)

    entered = (
        moves.repartition(parts, *keys).sortWithinPartitions(*keys, "chunk")
        .mapInArrow(walk, f"{key_ddl}, chunk bigint, entry string")
    )

    # 3. replay from the true entry state; the entry marker sorts ahead of the chunk's rows
    payload = [c for c in df.columns if c not in keys]
    home = df.withColumn("chunk", F.floor(F.col("ts") / width).cast("bigint"))
    marked = home.withColumn("entry", F.lit(None).cast("string")).unionByName(
        entered, allowMissingColumns=True
    )
    out_schema = pa.schema([*key_types, ("ts", pa.int64()), ("value", _ARROW[out_type])])

    def replay(batches):
        def rows():
            state: State = None
            for row in _records(batches):
                if row["entry"] is not None:
                    state = _load(row["entry"])
                    continue
                state, value = rule.step(state, row)
                if value is not None:
                    yield (*[row[k] for k in keys], row["ts"], value)

        yield from _emit(rows(), out_schema)

    replayed = (
        marked.select(*place, *payload, "entry")
        .repartition(parts, *place)
        .sortWithinPartitions(*place, F.col("ts").asc_nulls_first())
        .mapInArrow(replay, f"{key_ddl}, ts bigint, value {out_type}")
    )
    return replayed.withColumnRenamed("value", out)


_ARROW: dict[str, pa.DataType] = {"double": pa.float64(), "string": pa.string()}


def _arrow_fields(df: DataFrame, keys: Sequence[str]) -> list[tuple[str, pa.DataType]]:
    types: dict[str, Callable[[], pa.DataType]] = {
        "string": pa.string, "bigint": pa.int64, "int": pa.int32,
    }
    return [(k, types[df.schema[k].dataType.simpleString()]()) for k in keys]

"""Streams that need each key's rows in the order of events, whatever order they come in.

Rows wait in a list state until the watermark has passed them; timers then hand them on in order to a small machine, which
keeps one value for each key. So the result doesn't depend on how the rows came in files and micro-batches, only on the
watermark: rows later than it are dropped, rows before it are done, the others wait. States live in RocksDB; those of one
bucket of keys at a time are in memory."""

from __future__ import annotations

import json
from base64 import b64decode
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def states_on_disk(spark: SparkSession):
    """Streams started here keep their states in RocksDB, which timers and lists need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Machine:
    """What happens to a key's rows in order. state and out: columns of the kept value and of the rows given out.

    Times are microseconds; at is a row's time."""

    state = out = ""

    def step(self, state: tuple | None, row: Row) -> tuple[tuple | None, list[tuple]]:
        """The state after a row, and rows to give out."""
        raise NotImplementedError

    def lapse(self, state: tuple | None, mark: int) -> tuple[tuple | None, list[tuple]]:
        """The same for the passing of time: no row before mark will come any more."""
        return state, []

    def due(self, state: tuple | None) -> int | None:
        """When lapse() has something to do next."""
        return None


class Saves(Machine):
    """A writer that waits until a burst of rows is over, or writes at once with a row that saves, which takes back its timer."""

    def __init__(self, kind: str, gap: int):
        self.gap, self.state, self.out = gap, f"value {kind}, at long, n long", f"value {kind}, at long, n long, by_save boolean"

    def step(self, state, row):
        out = []
        if state and row.at - state[1] > self.gap:
            out, state = [(*state, False)], None
        now = (row.value, row.at, state[2] + 1 if state else 1)
        return (None, [*out, (*now, True)]) if row.save else (now, out)

    def lapse(self, state, mark):
        return (None, [(*state, False)]) if state and state[1] + self.gap < mark else (state, [])

    def due(self, state):
        return state[1] + self.gap if state else None


class Letters(Machine):
    """Letters that could not be delivered: the newest one waits until the sender comes back, unless a later one was delivered.

    Rows have an outcome: delivered, rejected (for good), kept, or back. A letter that has waited for keep or longer lapses."""

    def __init__(self, kind: str, keep: int | None = None):
        self.keep, self.state, self.out = keep, f"value {kind}, at long", f"value {kind}, at long, sent_at long"

    def step(self, state, row):
        if row.outcome == "back":
            lapsed = state and self.keep is not None and row.at - state[1] >= self.keep
            return None, [(*state, row.at)] if state and not lapsed else []
        if row.outcome == "kept":
            return (row.value, row.at), []
        return (None if row.outcome == "delivered" else state), []

    def lapse(self, state, mark):
        return (None if state and self.keep is not None and state[1] + self.keep < mark else state), []

    def due(self, state):
        return state[1] + self.keep if state and self.keep is not None else None


class Periods(Machine):
    """A writer that looks at the end of each period, and writes the last value if it isn't what it wrote before."""

    def __init__(self, kind: str, period: int):
        self.period = period
        self.state, self.out = f"value {kind}, ends long, written {kind}, some boolean", f"value {kind}, at long"

    def flush(self, state):
        value, ends, written, some = state
        dirty = ends is not None and not (some and value == written)
        return (value, None, value if dirty else written, some or dirty), [(value, ends)] if dirty else []

    def step(self, state, row):
        ends, out = (row.at // self.period + 1) * self.period, []
        if state and state[1] is not None and state[1] != ends:
            state, out = self.flush(state)
        return (row.value, ends, *(state[2:] if state else (None, False))), out

    def lapse(self, state, mark):
        return self.flush(state) if state and state[1] is not None and state[1] <= mark else (state, [])

    def due(self, state):
        return state[1] if state else None


#: Rows of one entry of a state, which goes between Python and Spark at once.
CHUNK = 10_000

#: How kinds that JSON has no exact values of are written into it, and read back. Integers, strings and booleans stay.
CODES: dict[str, tuple[Callable[[Column], Column], Callable]] = {
    "double": (lambda c: c, float),
    "float": (lambda c: c.cast("double"), float),
    "decimal": (lambda c: c.cast("string"), Decimal),
    "date": (lambda c: c.cast("string"), date.fromisoformat),
    "timestamp": (F.unix_micros, lambda t: datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=t)),
    "timestamp_ntz": (lambda c: c.cast("string"), datetime.fromisoformat),
    "binary": (F.base64, b64decode),
}
FRACTIONS = {"double", "float"}
PLAIN = {"tinyint", "smallint", "int", "bigint", "boolean", "string"}


def codes(kinds: list[str]) -> list[tuple[Callable, Callable] | None]:
    names = [k.split("(")[0] for k in kinds]
    if others := {k for k in names if k not in PLAIN and k not in CODES}:
        raise ValueError(f"rows in order can't hold columns of {sorted(others)}")
    return [CODES.get(k) for k in names]


def coded(columns: list[Column], kinds: list[str]) -> Column:
    """Columns as one string, which reaches Python far sooner than they do one by one."""
    pairs = zip(columns, codes(kinds))
    return F.to_json(F.struct(*[(code[0](c) if code else c).alias(f"c{i}") for i, (c, code) in enumerate(pairs)]), {"ignoreNullFields": "false"})


def decoded(text: str, back: list[Callable | None]) -> list:
    """Their values again; back: by what those of other kinds than JSON's are read."""
    values = json.loads(text).values()
    return [v if f is None or v is None else f(v) for v, f in zip(values, back)] if any(back) else list(values)


def parts(columns: str) -> list[list[str]]:
    """Names and kinds of columns."""
    return [part.split(" ", 1) for part in columns.split(", ")]


def chunks(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows as entries of a state that has an array for each column."""
    return (tuple(map(list, zip(*part))) for part in batched(rows, CHUNK))


class InOrder(StatefulProcessor):
    """Runs a machine over each key's rows in order, for a bucket of keys at once.

    Each call to a state goes to the JVM and back, which takes longer than many rows. So a bucket of keys has the states,
    their entries are chunks of rows, and there are a few calls for each bucket whatever it holds.

    keys, rows: the kinds of the columns in the keys' and the rows' strings; names: what the latter are called, but for at;
    order: how many of them break ties of time. Fractions are given out as text, since pandas takes NaN for null."""

    def __init__(self, machine: Machine, keys: list[str], rows: list[str], names: list[str], order: int):
        self.machine, self.names, self.order = machine, names, order
        self.out = [*([f"key_{i}", k] for i, k in enumerate(keys)), *parts(machine.out)]
        self.keys, self.rows = ([code and code[1] for code in codes(kinds)] for kinds in (keys, rows))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.done = handle, set()
        self.waiting = handle.getListState("waiting", "at array<long>, key array<string>, row array<string>")
        self.kept = handle.getListState("kept", ", ".join(f"{n} array<{k}>" for n, k in parts(f"_key string, {self.machine.state}")))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            at = part["at"].tolist()
            self.waiting.appendValue((at, part["key"].tolist(), part["row"].tolist()))
            first = min(at if first is None else [first, *at])
        self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def read(self, state) -> Iterator[tuple]:
        return (r for chunk in state.get() for r in zip(*chunk))

    def write(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put(list(chunks(rows)))
        else:
            state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.done:  # another timer of the bucket, which has done all up to this watermark
            return
        self.done.add(key)
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        states = {k: tuple(state) for k, *state in self.read(self.kept)}
        row, ready, rest = Row("at", *self.names), {}, []
        for r in self.read(self.waiting):
            if r[0] < mark:
                ready.setdefault(r[1], []).append((r[0], *decoded(r[2], self.rows)))
            else:
                rest.append(r)
        due, kept, given, last = [r[0] for r in rest], [], [], 1 + self.order
        for k in [*states, *(k for k in ready if k not in states)]:
            state, out = states.get(k), []
            for r in sorted(ready.get(k, ()), key=lambda r: r[:last]):
                state, more = self.machine.step(state, row(*r))
                out += more
            state, more = self.machine.lapse(state, mark)
            if out or more:
                values = decoded(k, self.keys)
                given += [(*values, *x) for x in [*out, *more]]
            if state is not None:
                kept.append((k, *state))
                due.append(self.machine.due(state))
        self.write(self.waiting, rest)
        self.write(self.kept, kept)
        next_ = min((t for t in due if t is not None), default=None)
        wanted = None if next_ is None else next_ // 1000 + 1
        for old in list(self.handle.listTimers()):
            if old != wanted:
                self.handle.deleteTimer(old)
        if wanted is not None:
            self.handle.registerTimer(wanted)
        if given:
            columns = [[x if x is None or k not in FRACTIONS else repr(float(x)) for x in c] for (_, k), c in zip(self.out, zip(*given))]
            yield pd.DataFrame(dict(zip((n for n, _ in self.out), columns)), dtype=object)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, keys: list[str], time: str, order: list[str], machine: Machine, late: str, buckets: int = 1024, **columns: Column) -> DataFrame:
    """A stream of what the machine gives out for each key; columns: what its rows have besides at.

    buckets: how many the keys are dealt over. One is put in order in memory, and its keys' kept values are read and written
    together; as the number of shuffle partitions, that of buckets can't change for a checkpoint."""
    kinds, rows = dict(events.dtypes), [*map(F.col, order), *columns.values()]
    key_kinds, row_kinds = [kinds[k] for k in keys], [k for _, k in events.select(*rows).dtypes]
    packed = events.select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"),
        time,
        F.unix_micros(time).alias("at"),
        coded([F.col(k) + F.lit(0.0) if kinds[k] in FRACTIONS else F.col(k) for k in keys], key_kinds).alias("key"),  # one zero, as in grouping
        coded(rows, row_kinds).alias("row"),
    )
    processor = InOrder(machine, key_kinds, row_kinds, [*order, *columns], len(order))
    out = ", ".join(f"{n} {'string' if k in FRACTIONS else k}" for n, k in processor.out)
    given = packed.withWatermark(time, late).groupBy("bucket").transformWithStateInPandas(processor, out, "append", "eventTime")
    given = given.withColumns({n: F.col(n).cast(k) for n, k in processor.out if k in FRACTIONS})
    return given.withColumnsRenamed({f"key_{i}": k for i, k in enumerate(keys)})

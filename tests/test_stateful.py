"""Streams in order, whatever order rows come in; a table that batches are merged into."""

import random
from datetime import date, datetime, timezone
from decimal import Decimal
from threading import Thread

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.sources.versioned import Conflict, Versioned
from tidemark.streaming import events as streams
from tidemark.streaming.ordered import PROVIDER, InOrder, Letters, Periods, Saves, coded, codes, decoded, in_order, states_on_disk


def walked(machine, rows, marks=()):
    """What a machine gives out over rows, with time passing up to each mark after the rows before it."""
    state, out, marks = None, [], sorted(marks)
    for r in sorted(rows):
        while marks and marks[0] <= r.at:
            state, more = machine.lapse(state, marks.pop(0))
            out += more
        state, more = machine.step(state, r)
        out += more
    for m in [*marks, 10**9]:
        state, more = machine.lapse(state, m)
        out += more
    return out


def test_machines_by_hand():
    row = Row("at", "value", "save")
    rows = [row(1, "a", False), row(5, "b", False), row(16, "c", False), row(20, "d", True), row(21, "e", False)]
    assert walked(Saves("string", 10), rows) == [("b", 5, 2, False), ("d", 20, 2, True), ("e", 21, 1, False)]
    row = Row("at", "value", "outcome")
    rows = [row(1, 1, "kept"), row(2, 2, "kept"), row(3, 3, "rejected"), row(4, 4, "back"), row(5, 5, "back"), row(6, 6, "kept"), row(7, 7, "delivered"), row(8, 8, "back"), row(9, 9, "kept"), row(99, 0, "back")]
    assert walked(Letters("int"), rows) == [(2, 2, 4), (9, 9, 99)] and walked(Letters("int", 50), rows) == [(2, 2, 4)]
    row = Row("at", "value")
    rows = [row(1, "a"), row(2, "b"), row(11, "b"), row(25, "c"), row(31, None), row(41, None), row(51, "c")]
    assert walked(Periods("string", 10), rows) == [("b", 10), ("c", 30), (None, 40), ("c", 60)]


@pytest.mark.parametrize("make", [lambda: Saves("string", 7), lambda: Letters("string", 30), lambda: Periods("string", 9)])
def test_passing_time_changes_nothing(make):
    """Marks that no row is behind give the same rows, only sooner."""
    draw, row = random.Random(3), Row("at", "value", "save", "outcome")
    for _ in range(50):
        rows = [row(i * 3 + draw.randrange(3), draw.choice("abc"), draw.random() < 0.2, draw.choice(["kept", "kept", "delivered", "rejected", "back"])) for i in range(40)]
        assert walked(make(), rows, [draw.randrange(130) for _ in range(20)]) == walked(make(), rows)


def test_any_order_gives_the_same_rows(spark, tmp_path):
    """Rows in order, and shuffled within the lateness, over several files; null values and equal times."""
    draw = random.Random(1)
    rows = [(i % 3 or None, i // 2 * 60, i, draw.choice(["a", "b", None]), draw.random() < 0.3) for i in range(240)]
    given = []
    for name, late in (("sorted", 0), ("late", 20)):
        comes = sorted(rows, key=lambda r: r[2] + draw.randrange(late + 1))
        parts = [spark.createDataFrame(comes[i : i + 60], "k int, s long, id int, v string, save boolean").select("k", F.timestamp_seconds("s").alias("ts"), "id", "v", "save") for i in range(0, 240, 60)]
        out = streams.run_over_slices(parts, lambda s: in_order(s, ["k"], "ts", ["id"], Saves("string", 150_000_000), "30 minutes", value=F.col("v"), save=F.col("save")), str(tmp_path / name))
        given.append(sorted(map(repr, out.collect())))
    assert given[0] == given[1] and len(given[0]) > 30
    before = spark.conf.get(PROVIDER)
    with states_on_disk(spark):
        assert spark.conf.get(PROVIDER) != before
    assert spark.conf.get(PROVIDER) == before


class Calls:
    """A handle, its states and timer values in one, which counts the calls."""

    def __init__(self):
        self.n, self.held, self.timers = 0, {}, set()

    def getListState(self, name, _):
        self.held[name] = []
        return ListCalls(self, name)

    def registerTimer(self, t):
        self.n += 1
        self.timers.add(t)

    def listTimers(self):
        self.n += 1
        return list(self.timers)

    def deleteTimer(self, t):
        self.n += 1
        self.timers.discard(t)

    def getCurrentWatermarkInMs(self):
        return 1000


class ListCalls:
    def __init__(self, calls, name):
        self.calls, self.name = calls, name

    def appendValue(self, value):
        self.calls.n += 1
        self.calls.held[self.name].append(value)

    def put(self, values):
        self.calls.n += 1
        self.calls.held[self.name] = list(values)

    def get(self):
        self.calls.n += 1
        return iter(self.calls.held[self.name])

    def clear(self):
        self.calls.n += 1
        self.calls.held[self.name] = []


def test_calls_to_states_go_by_bucket_not_by_key():
    """A hundred times the keys and rows of a bucket take no more calls; the second of its timers does nothing."""
    took = []
    for n in (3, 300):
        calls = Calls()
        p = InOrder(Saves("string", 7), ["int"], ["int", "string", "boolean"], ["id", "value", "save"], 1)
        p.init(calls)
        rows = pd.DataFrame([(at, f'{{"c0":{k}}}', f'{{"c0":{at},"c1":"a","c2":{str(at == 20).lower()}}}') for k in range(n) for at in (30, 20, 10, 2_000_000)], columns=["at", "key", "row"])
        assert list(p.handleInputRows((0,), iter([rows]), calls)) == []
        out = [tuple(r) for part in p.handleExpiredTimer((0,), calls, None) for r in part.itertuples(index=False)]
        assert sorted(out) == sorted(x for k in range(n) for x in [(k, "a", 10, 1, False), (k, "a", 20, 1, True), (k, "a", 30, 1, False)])
        assert sum(len(c[0]) for c in calls.held["waiting"]) == n and calls.held["kept"] == [] and calls.timers == {2001}
        took.append(calls.n)
        assert list(p.handleExpiredTimer((0,), calls, None)) == [] and calls.n == took[-1]
    assert took[0] == took[1]


def test_strings_of_rows_are_exact(spark):
    """What goes to a machine comes as it was."""
    row = [2**63 - 1, None, "\x00\"\u2028é\U0001f30a", "", True, 0.1, float("inf"), -1e-320, Decimal("12345678901234567890.0123456789"), date(1, 1, 1), datetime(2024, 2, 29, 1, 2, 3, 456789), datetime(1969, 1, 1, 0, 0, 0, 1), b"\xff\x00", None]
    df = spark.createDataFrame([row], "a long, b long, c string, d string, e boolean, f double, g double, h double, i decimal(38,10), j date, k timestamp_ntz, l timestamp_ntz, m binary, n double")
    df = df.withColumn("o", F.timestamp_seconds(F.lit(-1.5))).withColumn("p", F.lit("NaN").cast("double"))
    kinds = [k for _, k in df.dtypes]
    got = decoded(df.select(coded([F.col(c) for c in df.columns], kinds)).first()[0], [code and code[1] for code in codes(kinds)])
    assert got[:-2] == row and [type(x) for x in got[:-2]] == [type(x) for x in row]
    assert got[-2] == datetime(1969, 12, 31, 23, 59, 58, 500000, timezone.utc) and got[-1] != got[-1]
    with pytest.raises(ValueError):
        codes(["array<int>"])


def test_odd_keys_and_values(spark, tmp_path):
    """Keys that Spark groups together stay together, in one bucket or many; numbers beside nulls keep their digits."""
    big, nan = 2**60 + 1, float("nan")
    keys = [0.0, -0.0, nan, nan, None, None, 1.5, 1.5]
    rows = [(k, 60 + 60 * (i % 2), i, big + i if i % 2 == 0 and i != 4 else None, "back" if i % 2 else "kept") for i, k in enumerate(keys)] + [(9.0, 9999, 99, None, "rejected")]
    df = spark.createDataFrame(rows, "k double, s long, id int, v long, outcome string").select("k", F.timestamp_seconds("s").alias("ts"), "id", "v", "outcome")
    for buckets in (1, 1000):
        out = streams.run_over_slices([df], lambda s: in_order(s, ["k"], "ts", ["id"], Letters("long"), "1 minute", buckets, value=F.col("v"), outcome=F.col("outcome")), str(tmp_path / str(buckets)))
        assert sorted(map(repr, out.collect())) == sorted(f"Row(k={k}, value={v}, at=60000000, sent_at=120000000)" for k, v in [(0.0, big), (nan, big + 2), (None, None), (1.5, big + 6)])


KIND = "k int, o int, v string"


def changes(spark, *rows):
    return spark.createDataFrame(rows, f"{KIND}, gone boolean")


def test_merges(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "t"), KIND, ["k"], ["o"], buckets=4)
    assert t.version() == 0 and t.rows().count() == 0
    assert t.merge(changes(spark, (1, 1, "a", False), (1, 3, "c", False), (1, 2, "b", False), (2, 1, None, False), (None, 1, "n", False)), "w", 0) == 1
    assert sorted(map(tuple, t.rows().collect()), key=str) == [(1, 3, "c"), (2, 1, None), (None, 1, "n")]
    assert t.merge(changes(spark, (1, 9, "z", False)), "w", 0) == 1 and t.rows().filter("v = 'z'").count() == 0  # the same batch again
    assert t.merge(changes(spark, (1, 2, "old", False), (2, 5, None, True)), "w", 1) == 2
    assert sorted(map(tuple, t.rows().collect()), key=str) == [(1, 3, "c"), (None, 1, "n")]
    assert t.merge(changes(spark, (2, 4, "late", False)), "w", 2) == 3 and t.rows().count() == 2  # older than the deletion
    assert t.merge(changes(spark, (2, 6, "new", False)), "other", 0) == 4 and t.rows().count() == 3
    assert t.rows(1).count() == 3 and t.rows(2).count() == 2  # earlier versions are still there


def test_only_changed_buckets_are_written(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "t"), KIND, ["k"], ["o"], buckets=8)
    t.merge(spark.range(100).selectExpr("cast(id as int) k", "1 o", "'x' v", "false gone"), "w", 0)
    before = t.manifest()["buckets"]
    assert len(before) == 8
    t.merge(changes(spark, (5, 2, "y", False), (6, 0, "older", False)), "w", 1)
    after = t.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and t.rows().filter("v <> 'x'").count() == 1
    t.merge(changes(spark, (5, 2, "y", False)), "w", 2)  # nothing newer: no file is written
    assert t.manifest()["buckets"] == after and t.manifest()["batches"] == {"w": 2}


def test_two_writers(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "t"), KIND, ["k"], ["o"], buckets=2)
    first = t._merged(t.manifest(), changes(spark, (1, 1, "a", False)), "a", 0)
    t.merge(changes(spark, (2, 1, "b", False)), "b", 0)
    with pytest.raises(Conflict):
        t._commit(first)
    tasks = [Thread(target=t.merge, args=(changes(spark, (10 + i, 1, str(i), False)), f"w{i}", 0)) for i in range(3)]
    for x in tasks:
        x.start()
    for x in tasks:
        x.join()
    assert sorted(r.k for r in t.rows().collect()) == [2, 10, 11, 12] and t.version() == 4


def test_migration_of_odd_values(spark):
    rows = [("r-a-1", '{"content": "x"}'), ("r-a-2", "[1]"), ("r-a-3", "no json"), ("r-a-4", '{"content": "y"}'), ("r-b-c-1", '{"content": ""}'), ("q-p_s", "text"), ("q-p_t", "text"), ("q-p_s2", " "), ("c-1", '{"k": {"commitment": "c", "reflection": "r"}}'), ("c-2", "broken"), ("c-3", "{}"), ("other", "v"), ("r-z-1", None)]
    out = store.migration(spark.createDataFrame(rows, "key string, value string"), "r-", "six", "q-", ["p"], ["s"], "c-").collect()
    assert sorted(r.key for r in out if r.gone) == ["c-1", "c-3", "q-p_s", "r-a-1"]
    assert len([r for r in out if not r.gone]) == 4 and all(r.key.startswith("entry/") for r in out if not r.gone)


def test_new_buckets_are_written_once(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "t"), KIND, ["k"], ["o"], buckets=4)
    rows = spark.range(20).selectExpr("int(id) AS k", "1 AS o", "'a' AS v", "id = 3 AS gone").select([f.name for f in t.schema.fields])
    t.merge(rows, "w", 0)
    assert not (tmp_path / "t" / "data").exists()
    assert {r["k"] for r in t.rows().collect()} == {*range(20)} - {3}

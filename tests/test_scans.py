"""Scans against loops: one key over many blocks, nulls, each family of maps."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers
from tidemark.operators import catalog, scans


def looped(rows, step, first):
    """(key, order) -> state, by going through the rows."""
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        state[r[0]] = step(state.get(r[0], first), r)
        out[r[0], r[1]] = state[r[0]]
    return out


@pytest.mark.parametrize("block", [3, 50, 10_000])
def test_clamps(spark, block):
    draw = random.Random(1)
    rows = [(draw.choice([1, 1, 1, 1, 2, None]), i, draw.choice([-2, -1, 1, 2]), draw.random() < 0.1) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, n int, step int, jump boolean").repartition(8)
    maps = {"low": F.when(F.col("jump"), 4).otherwise(0), "high": F.when(F.col("jump"), 4).otherwise(9), "step": F.col("step")}
    out = scans.scanned(df, ["k"], ["n"], scans.Clamps, maps, F.lit(5), "x", block)
    assert out.columns == [*df.columns, "x"]
    want = looped(rows, lambda x, r: 4 if r[3] else max(0, min(9, x + r[2])), 5)
    assert {(r.k, r.n): r.x for r in out.collect()} == want


def test_one_key_is_spread_over_tasks(spark):
    df = spark.range(8000).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("t"), (F.col("id") % 3 - 1).alias("step"))
    out = scans.scanned(df, ["k"], ["t"], scans.Clamps, {"low": F.lit(-100), "high": F.lit(100), "step": F.col("step")}, F.lit(0), "x", 1000)
    sizes = scans.cuts(df, ["k"], F.unix_micros("t"), 1000).collect()
    assert len(sizes) == 1 and len(sizes[0]._cuts) == 7
    assert out.agg(F.count("*"), F.sum("x")).first() == (8000, sum([-1, -1, 0][i % 3] for i in range(8000)))


def test_lines_and_tables(spark):
    draw = random.Random(2)
    rows = [(i % 2, i, draw.choice([0.5, 0.0, -1.0]), float(draw.randrange(8)), [draw.randrange(4) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, n int, a double, b double, to array<int>")
    out = scans.scanned(df, ["k"], ["n"], scans.Lines, {"slope": F.col("a"), "shift": F.col("b")}, F.lit(1.0), "x", 40)
    assert {(r.k, r.n): r.x for r in out.collect()} == pytest.approx(looped(rows, lambda x, r: r[2] * x + r[3], 1.0))
    out = scans.scanned(df, ["k"], ["n"], scans.Tables, {"to": F.col("to")}, F.lit(2), "x", 40)
    assert {(r.k, r.n): r.x for r in out.collect()} == looped(rows, lambda x, r: r[4][x], 2)
    assert scans.scanned(df.filter("false"), ["k"], ["n"], scans.Tables, {"to": F.col("to")}, F.lit(2), "x").count() == 0


def test_player(spark):
    draw = random.Random(4)
    rows = [(i % 3, i, draw.choice(["next", "back", "ended", "repeat", "play", "x", None]), draw.choice([None, 0, 3, 6, 9])) for i in range(600)]

    def step(state, r):
        track, mode = state
        action, target, n = r[2], r[3], 5
        if action == "repeat":
            return track, (mode + 1) % 3
        if action == "play" and target is not None and target < n:
            return target, mode
        if action in ("next", "back") and track >= 0:
            new = track + (1 if action == "next" else -1)
            return (new if 0 <= new < n else (new % n if mode == 1 else track)), mode
        if action == "ended" and track >= 0 and mode != 2:
            return (track + 1 if track + 1 < n else 0 if mode == 1 else -1), mode
        return state

    out = catalog.played(spark.createDataFrame(rows, "k int, n int, action string, target int"), ["k"], ["n"], 5, block=60).collect()
    assert {(r.k, r.n): (r.track, ["none", "all", "one"].index(r.repeat)) for r in out} == looped(rows, step, (-1, 0))


def test_rounding_by_binary_values(spark):
    """Against Python's round() on ties that aren't, real ties, and drawn numbers."""
    draw = random.Random(6)
    values = [2.6745, 2.675, 1.0005, 0.0005, 0.0015, 2058.2625, 0.5, 0.0, -2.6745, -0.0005, 1e9 + 0.0005, 0.125, 0.0625] + [draw.randrange(10**7) / 10**4 for _ in range(3000)] + [draw.uniform(0, 9000) for _ in range(500)] + [i / 16 for i in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", *[numbers.rounded(F.col("x"), p).alias(f"p{p}") for p in (0, 1, 3)]).collect()
    for r in rows:
        assert (r.p0, r.p1, r.p3) == (round(r.x, 0), round(r.x, 1), round(r.x, 3)), r.x

"""Operators on ordered rows within a key: latest, changes, carried values, neighbours, running marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], *values: str) -> DataFrame:
    """The values of the last row by order for each key, and the first row's ones as first_<value>.

    An aggregation, so rows are combined before they shuffle and a hot key is no large task."""
    out = df.groupBy(*keys).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("_last"), F.min(F.struct(*order, *[v for v in values if v not in order])).alias("_first"))
    return out.select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values], *[F.col(f"_first.{v}").alias(f"first_{v}") for v in values])


def changes(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before it in the key; the first row counts. previous holds that one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("previous", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    return out.filter((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("previous"))).drop("_n")


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, reset: Column | None = None) -> DataFrame:
    """The last non-null value up to each row; a reset row forgets those before it."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kept = F.when(value.isNotNull(), F.struct(value.alias("v")))
    if reset is not None:
        kept = F.coalesce(kept, F.when(reset, F.struct(F.lit(None).alias("v"))))
    return df.withColumn(name, F.last(kept, ignorenulls=True).over(so_far)["v"])


def high_water(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "high") -> DataFrame:
    """The greatest value up to each row."""
    return df.withColumn(name, F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def crossings(df: DataFrame, keys: list[str], time: str, value: str, thresholds: dict[str, float]) -> DataFrame:
    """For each key the first time at which the value exceeds each threshold; null if it never does."""
    return df.groupBy(*keys).agg(*[F.min(F.when(F.col(value) > t, F.col(time))).alias(name) for name, t in thresholds.items()])


def debounced(df: DataFrame, keys: list[str], time: str, value: str, gap: str, blank: Column | None = None) -> DataFrame:
    """The last value of each burst: rows that follow each other within the gap or less. A burst whose last value is
    blank gives none."""
    rows = df.groupBy(*keys, F.session_window(time, gap)).agg(F.max_by(value, F.struct(time, value)).alias(value), F.max(time).alias("last_at"), F.count("*").alias("n_events"))
    return (rows.filter(~blank) if blank is not None else rows).drop("session_window")


def neighbours(df: DataFrame, keys: list[str], order: list[str], value: str, wrap: bool) -> DataFrame:
    """previous and next value within the key; at the ends the other end's if wrap, else null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    first, last, n = F.first(value).over(whole), F.last(value).over(whole), F.row_number().over(w)
    if not wrap:
        return df.withColumns({"previous": before, "next": after})
    size = F.count("*").over(whole)
    return df.withColumns({"previous": F.when(n == 1, last).otherwise(before), "next": F.when(n == size, first).otherwise(after)})


def numbered_union(parts: dict[str, DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """The parts one after the other, with one running number for each key."""
    rows = None
    for i, (name, part) in enumerate(parts.items()):
        part = part.withColumns({"section": F.lit(name), "_part": F.lit(i)})
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("_part", *order))).drop("_part")


def filled_ends(df: DataFrame, keys: list[str], order: str, start: str, end: str) -> DataFrame:
    """Where an interval has no length, the next one's start is its end; intervals that still have none go."""
    after = F.lead(start).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(end, F.when(F.col(end) <= F.col(start), after).otherwise(F.col(end))).filter(F.col(end) > F.col(start))


def newest_first(time: str, *ties: str) -> list[Column]:
    """An order: the latest first, rows without a time last."""
    return [F.col(time).desc_nulls_last(), *map(F.col, ties)]


def by_number(text: str, *ties: str) -> list[Column]:
    """An order by a number in a text: a missing one is 0, texts that are no numbers come last."""
    number = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.lit(0.0)).otherwise(F.col(text).try_cast("double"))
    return [number.asc_nulls_last(), *map(F.col, ties)]


def chosen_first(chosen: Column, *ties: str) -> list[Column]:
    """An order: rows that are chosen, then the others."""
    return [F.coalesce(chosen, F.lit(False)).desc(), *map(F.col, ties)]


def shuffled(row_id: str, seed: int) -> list[Column]:
    """An order like a drawn permutation; the same for the same seed."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string"))), F.col(row_id)]


def placed(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place in its key by an order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def picked(df: DataFrame, ordinal: str, wanted: list[int]) -> DataFrame:
    """The listed rows that exist."""
    return df.filter(F.col(ordinal).isin(wanted))


def flushed(df: DataFrame, keys: list[str], time: str, order: list[str], value: str, gap: str, save: Column) -> DataFrame:
    """What a debounced writer with a save button writes: the last value of each burst, where a save ends a burst at once
    and is written with it, so nothing is written twice."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({"_save": F.coalesce(save, F.lit(False)), "_saves": F.coalesce(F.count_if(F.coalesce(save, F.lit(False))).over(before), F.lit(0))})
    last = F.struct(*[c for c in order], value)
    out = rows.groupBy(*keys, "_saves", F.session_window(time, gap)).agg(F.max_by(value, last).alias(value), F.max(time).alias("written_at"), F.count("*").alias("n_events"), F.max("_save").alias("by_save"))
    return out.drop("_saves", "session_window")


def flushes(df: DataFrame, keys: list[str], time: str, order: list[str], value: str, period: str) -> DataFrame:
    """What a writer that looks every period writes: the last value of a period, if it isn't what was written before."""
    ends = df.groupBy(*keys, F.window(time, period).alias("_w")).agg(F.max_by(value, F.struct(*order)).alias(value))
    return changes(ends.withColumn("flushed_at", F.col("_w.end")).drop("_w"), keys, ["flushed_at"], value).drop("previous")

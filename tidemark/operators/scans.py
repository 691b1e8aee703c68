"""States that each row of a key makes from the one before it, in parallel within the key.

A row is a map from a state to the next; maps of one family compose to maps of that family, whatever brackets are put. So a
key's rows are cut into blocks along their order. Each block is scanned alone, which gives every row the map of all rows of its block
up to it; the last ones compose to the state that each block begins with, and every row's map is applied to that. No task needs more than a
block of a key, and rows move once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import new_table

#: Rows of a key in one block, about.
BLOCK = 100_000


class Clamps:
    """x -> greatest(low, least(high, x + step)), in whole numbers."""

    names = {"low": "long", "high": "long", "step": "long"}

    @staticmethod
    def composed(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        """The maps of a, then those of b."""
        (low, high, step), (low2, high2, step2) = a, b
        return [np.clip(low + step2, low2, high2), np.clip(high + step2, low2, high2), step + step2]

    @staticmethod
    def applied(m: Column, x: Column) -> Column:
        return F.greatest(m["low"], F.least(m["high"], x + m["step"]))


class Tables:
    """x -> to[x], for states 0 to n - 1."""

    names = {"to": "array<int>"}

    @staticmethod
    def composed(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        return [np.take_along_axis(b[0], a[0], 1)]

    @staticmethod
    def applied(m: Column, x: Column) -> Column:
        return F.get(m["to"], x)


class Lines:
    """x -> slope * x + shift."""

    names = {"slope": "double", "shift": "double"}

    @staticmethod
    def composed(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        return [b[0] * a[0], b[0] * a[1] + b[1]]

    @staticmethod
    def applied(m: Column, x: Column) -> Column:
        return m["slope"] * x + m["shift"]


def inclusive(family, maps: list[np.ndarray]) -> list[np.ndarray]:
    """Each map after all before it: doubling steps over the whole array."""
    n, step = len(maps[0]), 1
    while step < n:
        later = family.composed([m[:-step] for m in maps], [m[step:] for m in maps])
        maps = [np.concatenate([m[:step], x]) for m, x in zip(maps, later)]
        step *= 2
    return maps


def cuts(df: DataFrame, keys: list[str], by: Column, block: int) -> DataFrame:
    """For each key of more rows than a block, about even places of by where it is cut: as many as the largest key needs."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") > block)
    most = large.agg(F.max(F.ceil(F.col("_n") / block))).first()[0]
    shares = F.array(*[F.lit(i / (most or 1)) for i in range(1, most or 2)])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_r.{k}").eqNullSafe(F.col(f"_l.{k}"))
    rows = df.select(*keys, by.alias("_by")).alias("_r").join(large.alias("_l"), same, "left_semi")
    return rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_by", shares, 10 * (most or 1))).alias("_cuts"))


def scanned(df: DataFrame, keys: list[str], order: list[str], family, maps: dict[str, Column], first: Column, name: str, block: int = BLOCK) -> DataFrame:
    """df with the state after each row, under a name; maps: the family's columns for each row, first: the state before the first row.

    Rows that tie in the whole order are taken in any order. A key of any number of rows is spread over its blocks."""
    value = F.unix_micros(F.col(order[0]).cast("timestamp")) if dict(df.dtypes)[order[0]].startswith(("timestamp", "date")) else F.col(order[0])
    large, on = cuts(df, keys, value, block), F.lit(True)
    for k in keys:
        on = on & F.col(f"_r.{k}").eqNullSafe(F.col(f"_l.{k}"))
    rows = df.withColumn("_by", value).alias("_r").join(large.alias("_l"), on, "left").select("_r.*", F.coalesce(F.size(F.filter("_l._cuts", lambda c: c < F.col("_by"))), F.lit(0)).alias("_block")).drop("_by")
    rows = rows.select("*", *[c.cast(kind).alias(f"_m_{n}") for (n, kind), c in zip(family.names.items(), [maps[n] for n in family.names])])
    columns = [f"_m_{n}" for n in family.names]

    def run(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part, sort_keys=[(o, "ascending") for o in order], null_placement="at_start"))
        arrays = []
        for c in columns:
            column = part.column(c).combine_chunks()
            lists = pa.types.is_list(column.type)
            arrays.append(column.flatten().to_numpy().reshape(len(part), -1) if lists else column.to_numpy())
        for c, found in zip(columns, inclusive(family, arrays)):
            kind = part.schema.field(c).type
            new = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel(), kind.value_type)) if found.ndim == 2 else pa.array(found, kind)
            part = part.set_column(part.schema.get_field_index(c), c, new.cast(kind))
        return part.append_column("_last", pa.array(np.arange(len(part)) == len(part) - 1))

    mapped = new_table(rows.groupBy(*keys, "_block").applyInArrow(run, rows.withColumn("_last", F.lit(True)).schema))
    whole = F.struct(*[F.col(c).alias(n) for c, n in zip(columns, family.names)])
    ends = mapped.filter("_last").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", whole.alias("m")))).alias("_ends"))
    kind = dict(df.select(first.alias("x")).dtypes)["x"]
    # each block begins with what the ones before it make of the first state
    start = F.struct(first.alias("x"), F.array().cast(f"array<struct<_block: int, x: {kind}>>").alias("all"))
    step = lambda acc, e: F.struct(family.applied(e["m"], acc["x"]).cast(kind).alias("x"), F.concat(acc["all"], F.array(F.struct(e["_block"].alias("_block"), acc["x"].alias("x")))).alias("all"))
    begins = ends.select(*keys, F.inline(F.aggregate("_ends", start, step)["all"])).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), F.col("x").alias("_x"))
    on = F.col("_block") == F.col("_b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return mapped.join(begins, on).select(*df.columns, family.applied(whole, F.col("_x")).cast(kind).alias(name))

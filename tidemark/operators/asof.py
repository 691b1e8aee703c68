"""As-of and nearest joins by a union of both sides and one window: a single shuffle, no row pairs.

The window needs a key's rows in one task; choose keys that no large share of the rows has, or add a time bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _stacked(probes: DataFrame, marks: DataFrame, keys: list[str], time: str, tie: str, values: list[str]) -> DataFrame:
    """Both sides in one table: probes carry their columns in _p, marks their values in _m."""
    p = probes.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"), F.struct(*probes.columns).alias("_p"))
    m = marks.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), F.struct(F.col(time).alias("_mt"), *values).alias("_m"))
    return p.unionByName(m, allowMissingColumns=True)


def asof(probes: DataFrame, marks: DataFrame, keys: list[str], time: str, tie: str, values: list[str], strategy: str = "asof") -> DataFrame:
    """Probes with the values of the last mark of their key at or before their time, as mark_<value>; null if none.

    Marks of equal time follow in the order of tie. 'asof' takes marks by time. 'prefix' takes them in the order of
    tie and stops at the first that is later than the probe, as a scan that breaks there does."""
    if strategy == "prefix":
        # the scan passes a mark exactly when the greatest time so far isn't later than the probe
        high = F.max(time).over(Window.partitionBy(*keys).orderBy(tie).rowsBetween(Window.unboundedPreceding, 0))
        marks = marks.withColumn("_own", F.col(time)).withColumn(time, high)
    both = _stacked(probes, marks, keys, time, tie, values)
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_m", F.last("_m", ignorenulls=True).over(w)).filter("_side = 1")
    return hit.select("_p.*", *[F.col(f"_m.{v}").alias(f"mark_{v}") for v in values])


def nearest(probes: DataFrame, marks: DataFrame, keys: list[str], time: str, tie: str, values: list[str]) -> DataFrame:
    """Probes with the values of the mark of their key that is nearest in time; the earlier one of two."""
    both = _stacked(probes, marks, keys, time, tie, values)
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_tie")
    before = F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    hit = both.withColumns({"_b": before, "_a": after}).filter("_side = 1")
    back, on = micros(F.col("_t")) - micros(F.col("_b._mt")), micros(F.col("_a._mt")) - micros(F.col("_t"))
    pick = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull() | (back <= on), F.col("_b")).otherwise(F.col("_a"))
    return hit.withColumn("_m", pick).select("_p.*", *[F.col(f"_m.{v}").alias(f"mark_{v}") for v in values])

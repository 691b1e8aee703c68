"""Streaming twins of the event operators: the same rows as in a batch, from a stream of files.

Event times without a zone are cast on reading, as watermarks need instants."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ordered import states_on_disk


def read_events(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """Events of the Parquet files under the path, or of the one file it names; a stream reads folders alone."""
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    folder, _, name = path.rpartition("/")
    if any(f"/{name}/" in f for f in table.inputFiles()[:1]):
        rows = stream.parquet(path)
    else:
        rows = stream.option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def debounced_stream(events: DataFrame, keys: list[str], time: str, value: str, gap: str, late: str) -> DataFrame:
    """The last value of each burst, once the watermark has passed it."""
    rows = events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap))
    return rows.agg(F.max_by(value, F.struct(time, value)).alias(value), F.max(time).alias("last_at"), F.count("*").alias("n_events"))


def changes_stream(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before it in the key, across micro-batches; a micro-batch is put in order."""
    fields = [f for f in events.schema.fields if f.name in {key, value, *order}]
    names = [f.name for f in fields]
    kind = dict(events.dtypes)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        known = state.exists
        before = rows[value].shift(1)
        if known and len(rows):
            before.iloc[0] = state.get[0]
        differs = ~((rows[value] == before) | (rows[value].isna() & before.isna()))
        if not known and len(rows):
            differs.iloc[0] = True
        if len(rows):
            last = rows[value].iloc[-1]
            state.update((None if pd.isna(last) else last,))
        out = rows[names].assign(previous=before)[differs]
        yield out

    columns = ", ".join(f"{n} {kind[n]}" for n in names) + f", previous {kind[value]}"
    return events.groupBy(key).applyInPandasWithState(run, columns, f"last {kind[value]}", "append", GroupStateTimeout.NoTimeout)


def periodic_stream(events: DataFrame, keys: list[str], time: str, order: list[str], value: str, period: str, late: str) -> DataFrame:
    """The last value of each period in which there was one, once the watermark has passed the period's end."""
    rows = events.withWatermark(time, late).groupBy(*keys, F.window(time, period).alias("_w"))
    out = rows.agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("n_events"))
    return out.withColumn("flushed_at", F.col("_w.end")).drop("_w")


def marks_stream(events: DataFrame, keys: list[str], time: str, value: str, thresholds: dict[str, float]) -> DataFrame:
    """High-water mark and first crossing of each threshold per key."""
    firsts = [F.min(F.when(F.col(value) > t, F.col(time))).alias(name) for name, t in thresholds.items()]
    return events.groupBy(*keys).agg(F.max(value).alias("high"), *firsts)


def new_name() -> str:
    return f"stream-{uuid.uuid4().hex}"


def run_over_slices(slices: list[DataFrame], stream_of: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Writes one slice after the other as files, and runs the stream over what is there after each, from where it left off; what it gave out."""
    spark = slices[0].sparkSession
    for i, part in enumerate(slices):
        part.write.parquet(f"{path}/in/slice={i}")
        stream = stream_of(spark.readStream.schema(part.schema).option("recursiveFileLookup", True).parquet(f"{path}/in"))
        with states_on_disk(spark):
            run_to_table(stream, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there now and reads what it wrote under the path."""
    spark = stream.sparkSession
    schema = stream.schema
    if mode == "append":
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    else:

        def keep(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/rows")

        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/rows")

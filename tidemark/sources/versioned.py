"""A table of keyed rows that batches are merged into.

Files are never changed: a merge writes the buckets of keys that it changes into a new folder, and then a manifest, which
says where each bucket lies and which batch of each writer is the last one in it. Creating the manifest of the next version is the commit;
it fails if another writer was first, and the merge is done again on what that one left. A batch that comes twice does
nothing the second time, and a reader sees the one version that it began with.

Rows have keys, an order (the newest row of a key counts, however late it comes) and values; deleted rows stay as marks with their order, so that an older
row doesn't bring them back."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIES = 10


class Conflict(Exception):
    """Another writer made this version first."""


class Versioned:
    """schema: of keys, order and values as text, like "id long, at timestamp, v string"; gone is a name for the mark of deleted rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str], buckets: int = 16, gone: str = "gone"):
        self.spark, self.path, self.keys, self.order, self.gone, self.buckets = spark, path.rstrip("/"), keys, order, gone, buckets
        self.schema = spark.createDataFrame([], f"{schema}, {gone} boolean").schema
        self.values = [f.name for f in self.schema.fields if f.name not in (*keys, *order)]

    def _files(self, name: str = ""):
        """The manifests' file system and a path there."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        files, folder = self._files()
        return max((int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()), default=0) if files.exists(folder) else 0

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "buckets": {}, "batches": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{version:012d}").collect()))

    def _commit(self, manifest: dict) -> None:
        """Creates a manifest's file, unless it is there."""
        files, path = self._files(f"{manifest['version']:012d}")
        try:
            out = files.create(path, False)
        except Exception as e:
            if files.exists(path):
                raise Conflict from e
            raise
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = [f for b, f in manifest["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of a version, without deleted ones."""
        return self._read(self.manifest(version)).filter(~F.col(self.gone)).drop(self.gone)

    def merge(self, batch: DataFrame, writer: str, number: int) -> int:
        """Merges batch number of a writer, if it isn't in the table yet; the version that holds it."""
        for _ in range(TRIES):
            manifest = self.manifest()
            if manifest["batches"].get(writer, -1) >= number:
                return manifest["version"]
            try:
                self._commit(self._merged(manifest, batch, writer, number))
                return manifest["version"] + 1
            except Conflict:
                continue
        raise Conflict

    def _merged(self, manifest: dict, batch: DataFrame, writer: str, number: int) -> dict:
        """The next manifest, after the buckets that change were written."""
        row = F.struct(*self.order, *self.values)
        folder = f"batches/{uuid.uuid4().hex}"
        newest = batch.groupBy(*self.keys).agg(F.max(row).alias("_new")).withColumn("_bucket", self._bucket())
        newest = newest.select("_bucket", *self.keys, "_new.*").select("_bucket", *[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        newest.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        newest = self.spark.read.schema(newest.schema).parquet(f"{self.path}/{folder}").select("_bucket", *self.keys, row.alias("_new"))
        touched = [r[0] for r in newest.select("_bucket").distinct().collect()]
        # what a batch brings to a bucket that has no rows yet is the bucket
        buckets = dict(manifest["buckets"]) | {str(b): f"{folder}/_bucket={b}" for b in touched if str(b) not in manifest["buckets"]}
        touched = [b for b in touched if str(b) in manifest["buckets"]]
        newest = newest.filter(F.col("_bucket").isin(touched))
        order = lambda c: F.struct(*[F.col(f"{c}.{o}") for o in self.order])
        old = self._read(manifest, touched).select(*self.keys, row.alias("_old")).withColumn("_bucket", self._bucket())
        # the orders of rows tell which buckets change; only these are read and written whole
        dated = old.select("_bucket", *self.keys, order("_old").alias("_was"))
        newer = newest.join(dated, ["_bucket", *self.keys], "left").filter(F.col("_was").isNull() | (order("_new") > F.col("_was")))
        changed = [r[0] for r in newer.select("_bucket").distinct().collect()] if touched else []
        if changed:
            both = old.filter(F.col("_bucket").isin(changed)).join(newest.filter(F.col("_bucket").isin(changed)), ["_bucket", *self.keys], "full")
            take = F.col("_old").isNull() | (order("_new") > order("_old"))
            out = both.select("_bucket", *self.keys, F.when(F.coalesce(take, F.lit(False)), F.col("_new")).otherwise(F.col("_old")).alias("_row"))
            folder = f"data/{uuid.uuid4().hex}"
            out.select("_bucket", *self.keys, "_row.*").select("_bucket", *self.schema.names).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            buckets |= {str(b): f"{folder}/_bucket={b}" for b in changed}
        return {"version": manifest["version"] + 1, "buckets": buckets, "batches": manifest["batches"] | {writer: number}}

    def sink(self, writer: str) -> Callable[[DataFrame, int], None]:
        """What foreachBatch calls: a stream's micro-batches are merged once each, also after a restart."""

        def into(batch: DataFrame, number: int) -> None:
            self.merge(batch, writer, number)

        return into


"""Writers. None overwrites what it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.report import interval_json, interval_literal


def write_interval_json(df: DataFrame, path: str, chapter: str = "chapter_id") -> None:
    interval_json(df, chapter).select("json").write.text(path)


def write_interval_literals(df: DataFrame, path: str, chapter: str = "chapter_id") -> None:
    interval_literal(df, chapter).select("literal").write.text(path)


def write_buckets(df: DataFrame, path: str, bucket: str = "chapterId") -> None:
    """Entries by bucket; buckets that df has are replaced as a whole, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)


def decoded_audio(df: DataFrame, column: str) -> DataFrame:
    """df with bytes (decoded base64) and megabytes."""
    return df.withColumn("bytes", F.unbase64(column)).withColumn("megabytes", F.octet_length("bytes") / 1048576)

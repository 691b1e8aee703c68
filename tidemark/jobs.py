"""Jobs for spark-submit: python -m tidemark.jobs JOB IN... OUT.

    characters IN SENTENCES OUT            timed characters (JSON) and sentences (a line each) to intervals (JSON)
    transcript IN SENTENCES OUT [STRATEGY] timed words of a transcript (JSON) and sentences to intervals (JSON)
    labels IN OUT                          label tracks (tab-separated) to intervals as a script's literals
    query NAME TABLES OUT                  a registered query over a folder of Parquet tables, to Parquet

IN and SENTENCES are folders of files; a file's name without its ending is its chapter. OUT must not be there yet."""

from __future__ import annotations

import inspect
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import align, ordered, report
from tidemark.sources import readers

STEM = r"([^/]+?)(?:\.[a-z]+)?$"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("chapter_id", F.regexp_extract(F.input_file_name(), STEM, 1))


def _written(texts: DataFrame, out: str) -> None:
    """A folder for each chapter."""
    texts.write.partitionBy("chapter_id").text(out)


def characters(spark: SparkSession, source: str, sentences: str, out: str) -> None:
    timed = readers.characters(_json(spark, source, readers.CHARACTERS), ["chapter_id"])
    found = align.aligned(readers.read_sentences(spark, sentences), align.words_of_characters(timed), "exact_prefix5")
    _written(report.interval_json(found, "chapter_id"), out)


def transcript(spark: SparkSession, source: str, sentences: str, out: str, strategy: str = "fuzzy") -> None:
    words = readers.transcript_words(_json(spark, source, readers.TRANSCRIPT), ["chapter_id"])
    _written(report.interval_json(align.aligned(readers.read_sentences(spark, sentences), words, strategy), "chapter_id"), out)


def labels(spark: SparkSession, source: str, out: str) -> None:
    rows = readers.read_labels(spark, source).withColumn("chapter_id", F.regexp_extract("file", STEM, 1))
    rows = ordered.filled_ends(rows, ["chapter_id"], "start", "start", "end")
    rows = rows.withColumn("index", F.row_number().over(Window.partitionBy("chapter_id").orderBy("line")) - 1)
    _written(report.interval_literal(rows, "chapter_id"), out)


def query(spark: SparkSession, name: str, tables: str, out: str) -> None:
    from tidemark.plans import derived, more, queries, registered, stateful  # noqa: F401

    registered.QUERIES[name](spark, tables).write.parquet(out)


JOBS = {f.__name__: f for f in (characters, transcript, labels, query)}


def main(arguments: list[str]) -> int:
    if not arguments or arguments[0] not in JOBS:
        print(__doc__, file=sys.stderr)
        return 2
    job = JOBS[arguments[0]]
    try:
        inspect.signature(job).bind(None, *arguments[1:])
    except TypeError as e:
        print(f"{arguments[0]}: {e}\n\n{__doc__}", file=sys.stderr)
        return 2
    job(SparkSession.builder.getOrCreate(), *arguments[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

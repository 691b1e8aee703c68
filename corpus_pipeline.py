"""From raw documents to token ids: quality rules, exact dedup, near dedup, source mixing and piece encoding.

Each stage is a function of (spark, docs, sf_dir) on the columns of documents (doc_id, text, lang, source, n_chars) and
any others; run() writes each stage's result as Parquet and reads it again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table, written
from tidemark.llm.exact_dedup import drop_copies
from tidemark.llm.jaccard_join import drop_near_copies
from tidemark.llm.mixing import mixture
from tidemark.llm.quality_rules import keep_good
from tidemark.llm.sentence_pieces import encoded


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest doc_id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group that links of five-word shingles at a similarity of 0.8 connect."""
    return drop_near_copies(docs, 5, (80, 100))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixture(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with piece_ids."""
    return encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("piece_ids", piece_ids),
]

#: Near dedup's components and piece encoding have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs

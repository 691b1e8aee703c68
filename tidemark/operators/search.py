"""Full-text search over an inverted index, and passages located in texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions.text import normalise, tokens
from tidemark.sources.shared import new_table

#: Scores of documents for queries that a task holds at once; parts of an index's files by documents, so that a frequent term's rows aren't one task's.
CELLS, SALTS = 1 << 20, 8


def index(docs: DataFrame, doc_id: str, text: str, terms: DataFrame | None = None, section: list[str] = []) -> DataFrame:
    """term, doc_id, the columns of a section and tf. With terms (one row per term), only their postings are built."""
    words = docs.select(doc_id, *section, F.explode(tokens(F.col(text))).alias("term"))
    if terms is not None:
        words = words.join(F.broadcast(terms.select("term")), "term", "left_semi")
    return words.groupBy("term", doc_id, *section).agg(F.count("*").alias("tf"))


def top_documents(postings: DataFrame, queries: DataFrame, n_docs: int, k: int, doc_id: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """The k best documents of each query by the sum of tf * ln(n_docs / df) over its terms, smaller ids first on ties.

    queries: query_id and term, one row per distinct term of a query. The ranking is this library's own choice."""
    postings = new_table(postings.select("term", doc_id, "tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weighted = queries.join(df, "term").select(query_id, "term", F.log(F.lit(float(n_docs)) / F.col("df")).alias("w"))
    kinds = dict(weighted.dtypes) | dict(postings.dtypes)
    best = Best(weighted.select("term", query_id, "w").collect(), to_arrow_type(weighted.schema[query_id].dataType), k)  # the queries' terms
    by_document = postings.repartition(doc_id).sortWithinPartitions(doc_id).select(doc_id, "term", "tf")
    hits = by_document.mapInArrow(best, f"`{query_id}` {kinds[query_id]}, `{doc_id}` {kinds[doc_id]}, score double").withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


class Best:
    """Scores of documents for all queries, from postings that come document by document (id, term, tf).

    A task gives out a score unless k documents that it has seen are above it by more than rounding takes, so ranks are left to Spark."""

    def __init__(self, weights: list[tuple], kind: pa.DataType, k: int):
        weights = sorted(weights, key=lambda r: r[0])
        self.k, self.kind, self.ids = k, kind, list(dict.fromkeys(r[1] for r in weights))
        at = {q: i for i, q in enumerate(self.ids)}
        self.query, self.weight = np.array([at[r[1]] for r in weights], np.int64), np.array([r[2] for r in weights], float)
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(r[0] for r in weights))}
        self.number = np.bincount(np.array([self.terms[r[0]] for r in weights], np.int64), minlength=len(self.terms))
        self.first = np.cumsum(self.number) - self.number

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.top, rest = np.full((self.k, len(self.ids)), -np.inf), None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            begins = self.begins(rows)
            yield from self.scores(rows.slice(0, begins[-1]), begins[:-1])
            rest = rows.slice(begins[-1])  # its last document may go on
        if rest is not None:
            yield from self.scores(rest, self.begins(rest))

    @staticmethod
    def begins(rows: pa.Table) -> np.ndarray:
        """The first row of each document."""
        ids = rows.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))

    def scores(self, rows: pa.Table, begins: np.ndarray):
        step = max(1, CELLS // max(1, len(self.ids)))
        for i in range(0, len(begins), step):
            end = begins[i + step] if i + step < len(begins) else len(rows)
            yield self.scored(rows.slice(begins[i], end - begins[i]), begins[i : i + step] - begins[i])

    def scored(self, rows: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
        coded, tf = rows.column(1).combine_chunks().dictionary_encode(), rows.column(2).to_numpy()
        known = np.array([self.terms.get(t, -1) for t in coded.dictionary.to_pylist()], np.int64)
        term = known[coded.indices.to_numpy(zero_copy_only=False)]
        there = np.flatnonzero(term >= 0)
        term, of = term[there], (np.searchsorted(begins, np.arange(len(rows)), "right") - 1)[there]
        number = self.number[term]
        at = np.repeat(self.first[term] - np.cumsum(number) + number, number) + np.arange(number.sum())
        cell, size = np.repeat(of, number) * len(self.ids) + self.query[at], len(begins) * len(self.ids)
        met = np.bincount(cell, minlength=size) > 0
        score = np.where(met, np.bincount(cell, np.repeat(tf[there], number) * self.weight[at], size), -np.inf).reshape(len(begins), len(self.ids))
        self.top = np.partition(np.concatenate([self.top, score]), len(begins), axis=0)[-self.k :]
        least = self.top.min(axis=0, initial=np.inf)
        doc, query = np.nonzero(met.reshape(score.shape) & (score >= least - 2e-6 - np.abs(least) * 1e-12))
        ids = rows.column(0).combine_chunks().take(pa.array(begins[doc]))
        return pa.RecordBatch.from_arrays([pa.array(self.ids, self.kind).take(pa.array(query)), ids, pa.array(score[doc, query])], names=["query", "doc", "score"])


def located(passages: DataFrame, docs: DataFrame, passage_id: str, doc_id: str, words: int = 5) -> DataFrame:
    """passage_id, doc_id and the 1-based place of each passage in the normalised texts, where it stands as whole words.

    Documents meet a passage by a hash of its first words (that many, or all of a shorter one), so no pair without them
    is formed; the whole passage is then sought. Empty passages are nowhere."""
    p = passages.select(passage_id, normalise(F.col("text")).alias("passage")).filter("passage <> ''").withColumn("_w", F.split("passage", " "))
    p = p.withColumn("_n", F.least(F.size("_w"), F.lit(words)))
    sizes = sorted(r[0] for r in p.select("_n").distinct().collect())  # words at most
    gram = lambda w, i, n: F.xxhash64(F.lit(n), *[F.get(w, i + j) for j in range(n)])
    key = F.coalesce(*[F.when(F.col("_n") == n, gram(F.col("_w"), F.lit(0), n)) for n in sizes], F.lit(0))
    p = p.select(passage_id, "passage", key.alias("_key"))
    d = docs.select(doc_id, normalise(F.col("text")).alias("whole")).withColumn("_w", F.split("whole", " "))

    def grams_of(n: int):
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size("_w") - n, F.lit(0))), lambda i: i + n <= F.size("_w")), lambda i: gram(F.col("_w"), i, n))

    met = d.select(doc_id, F.explode(F.array_distinct(F.concat(F.array().cast("array<bigint>"), *map(grams_of, sizes)))).alias("_key")).join(p, "_key").select(doc_id, passage_id, "passage")
    place = F.instr(F.concat(F.lit(" "), F.col("whole"), F.lit(" ")), F.concat(F.lit(" "), F.col("passage"), F.lit(" ")))
    return met.join(d.select(doc_id, "whole"), doc_id).withColumn("position", place).filter("position > 0").select(passage_id, doc_id, "position")


def sub_results(hits: DataFrame, sections: DataFrame, queries: DataFrame, doc_id: str = "doc_id", query_id: str = "query_id", section: str = "index", text: str = "text") -> DataFrame:
    """The best section of each hit, with its words and the query's marked: most distinct terms, then the first one."""
    terms = queries.groupBy(query_id).agg(F.collect_set("term").alias("_terms"))
    rows = hits.select(query_id, doc_id, "rank").join(terms, query_id).join(sections.select(doc_id, section, text), doc_id)
    words = tokens(F.col(text))
    rows = rows.withColumn("n_terms", F.size(F.array_intersect(words, "_terms"))).filter("n_terms > 0")
    best = F.min(F.struct((-F.col("n_terms")).alias("n"), F.col(section).alias("at"), F.col(text).alias("text"), F.col("_terms").alias("terms"))).alias("_b")
    found = rows.groupBy(query_id, doc_id, "rank").agg(best)
    marked = F.array_join(F.transform(tokens(F.col("_b.text")), lambda w: F.when(F.array_contains("_b.terms", w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)), " ")
    return found.select(query_id, doc_id, "rank", F.col("_b.at").alias(section), (-F.col("_b.n")).alias("n_terms"), marked.alias("excerpt"))


def without_dismissed(hits: DataFrame, dismissed: DataFrame, keys: list[str]) -> DataFrame:
    return hits.join(dismissed.select(*keys), keys, "left_anti")


# An index that is kept

#: Parts of an index by a hash of the term; a search reads those of its terms.
PARTS = 16


def _part(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def add_segment(docs: DataFrame, path: str, segment: int, doc_id: str = "doc_id", text: str = "text", gone: Column | None = None) -> None:
    """Adds documents to the index under a path, or puts them in the place of those with their ids; gone: which of them only leave it.

    A segment holds the places of each term in each of its documents, sorted by term, so that a search reads few row groups; files
    that are there aren't touched. Segments are numbered upwards; one that was written already is an error."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("_w"), (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"))
    live = rows.filter("not gone").select("doc_id", "_w")
    kind = f"term string, doc_id {dict(rows.dtypes)['doc_id']}, tf long, places array<int>"
    again = live.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_again"))
    if again.isEmpty():
        postings = live.mapInArrow(inverted, kind)
    else:  # the rows of an id are one document
        marked = live.join(again, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "_w", "_again")
        both = marked.filter("_again").drop("_again").mapInArrow(inverted, kind).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
        postings = marked.filter("_again is null").drop("_again").mapInArrow(inverted, kind).unionByName(both)
    postings = postings.withColumn("part", _part())
    postings.repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{path}/postings/segment={segment}")
    rows.select("doc_id", "gone", F.coalesce(F.size("_w"), F.lit(0)).alias("n_words")).write.parquet(f"{path}/docs/segment={segment}")


def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, doc_id, tf and places from rows of an id and its words."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        of = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = of * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        key = key[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        ends = np.append(begins, len(key))
        at = order[begins]
        places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32()))
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(coded.indices.take(pa.array(at))), ids.take(pa.array(of[at])), pa.array(np.diff(ends)), places], names=["term", "doc_id", "tf", "places"])


def indexed(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, segment and n_words of the documents in an index, each in the last segment that has it."""
    docs = spark.read.parquet(f"{path}/docs")
    newest = docs.groupBy("doc_id").agg(F.max(F.struct("segment", "gone", "n_words")).alias("_d"))
    return newest.select("doc_id", "_d.segment", "_d.n_words", "_d.gone").filter("not gone").drop("gone")


def kept_postings(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """term, doc_id, tf and places of the terms (one row each) in an index."""
    wanted = [r[0] for r in terms.select(_part()).distinct().collect()]  # PARTS at most
    rows = spark.read.parquet(f"{path}/postings").filter(F.col("part").isin(wanted)).join(F.broadcast(terms.select("term")), "term", "left_semi")
    return rows.join(indexed(spark, path).select("doc_id", "segment"), ["doc_id", "segment"], "left_semi").select("term", "doc_id", "tf", "places")


def phrases(postings: DataFrame, queries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """query_id, doc_id and the places (from 0) at which all terms of a query stand one after the other, by the stored places alone.

    queries: query_id, term and at, its place in the query from 0."""
    size = queries.groupBy(query_id).agg(F.count("*").alias("_size"))
    rows = queries.join(postings, "term").select(query_id, "doc_id", F.transform("places", lambda p: p - F.col("at")).alias("_starts"))
    met = rows.groupBy(query_id, "doc_id").agg(F.collect_list("_starts").alias("_all")).join(size, query_id).filter(F.size("_all") == F.col("_size"))
    starts = F.array_sort(F.aggregate("_all", F.get("_all", F.lit(0)), lambda a, x: F.array_intersect(a, x)))
    return met.select(query_id, "doc_id", starts.alias("places")).filter(F.size("places") > 0)

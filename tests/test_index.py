"""An index that is kept: segments, replaced and removed documents, phrases by places."""

import math
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.operators import search


def test_segments(spark, tmp_path):
    path = str(tmp_path / "i")
    kind = "doc_id int, text string"
    search.add_segment(spark.createDataFrame([(1, "A b a c"), (2, "b c"), (3, None), (4, "gone words")], kind), path, 1)
    search.add_segment(spark.createDataFrame([(2, "b b new"), (5, "c a b")], kind), path, 2)
    search.add_segment(spark.createDataFrame([(4, None)], kind), path, 3, gone=F.lit(True))
    assert {(r.doc_id, r.segment, r.n_words) for r in search.indexed(spark, path).collect()} == {(1, 1, 4), (2, 2, 3), (3, 1, 0), (5, 2, 3)}
    terms = spark.createDataFrame([("a",), ("b",), ("c",), ("gone",), ("never",)], "term string")
    rows = {(r.term, r.doc_id): (r.tf, r.places) for r in search.kept_postings(spark, path, terms).collect()}
    assert rows == {("a", 1): (2, [0, 2]), ("b", 1): (1, [1]), ("c", 1): (1, [3]), ("b", 2): (2, [0, 1]), ("a", 5): (1, [1]), ("b", 5): (1, [2]), ("c", 5): (1, [0])}
    asked = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "b", 0), (2, "b", 1), (3, "c", 0), (3, "never", 1), (4, "c", 0)], "query_id int, term string, at int")
    found = search.phrases(search.kept_postings(spark, path, asked.select("term").distinct()), asked)
    assert {(r.query_id, r.doc_id): r.places for r in found.collect()} == {(1, 1): [0], (1, 5): [1], (2, 2): [0], (4, 1): [3], (4, 5): [0]}
    with pytest.raises(AnalysisException):
        search.add_segment(spark.createDataFrame([(9, "x")], kind), path, 2)


def test_only_the_parts_of_the_terms_are_read(spark, tmp_path):
    path = str(tmp_path / "i")
    search.add_segment(spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" all")).alias("text")), path, 1)
    rows = search.kept_postings(spark, path, spark.createDataFrame([("w7",)], "term string"))
    assert [r.doc_id for r in rows.collect()] == [7]
    files = spark.read.parquet(f"{path}/postings").select("part").distinct().count()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert files > 8 and "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]


def test_best_documents_of_frequent_terms(spark):
    draw = random.Random(4)
    texts = {i: draw.choices("the of a in rare odd word some".split(), k=draw.randrange(30)) for i in range(300)} | {i: ["the", "odd"] for i in range(300, 340)}
    asked = {1: ["the", "rare"], 2: ["the", "of", "odd"], 3: ["never"], 4: ["a"]}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id int, text string").repartition(3)
    queries = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id int, term string")
    df = {t: sum(t in w for w in texts.values()) for ts in asked.values() for t in ts}
    want = set()
    for q, terms in asked.items():
        scores = [(-round(sum(w.count(t) * math.log(len(texts) / df[t]) for t in terms if t in w), 6), i) for i, w in texts.items() if set(terms) & set(w)]
        want |= {(q, i, -s, n) for n, (s, i) in enumerate(sorted(scores)[:3], 1)}
    got = search.top_documents(search.index(docs, "doc_id", "text", queries.select("term").distinct()), queries, len(texts), 3)
    assert {(r.query_id, r.doc_id, r.score, r["rank"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan  # a frequent term's documents aren't one task's


def test_a_frequent_term_is_in_several_files(spark, tmp_path):
    path, merged = str(tmp_path / "i"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, False)  # small partitions would be merged
    search.add_segment(spark.range(400).select(F.col("id").alias("doc_id"), F.lit("the the").alias("text")), path, 1)
    spark.conf.unset(merged)
    rows = spark.read.parquet(f"{path}/postings")
    assert rows.select(F.input_file_name()).distinct().count() > 1 and rows.count() == 400
    assert {tuple(r.places) for r in rows.collect()} == {(0, 1)}


def test_repeated_ids_in_a_segment(spark, tmp_path):
    path = str(tmp_path / "i")
    search.add_segment(spark.createDataFrame([(1, "a b"), (1, "b a a"), (2, "a"), (None, "c"), (None, "c")], "doc_id int, text string"), path, 1)
    rows = {(r.term, r.doc_id): (r.tf, r.places) for r in spark.read.parquet(f"{path}/postings").collect()}
    assert rows == {("a", 1): (3, [0, 1, 2]), ("b", 1): (2, [0, 1]), ("a", 2): (1, [0]), ("c", None): (2, [0, 0])}

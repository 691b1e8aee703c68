"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A source's target is its share of all words by weight, clamped at max_epochs times its own words; the excess is
reshared by weight. Every document of a source is taken whole as often as the target allows; what is missing is taken
in a seeded order, whole documents first, and the last of them in part, so that each source meets its target to
the word.

Defined cases: a null text has no words; a null source is a source of its own, last in order; a null doc_id is
ordered like an empty one; repeated rows are documents of their own; a source without words has target 0; an empty
table gives an empty result; other columns pass through, but for those named size, source_size, target or taken, which
the plan replaces in planned()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, apart, table, texts

MAX_EPOCHS, SEED = 3, 17
#: Rows of a source's bucket, on average, and the least number of buckets.
BUCKET_ROWS, MIN_BUCKETS = 20_000, 1024


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From _null, _source and source_size, one row per source: the weight and the water-filled target.

    Sources are filled in the order of cap over weight; each is clamped if the words left, shared by weight among
    it and those after it, would exceed its cap. The windows run over one row per source."""
    by_name = Window.orderBy("_null", "_source")
    s = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long")).withColumn("_cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "_null", "_source")
    left_words = F.sum("source_size").over(Window.partitionBy()) - (F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap"))
    left_weight = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("_left", left_words).withColumn("_weights", left_weight)
    # clamped while the cap is not above the share: cap * weights <= weight * words left
    s = s.withColumn("_clamped", F.col("_cap") * F.col("_weights") <= F.col("weight") * F.col("_left"))
    free = F.min(F.when(~F.col("_clamped"), F.struct(F.col("_cap") / F.col("weight"), "_null", "_source", "_left", "_weights"))).over(Window.partitionBy())
    level = free["_left"].cast("double") / free["_weights"]
    return s.withColumn("target", F.when(F.col("_clamped"), F.col("_cap").cast("double")).otherwise(F.col("weight") * level)).select("_null", "_source", "source_size", "target")


def planned(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and taken.

    A source's rows are summed by bucket of their draw, so a large source is many tasks; one row per source and bucket is
    what the windows of a source run over."""
    docs, back = apart(docs.drop("size", "source_size", "target", "taken"), "doc_id", "text", "source")
    buckets = max(MIN_BUCKETS, -(-docs.count() // BUCKET_ROWS))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.withColumns({"size": F.regexp_count(texts(docs), F.lit(WORD)).cast("long"), "_null": F.col("source").isNull(), "_source": F.coalesce("source", F.lit("")), "_draw": draw})
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)))
    sums = rows.groupBy("_null", "_source", "_bucket").agg(F.sum("size").alias("_words"))
    before = F.sum("_words").over(Window.partitionBy("_null", "_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.withColumn("_start", F.coalesce(before, F.lit(0)))
    by_source = targets(sums.groupBy("_null", "_source").agg(F.sum("_words").alias("source_size")), max_epochs)
    starts = starts.join(by_source, ["_null", "_source"]).drop("_words")
    in_bucket = Window.partitionBy("_null", "_source", "_bucket").orderBy("_draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_end", F.sum("size").over(in_bucket)).join(starts, ["_null", "_source", "_bucket"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    out = out.withColumn("_whole", whole).withColumn("_extra", F.round("target").cast("long") - F.col("_whole") * F.col("source_size"))
    begin = F.col("_start") + F.col("_end") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_extra") - begin))
    return out.withColumn("taken", F.col("_whole") * F.col("size") + part).select(*back, "size", "source_size", "target", "taken")


def mixture(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed rows: each document as often as it is taken whole, and once more its first words if it is taken in part."""
    inner, back = apart(docs, "doc_id", "text", "source")
    plan = planned(inner, max_epochs, seed)
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    copies = plan.withColumn("_rest", rest).withColumn("_copies", F.concat(F.array_repeat(F.lit(False), whole.cast("int")), F.array_repeat(F.lit(True), (F.col("_rest") > 0).cast("int"))))
    rows = copies.withColumn("_part", F.explode("_copies"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_rest").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("_part"), cut).otherwise(F.col("text")))
    return rows.select(*back)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size AS cap, (sum(source_size) OVER () - sum(3 * source_size) OVER o + 3 * source_size)::BIGINT AS words_left,
             (sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights
      FROM s WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, cap * weights <= weight * words_left AS clamped FROM f),
l AS (SELECT arg_min(words_left::DOUBLE / weights, cap / weight) AS level FROM c WHERE NOT clamped),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE weight * level END AS target FROM c, l),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
             (sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS begins
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - begins)))::BIGINT AS taken FROM p
"""

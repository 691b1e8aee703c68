"""Exact dedup with two-pass Bloom filtering, in DataFrame functions alone.

Pass one sets HASHES bits for each row's digest in a filter that remembers which bits were set twice or more. All bits
of a digest lie in one block of the filter, and blocks belong to ranges of digests, so that the filter of a range is
small enough to be broadcast, however many rows there are. Pass two tests each row against its range's filter: a row
with one bit set only once has no equal, so it passes straight through; the others, repeated rows and a few false
alarms, shuffle by their digest. With several ranges, rows lie sorted by range within each written file, so that a
range's test reads its own rows.

Defined cases: a null text counts as empty, and empty texts equal each other; a null doc_id comes after all others
where ids decide; rows that agree in id, length and digest are documents of their own, of which any one can be the one
that stays; an empty table gives an empty result; other columns of the input are ignored, or left as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, apart, bounded, new_folder, spread_join, table, texts, written

#: Bits of the filter for each row, bits set for each row, words of 64 bits in a block, rows of a range on average.
BITS_PER_ROW, HASHES, BLOCK_WORDS, RANGE_ROWS = 16, 3, 64, 1 << 24
_BLOCK = 64 * BLOCK_WORDS


def digest(docs: DataFrame) -> Column:
    """The SHA-256 of the text without white space."""
    return F.sha2(F.regexp_replace(texts(docs), f"{SPACE}+", "").cast("binary"), 256)


def ranges_of(n: int, range_rows: int = RANGE_ROWS) -> tuple[int, int]:
    """The number of ranges, and of blocks in each, for n rows."""
    ranges = max(1, -(-n // range_rows))
    return ranges, max(4, -(-n * BITS_PER_ROW // (ranges * _BLOCK)))


def placed(rows: DataFrame, sha: str, ranges: int, blocks: int) -> DataFrame:
    """rows with _range and _block of their digest."""
    h = F.xxhash64(sha)
    return rows.withColumns({"_range": F.pmod(h, F.lit(ranges)).cast("int"), "_block": F.pmod(F.shiftrightunsigned(h, 24), F.lit(blocks)).cast("int")})


def bits(sha: str) -> list[Column]:
    """The places of a digest's bits in its block."""
    return [F.pmod(F.xxhash64(sha, F.lit(j)), F.lit(_BLOCK)).cast("int") for j in range(HASHES)]


def repeated_bits(rows: DataFrame, sha: str) -> DataFrame:
    """Pass one: for each block, by _range and _block, its words of the bits that two rows or more set."""
    twice = rows.select("_range", "_block", F.explode(F.array(*bits(sha))).alias("p")).groupBy("_range", "_block", "p").count().filter("count > 1")
    words = twice.groupBy("_range", "_block", F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, p & 63)")).alias("b"))
    by_word = F.map_from_entries(F.collect_list(F.struct("w", "b")))
    block = words.groupBy("_range", "_block").agg(by_word.alias("m"))
    return block.select("_range", "_block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("_words"))


def tested(rows: DataFrame, filter_: DataFrame, sha: str) -> DataFrame:
    """Pass two, for rows of one range: maybe_repeated, false only for rows that have no equal. Nothing shuffles."""
    out = rows.join(F.broadcast(filter_.select(F.col("_block").alias("_at"), "_words")), F.col("_block") == F.col("_at"), "left")
    hit = F.lit(True)
    for p in bits(sha):
        word = F.get("_words", F.shiftright(p, 6))
        hit = hit & (F.call_function("shiftright", word, p.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1)
    return out.withColumn("maybe_repeated", F.coalesce(hit, F.lit(False))).drop("_at", "_words")


def flagged(rows: DataFrame, sha: str, n: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The n rows with maybe_repeated. The filter of a range has 2 bytes a row: 32 MB for RANGE_ROWS."""
    ranges, blocks = ranges_of(n, range_rows)
    rows = placed(rows, sha, ranges, blocks)
    if ranges == 1:
        out = tested(rows, written(repeated_bits(rows, sha)), sha)
    else:
        rows = written(rows.sortWithinPartitions("_range"))
        words = written(repeated_bits(rows, sha).repartition(ranges, "_range").sortWithinPartitions("_range"))
        path = new_folder(rows.sparkSession)
        for r in range(ranges):  # a job for each, so that one filter is out at a time
            of_range = tested(rows.filter(F.col("_range") == r), words.filter(F.col("_range") == r), sha)
            of_range.write.mode("append").parquet(path)
        out = rows.sparkSession.read.schema(of_range.schema).parquet(path)
    return out.drop("_range", "_block")


def numbered_groups(base: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Written rows (_row, doc_id, text_sha256, n_chars) with keep_row, keep_id, group_size and maybe_repeated."""
    n = base.count()
    rows = written(flagged(base, "text_sha256", n, range_rows))
    alone = rows.filter("not maybe_repeated").withColumns({"keep_row": F.col("_row"), "keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    shuffled = rows.filter("maybe_repeated")
    best = F.min(F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("_row").alias("d")))
    groups = shuffled.groupBy("text_sha256").agg(F.count("*").alias("group_size"), best.alias("_best"))
    groups = groups.select("text_sha256", "group_size", F.col("_best.c").alias("keep_id"), F.col("_best.d").alias("keep_row"))
    return alone.unionByName(spread_join(shuffled, groups, "text_sha256", "group_size", n))


def exact_groups(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space. Of equal texts, the row with the most code points stays,
    then the one with the smallest doc_id; of rows alike in these, one."""
    base = docs.select("doc_id", digest(docs).alias("text_sha256"), F.length(texts(docs)).cast("long").alias("n_chars"))
    groups = numbered_groups(written(base.withColumn("_row", F.monotonically_increasing_id())), range_rows)
    return groups.select("doc_id", "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs without the rows that exact_groups drops, whole rows and columns as they are.

    Rows that pass the filter go straight through with their texts; only those that may be repeated meet the list of
    dropped rows. Of rows alike in id, length and digest one is left where one of them stays."""
    inner, back = apart(docs, "doc_id", "text")
    names = inner.columns
    inner = inner.withColumns({"_sha": digest(inner), "_n": F.length(texts(inner)).cast("long"), "_id": F.col("doc_id").cast("string")})
    base = inner.select("doc_id", F.col("_sha").alias("text_sha256"), F.col("_n").alias("n_chars"))
    base = written(base.withColumn("_row", F.monotonically_increasing_id()))
    several = numbered_groups(base, range_rows).filter("group_size > 1")
    kinds = several.groupBy("text_sha256", "n_chars", F.col("doc_id").cast("string").alias("_id")).agg(F.max(F.col("_row") == F.col("keep_row")).alias("_stays"), F.count("*").alias("_copies"))
    kinds = written(kinds.filter("not _stays or _copies > 1").select(F.col("text_sha256").alias("_s"), F.col("n_chars").alias("_m"), F.col("_id").alias("_i"), "_stays"))
    rows = flagged(inner, "_sha", base.count(), range_rows)
    same = (F.col("_sha") == F.col("_s")) & (F.col("_n") == F.col("_m")) & F.col("_id").eqNullSafe(F.col("_i"))
    n_kinds = kinds.count()
    met = rows.filter("maybe_repeated").join(bounded(kinds, n_kinds), same, "left")
    out = rows.filter("not maybe_repeated").select(*names).unionByName(met.filter("_stays is null").select(*names))
    if not kinds.filter("_stays").isEmpty():
        out = out.unionByName(met.filter("_stays").dropDuplicates(["_sha", "_n", "_id"]).select(*names))
    return out.select(*back)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       row_number() OVER w = 1 AS kept, s AS text_sha256
FROM d WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id NULLS LAST)
"""

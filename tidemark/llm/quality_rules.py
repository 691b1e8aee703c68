"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule reads counts of the text. Its cost is measured on a written sample of raw texts, as the time of the rule with
all it counts, less that of the scan; its selectivity is the share of the sample that it rejects. Rules are then put
in the order of rejection per cost, so that a document meets no rule, and none of its counts is taken, after the first
that rejects it. The order changes the cost, never the verdict.

Defined cases: a null text has no words and is rejected like an empty one; an empty table gives an empty result;
other columns pass through keep_good(); judged() puts its own in the place of those of the same names."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, apart, table, texts, written

#: Rows of the sample on which costs and selectivities are estimated, its seed, and how often a rule is timed.
SAMPLE_ROWS, SEED, TIMES = 1000, 17, 2

#: A rule: the counts that it reads, and whether a document with these is rejected.
RULES: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "few_words": (("n_words",), lambda words: words < 10),
    "repeats": (("n_words", "n_repeat_words"), lambda words, repeats: 100 * repeats > 20 * words),
    "symbols": (("n_words", "n_symbols"), lambda words, symbols: 10 * symbols > words),
    "duplicate_lines": (("n_lines", "n_dup_lines"), lambda lines, again: 2 * again > lines),
    "odd_word_length": (("n_words", "word_chars"), lambda words, chars: (chars < 2 * words) | (chars > 20 * words)),
    "shouting": (("n_capitals", "word_chars"), lambda capitals, chars: 2 * capitals > chars),
}


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """df with more columns that are computed once: a generator of one row, into which no later filter is pushed."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def repeat_words(words: Column) -> Column:
    """Number of words in windows of five that occur twice or more among the words."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(5)]))

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        return let(let(by_hash, places), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x))

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(counted)


def words_of(docs: DataFrame) -> Column:
    return F.regexp_extract_all(texts(docs), F.lit(WORD), F.lit(0))


def lines_of(docs: DataFrame) -> Column:
    return F.filter(F.split(texts(docs), "\n"), lambda x: x.rlike(rf"[^\x20\x09-\x0D]"))


def counts(docs: DataFrame, words: Column | None = None, lines: Column | None = None) -> dict[str, Column]:
    """What rules read, each from the text alone; words and lines where they are at hand."""
    text, own = texts(docs), words is not None
    lines = lines_of(docs) if lines is None else lines
    return {
        "n_words": F.size(words) if own else F.regexp_count(text, F.lit(WORD)),
        "word_chars": F.length(F.array_join(words, "")) if own else F.length(F.regexp_replace(text, f"{SPACE}+", "")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_capitals": F.regexp_count(text, F.lit("[A-Z]")),
        "n_lines": F.size(lines),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeat_words(words) if own else let(words_of(docs), repeat_words),
    }


def with_counts(docs: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """docs with all counts, or only some, in the place of columns of the same names."""
    inner, back = apart(docs.drop(*counts(docs)), "text")
    read = once(inner, words_of(inner).alias("_words"), lines_of(inner).alias("_lines"))
    every = {n: c for n, c in counts(read, F.col("_words"), F.col("_lines")).items() if n in only or not only}
    return once(read, *[c.cast("long").alias(n) for n, c in every.items()]).select(*back, *every)


def from_text(docs: DataFrame, rule: tuple, taken: tuple[str, ...] = ()) -> Column:
    """Whether a rule rejects a text, from the text itself: only what the rule reads is counted, each count once; those taken already are columns."""
    names, test = rule
    every = counts(docs)
    read = F.struct(*[(F.col(n) if n in taken else every[n].cast("long")).alias(n) for n in names])
    return F.coalesce(let(read, lambda x: test(*[x[n] for n in names])), F.lit(False))


def from_counts(rule: tuple) -> Column:
    """The same, from columns of with_counts()."""
    names, test = rule
    return F.coalesce(test(*[F.col(n) for n in names]), F.lit(False))


def seconds(rows: DataFrame, tested: Column) -> float:
    """The least time of several that it takes to test the rows; the first one, in which code is compiled, doesn't count."""
    took = []
    for _ in range(TIMES + 1):
        began = time.perf_counter()
        rows.agg(F.count_if(tested)).collect()
        took.append(time.perf_counter() - began)
    return min(took[1:])


def ordered(sample: DataFrame, rules: dict = RULES, taken: tuple[str, ...] = ()) -> list[str]:
    """The rules' names by rejections per second on the sample of raw texts; each next one among the rows that are left.

    taken: counts that the sample has as columns; a rule that reads no other costs nothing and isn't timed."""
    timed = [name for name, (names, _) in rules.items() if not set(names) <= set(taken)]
    scan = seconds(sample, F.octet_length(texts(sample)) < 0) if timed else 0.0
    cost = {name: max(1e-3, seconds(sample, from_text(sample, rule, taken)) - scan) if name in timed else 1e-6 for name, rule in rules.items()}
    seen = sample.groupBy(*[from_text(sample, rule, taken).alias(name) for name, rule in rules.items()]).count().collect()  # 2 ** rules rows at most
    order, left = [], list(seen)
    while len(order) < len(rules):
        best = max((n for n in rules if n not in order), key=lambda n: (sum(r["count"] for r in left if r[n]) / cost[n], -cost[n]))
        order.append(best)
        left = [r for r in left if not r[best]]
    return order


def order_for(docs: DataFrame, rules: dict, sample_rows: int, taken: tuple[str, ...] = ()) -> list[str]:
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select("text").sample(share, SEED)
    return ordered(written(with_counts(sample, taken) if taken else sample), rules, taken)


def cascade(rows: DataFrame, rules: dict, order: list[str], test: Callable[[tuple], Column]) -> DataFrame:
    """rows with rejected_by: the first rule, in that order, which holds; null for documents that stay. Of a CASE, no
    branch after the one that holds is evaluated."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in order:
        out = out.when(test(rules[name]), F.lit(name))
    return rows.withColumn("rejected_by", out)


def judged(docs: DataFrame, rules: dict = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with all their counts, rejected_by and kept: a report, so every count is taken, once, and rules read these."""
    rows = with_counts(docs.drop("rejected_by", "kept"))
    return cascade(rows, rules, order_for(docs, rules, sample_rows), from_counts).withColumn("kept", F.col("rejected_by").isNull())


def reported(docs: DataFrame, names: tuple[str, ...], rules: dict = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the named counts, which every document gets, rejected_by and kept; what else a rule counts is counted only where no rule before it rejects."""
    rows = with_counts(docs.drop("rejected_by", "kept"), names)
    order = order_for(docs, rules, sample_rows, names)
    return cascade(rows, rules, order, lambda rule: from_text(rows, rule, names)).withColumn("kept", F.col("rejected_by").isNull())


def keep_good(docs: DataFrame, rules: dict = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with their own columns; a rejected one meets no rule after the first that does so.

    Rules stand in one filter, which leaves a row at the first condition that fails."""
    inner, back = apart(docs, "text")
    kept = inner
    for name in order_for(inner, rules, sample_rows):
        kept = kept.filter(~from_text(inner, rules[name]))
    return kept.select(*back)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    base_failed = (from_counts(RULES["few_words"]) | from_counts(RULES["repeats"])).alias("base_failed")
    return reported(table(spark, sf_dir, "documents").select("doc_id", "text"), names).select("doc_id", *names, base_failed, "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 6),
grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS c FROM win),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM grams, range(0, 5) t(j) WHERE c > 1 GROUP BY r),
counts AS (SELECT doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l) AS n_lines,
                  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > word_chars) AS kept
FROM counts
"""

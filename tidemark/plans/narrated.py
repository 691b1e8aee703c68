"""Queries that align sentences of conversations with what was said."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import align

from .registered import QUERIES, SQL, query, table
from .stateful import imputed_sql


def _sentences(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter_id"), "turn", F.posexplode(F.filter(F.split("text", r"[.!?\n]+"), lambda x: F.trim(x) != "")).alias("at", "text"))
    return said.select("chapter_id", F.row_number().over(Window.partitionBy("chapter_id").orderBy("turn", "at")).alias("index"), "text")


def _narrated(spark, sf_dir):
    """Sentences of conversations, and their words with times, of which each seventh is lost."""
    turns = _sentences(spark, sf_dir)
    words = turns.select("chapter_id", "index", F.posexplode(text.tokens(F.col("text"))).alias("at", "word"))
    pos = F.row_number().over(Window.partitionBy("chapter_id").orderBy("index", "at"))
    timed = words.withColumn("pos", pos).filter("pos % 7 <> 0").select("chapter_id", "pos", "word", (F.col("pos") * 0.4).alias("start"), (F.col("pos") * 0.4 + 0.3).alias("end"))
    return turns, timed


_SAID = r"""
t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x, ' ') <> '') AS l FROM conversations),
u AS (SELECT conv_id AS chapter_id, turn, unnest(l) AS text, generate_subscripts(l, 1) AS part FROM t),
said AS (SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY turn, part)::INTEGER AS index, text FROM u),
"""
_NORMAL = r"trim(regexp_replace(lower({}), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"
_TOKENS = "list_filter(string_split(" + _NORMAL + ", ' '), lambda w: w <> '')"
_HEARD = _SAID + rf"""
k1 AS (SELECT chapter_id, index, {_TOKENS.format("text")} AS l FROM said),
k2 AS (SELECT chapter_id, index, unnest(l) AS word, generate_subscripts(l, 1) AS part FROM k1),
k3 AS (SELECT chapter_id, index, part, regexp_replace(word, '[^\p{{L}}\p{{M}}\p{{N}}_]', '', 'g') AS word, row_number() OVER (PARTITION BY chapter_id ORDER BY index, part) AS pos FROM k2),
k4 AS (SELECT said.chapter_id, said.index, coalesce(list(word ORDER BY part) FILTER (word <> ''), []) AS w FROM said LEFT JOIN k3 USING (chapter_id, index) GROUP BY ALL),
h AS (SELECT chapter_id, list(word ORDER BY pos) AS words, string_agg(word, ' ' ORDER BY pos) AS text, list(pos * 0.4::DOUBLE ORDER BY pos) AS s, list(pos * 0.4::DOUBLE + 0.3::DOUBLE ORDER BY pos) AS e FROM k3 WHERE word <> '' AND pos % 7 <> 0 GROUP BY chapter_id),
"""


def _placed_sql(parts: str, texts: str) -> str:
    """p(chapter_id, index, first, last): sentence by sentence, from the cursor; parts has whole, start and tail, texts has text."""
    return f"""
parts AS ({parts}), texts AS ({texts}),
p AS (SELECT DISTINCT chapter_id, 0 AS index, NULL::BIGINT AS first, NULL::BIGINT AS last, 1::BIGINT AS cur FROM parts
      UNION ALL SELECT chapter_id, index, first, last, CASE WHEN last IS NULL THEN cur ELSE last + 1 END FROM (
        SELECT chapter_id, index, cur, CASE WHEN f > 0 THEN cur + f - 1 WHEN g > 0 THEN cur + g - 1 END AS first,
               CASE WHEN f > 0 THEN cur + f - 2 + length(whole) WHEN g > 0 AND i > 0 THEN cur + g - 1 + length(start) + i - 2 + length(tail) WHEN g > 0 THEN least(length(text), cur + g - 2 + length(whole)) END AS last
        FROM (SELECT *, CASE WHEN tail <> '' AND g > 0 THEN instr(substr(text, cur + g - 1 + length(start)), tail) ELSE 0 END AS i
              FROM (SELECT q.*, CASE WHEN whole <> '' THEN instr(substr(text, cur), whole) ELSE 0 END AS f, CASE WHEN start <> '' THEN instr(substr(text, cur), start) ELSE 0 END AS g
                    FROM (SELECT parts.*, coalesce(texts.text, '') AS text, p.cur FROM p JOIN parts ON parts.chapter_id = p.chapter_id AND parts.index = p.index + 1 LEFT JOIN texts ON texts.chapter_id = parts.chapter_id) q)))),
"""


_RUN = """SELECT chapter_id, index, first IS NOT NULL AS found, round(s[first], 3) AS s, round(e[last], 3) AS e, n_words AS words, count(first) OVER (PARTITION BY chapter_id ORDER BY index) AS run FROM spans"""
_COUNT = "(length(substr(text, 1, {0} - 1)) - length(replace(substr(text, 1, {0} - 1), ' ', '')) + 1)"


def _exact_sql(prefix: int) -> str:
    parts = f"SELECT chapter_id, index, len(w) AS n_words, array_to_string(w, ' ') AS whole, array_to_string(w[1:{prefix}], ' ') AS start, array_to_string(w[greatest(len(w) - 2, 1):], ' ') AS tail FROM k4"
    spans = f"spans AS (SELECT p.chapter_id, p.index, {_COUNT.format('first')} AS first, {_COUNT.format('last')} AS last, n_words, s, e FROM p JOIN parts USING (chapter_id, index) LEFT JOIN h USING (chapter_id)),"
    return imputed_sql("3.0::DOUBLE", False, _HEARD + _placed_sql(parts, "SELECT chapter_id, text FROM h") + spans, _RUN, "chapter_id", "index")


#: Word by word: m matched words of sentence at, j the next word, cur behind the last whole match; done ends a sentence.
_WALK = """
walk AS (SELECT DISTINCT chapter_id, 1 AS index, 0 AS m, 1 AS j, NULL::INTEGER AS first, NULL::INTEGER AS last, 1 AS cur, false AS done FROM k4
  UNION ALL SELECT chapter_id, CASE WHEN done THEN index + 1 ELSE index END,
    CASE WHEN done OR here AND NOT same AND m IN (1, 2) THEN 0 WHEN same THEN m + 1 ELSE m END,
    CASE WHEN done THEN greatest(1, next_cur - 5) WHEN here THEN j + 1 ELSE j END,
    CASE WHEN done OR here AND NOT same AND m IN (1, 2) THEN NULL WHEN same THEN coalesce(first, j) ELSE first END,
    CASE WHEN done THEN NULL WHEN same THEN j ELSE last END, CASE WHEN done THEN next_cur ELSE cur END,
    CASE WHEN done THEN false ELSE NOT here END
  FROM (SELECT *, here AND (starts_with(word, wanted) OR starts_with(wanted, word)) AS same, CASE WHEN m = size AND m > 0 THEN last + 1 ELSE cur END AS next_cur
        FROM (SELECT walk.*, len(w) AS size, NOT done AND m < len(w) AND j <= coalesce(len(words), 0) AS here, words[j] AS word, w[m + 1] AS wanted
              FROM walk JOIN k4 ON k4.chapter_id = walk.chapter_id AND k4.index = walk.index LEFT JOIN h ON h.chapter_id = walk.chapter_id))
),
"""
_IN_ORDER = _HEARD + _WALK + "spans AS (SELECT walk.chapter_id, walk.index, first, CASE WHEN first IS NOT NULL THEN last END AS last, len(w) AS n_words, s, e FROM walk JOIN k4 USING (chapter_id, index) LEFT JOIN h USING (chapter_id) WHERE done),"


def _aligned(strategy):
    def run(spark, sf_dir):
        return align.aligned(*_narrated(spark, sf_dir), strategy)

    return run


for _strategy in align.STRATEGIES:
    QUERIES[f"align_{_strategy}"] = _aligned(_strategy)
SQL["align_exact_prefix5"], SQL["align_exact_prefix4"] = _exact_sql(5), _exact_sql(4)
SQL["align_subsequence"] = imputed_sql("w.e / w.n", False, _IN_ORDER, _RUN, "chapter_id", "index")


@query("WITH RECURSIVE " + _SAID + _placed_sql(
    rf"SELECT chapter_id, index, {_NORMAL.format('text')} AS whole, array_to_string(l[1:5], ' ') AS start, array_to_string(l[greatest(len(l) - 2, 1):], ' ') AS tail FROM (SELECT *, regexp_extract_all({_NORMAL.format('text')}, '[\p{{L}}\p{{M}}\p{{N}}_]+') AS l FROM said)",
    f"SELECT chapter_id, {_NORMAL.format('text')} AS text FROM (SELECT conv_id AS chapter_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE turn % 4 <> 3 GROUP BY conv_id)",
) + "z AS (SELECT 1) SELECT chapter_id, index, first::INTEGER AS first, last::INTEGER AS last FROM p WHERE index > 0")
def placed_sentences(spark, sf_dir):
    """Where each sentence of a conversation stands in the text of its turns, of which each fourth is lost."""
    kept = table(spark, sf_dir, "conversations").filter("turn % 4 <> 3").groupBy(F.col("conv_id").alias("chapter_id"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return align.placed(_sentences(spark, sf_dir), kept.agg(whole.alias("text")))

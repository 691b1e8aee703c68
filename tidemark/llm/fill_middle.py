"""Fill-in-middle transformation by counted quantifiers.

A text is a sequence of units (runs of letters, or single other characters). regexp_count gives their number n; a
pattern made for the row takes the first a units as `unit{a}+`, the next b - a as `unit{b-a}+` and the rest, all in one
match, which the row's replacement puts in the order of its form. The quantifiers are possessive: no unit is ever tried
again, and Java's matcher then loops instead of recursing, so texts of any length need no deep stack. All of it is built-in functions.

Forms: psm is `<P>`prefix`<S>`suffix`<M>`middle, spm is `<S>`suffix`<P>`prefix`<M>`middle, plain is the text. Cuts and forms
are drawn from the sha256 of a seed and the row's id, so reruns agree.

Defined cases: null and empty texts are plain and empty, with n = 0; a null id is drawn like an empty one; rows that
share an id share draws, on texts of their own; a text that holds one of the three marks is plain; an empty table gives an empty result;
columns of the input with clashing names pass through, but one with the name of a new column is replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, table, texts

#: A unit of the text, and the marks (fixed values).
UNIT = "[A-Za-z]++|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four numbers below 2 ** 32 for an id."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(name, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, seed: int = 1, plain: int = 90, spm: int = 20, new: tuple[str, ...] = ("n", "form", "output")) -> DataFrame:
    """docs with the number of units, the form and the output, under the names in new.

    plain: percentage from which on the third draw leaves a text plain; spm: that of the others below which the fourth one makes an spm."""
    rows, back = apart(docs.drop(*new), "doc_id", "text")
    h1, h2, h3, h4 = draws(seed, F.col("doc_id"))
    rows = rows.select("*", texts(docs).alias("_text")).withColumn("_n", F.regexp_count("_text", F.lit(UNIT)).cast("long"))
    x, y = F.pmod(h1, F.col("_n") + 1), F.pmod(h2, F.col("_n") + 1)
    marked = F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE)
    form = F.when((F.col("_n") == 0) | marked | (F.pmod(h3, F.lit(100)) >= plain), "plain").when(F.pmod(h4, F.lit(100)) < spm, "spm").otherwise("psm")
    rows = rows.select("*", F.least(x, y).alias("_a"), F.abs(x - y).alias("_m"), form.alias("_form"))
    pattern = F.format_string(rf"(?s)\A((?:{UNIT}){{%d}}+)((?:{UNIT}){{%d}}+)(.*)\z", "_a", "_m")
    order = F.when(F.col("_form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(F.col("_form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, order))
    return rows.select(*back, F.col("_n").alias(new[0]), F.col("_form").alias(new[1]), output.alias(new[2]))


def opened(rows: DataFrame, output: str = "output", form: str = "form", new: tuple[str, str, str, str] = ("prefix", "middle", "suffix", "restored")) -> DataFrame:
    """rows with the parts of their outputs (null where the form is plain) and the texts these were made from.

    No mark can arise where a text is cut, as none begins within another; so outputs are cut at their marks."""
    rest = [f"`{c}`" for c in rows.columns if c not in new]
    rows, back = apart(rows.select(*rest), output, form)
    rows = rows.withColumn("_cut", F.split(output, "<[PSM]>", -1))
    cut, psm = F.col("_cut"), F.col(form) == "psm"
    found = [F.when(F.col(form) != "plain", c) for c in (F.when(psm, cut[1]).otherwise(cut[2]), cut[3], F.when(psm, cut[2]).otherwise(cut[1]))]
    rows = rows.select("*", *[c.alias(f"_part_{i}") for i, c in enumerate(found)])
    whole = F.when(F.col(form) == "plain", F.col(output)).otherwise(F.concat("_part_0", "_part_1", "_part_2"))
    return rows.select(*back, *[F.col(f"_part_{i}").alias(new[i]) for i in range(3)], whole.alias(new[3]))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = opened(transformed(table(spark, sf_dir, "documents").select("doc_id", "text")))
    chars = lambda c: F.char_length(c).cast("long").alias(f"{c}_chars")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return rows.select("doc_id", "n", "form", chars("prefix"), chars("middle"), sha("output"), sha("restored"))


SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s
  FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""

"""Readers with fixed schemas. Positions are columns: rows of a DataFrame have no order of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHARACTERS = "characters array<string>, character_start_times_seconds array<double>, character_end_times_seconds array<double>"
TRANSCRIPT = "segments array<struct<words: array<struct<word: string, start: double, end: double>>>>"
INTERVALS = "array<struct<index: int, start: double, end: double>>"


def lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, index from 0 and text of each line; lines are trimmed, blank ones dropped before they are numbered."""
    rows = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")), lambda x: x != "")
    return df.select(*keys, F.posexplode(rows).alias("index", "text"))


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """chapter_id (the file's name without .txt), index and text of one sentence per line."""
    files = spark.read.text(path, wholetext=True).withColumn("chapter_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1))
    return lines(files, "value", ["chapter_id"])


def read_indexed_sentences(spark: SparkSession, path: str) -> DataFrame:
    """index and text of lines "index|text"; other lines are dropped."""
    p = r"^\s*([0-9]+)\|(.*)$"
    rows = spark.read.text(path).filter(F.col("value").rlike(p))
    return rows.select(F.regexp_extract("value", p, 1).cast("int").alias("index"), F.trim(F.regexp_extract("value", p, 2)).alias("text"))


def narration(text: Column) -> Column:
    """What follows the first rule of twelve equal signs, else the whole text."""
    parts = F.split(text, "============")
    return F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), text))


def characters(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, character, start and end; nothing where an array is missing or empty."""
    three = [F.col(c) for c in ("characters", "character_start_times_seconds", "character_end_times_seconds")]
    full = df.filter(" and ".join(f"size({c}) > 0" for c in ("characters", "character_start_times_seconds", "character_end_times_seconds")))
    return full.select(*keys, F.posexplode(F.arrays_zip(*three)).alias("pos", "_z")).select(*keys, "pos", F.col("_z.characters").alias("character"), F.col("_z.character_start_times_seconds").alias("start"), F.col("_z.character_end_times_seconds").alias("end"))


def transcript_words(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos (across segments), word, start and end; segments without words are skipped."""
    words = F.flatten(F.transform("segments", lambda s: F.coalesce(s["words"], F.array().cast("array<struct<word: string, start: double, end: double>>"))))
    return df.select(*keys, F.posexplode(words).alias("pos", "_w")).select(*keys, "pos", "_w.*")


def intervals(df: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """keys, index, start and end from JSON that is a list of intervals or a map of index to start.

    In a list the last of equal indices wins; in a map the next start is the end."""
    as_list, as_map = F.from_json(json, INTERVALS), F.from_json(json, "map<string, double>")
    is_list = F.trim(F.col(json)).startswith("[")
    a = df.filter(is_list).select(*keys, F.posexplode(as_list).alias("_pos", "_x"))
    a = a.groupBy(*keys, F.col("_x.index").alias("index")).agg(F.max_by(F.col("_x.start"), "_pos").alias("start"), F.max_by(F.col("_x.end"), "_pos").alias("end"))
    b = df.filter(~is_list).select(*keys, F.explode(as_map).alias("_k", "start")).withColumn("index", F.col("_k").try_cast("int"))
    b = b.withColumn("end", F.lead("start").over(Window.partitionBy(*keys).orderBy("index")))
    return a.select(*keys, "index", "start", "end").unionByName(b.select(*keys, "index", "start", "end"))


def unwrapped(body: Column, row: str) -> Column:
    """The rows of a JSON body: an array, or an object with results; else none. row: the struct's type."""
    return F.coalesce(F.when(F.trim(body).startswith("["), F.from_json(body, f"array<{row}>")), F.from_json(body, f"results array<{row}>")["results"], F.array().cast(f"array<{row}>"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """file, line, start, end and label of tab-separated label tracks; fill ends with ordered.filled_ends()."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "_l"))
    cell = lambda i: F.try_element_at(F.split("_l", "\t"), F.lit(i))
    return files.filter("trim(_l) <> ''").select("file", "line", cell(1).try_cast("double").alias("start"), cell(2).try_cast("double").alias("end"), cell(3).alias("label"))


def with_defaults(pages: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Directory defaults under the pages' own values; pages marked as excluded go."""
    kept = pages.filter(~F.coalesce(F.col("excluded"), F.lit(False))) if "excluded" in pages.columns else pages
    return kept.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in pages.columns else F.lit(v) for c, v in defaults.items()})


def named_files(spark: SparkSession, path: str, name: str = r"([^/]+?)(?:\.[a-z]+)?$") -> DataFrame:
    """name and value of whole text files; name: a pattern whose first group is taken from a file's path, its name without its ending if not given."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), name, 1).alias("name"), "value")


def read_globals(spark: SparkSession, path: str, name: str = r"([^/]+?)(?:\.[a-z]+)?$") -> DataFrame:
    """name and data of JSON files that hold data for all pages; data is a variant, null where a file is no JSON.

    Parts are read by paths, as F.variant_get("data", "$.a.b[0]", "string"); each row is small, and there are few."""
    return named_files(spark, path, name).select("name", F.try_parse_json("value").alias("data"))


_LINE = r"^( *)([^:#\s][^:]*?)\s*:(?:\s+(.*?))?\s*$"
_ITEM = r"^( *)-\s+(.*?)\s*$"


def front_matter(text: Column) -> Column:
    """What a page says in front of its text, between two lines of three hyphens: an array of (key, value) in order, keys of nested ones
    joined by dots; an item of a list has its list's key. Quotes around values are taken off. null where there is nothing in front."""
    head = F.regexp_extract(text, r"(?s)\A(?:﻿)?---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\z)", 1)
    there = text.rlike(r"(?s)\A(?:﻿)?---[ \t]*\r?\n(.*?\n)?---[ \t]*(?:\r?\n|\z)")
    start = F.struct(F.array().cast("array<struct<depth: int, key: string>>").alias("open"), F.array().cast("array<struct<key: string, value: string>>").alias("out"))

    def value(raw: Column) -> Column:
        quoted = F.regexp_extract(raw, r"^(?:\"(.*)\"|'(.*)')$", 1)
        return F.when(raw.rlike(r"^\".*\"$"), quoted).when(raw.rlike(r"^'.*'$"), F.regexp_extract(raw, r"^'(.*)'$", 1)).otherwise(raw)

    def step(acc: Column, line: Column) -> Column:
        depth = F.length(F.regexp_extract(line, r"^( *)", 1))
        is_item, is_key = line.rlike(_ITEM), line.rlike(_LINE)
        above = F.filter(acc["open"], lambda o: F.when(is_item, o["depth"] <= depth).otherwise(o["depth"] < depth))
        key, raw = F.regexp_extract(line, _LINE, 2), F.when(is_item, F.regexp_extract(line, _ITEM, 2)).otherwise(F.regexp_extract(line, _LINE, 3))
        path = F.array_join(F.transform(above, lambda o: o["key"]), ".")
        path = F.when(is_item, path).when(path == "", key).otherwise(F.concat(path, F.lit("."), key))
        given = F.array(F.struct(path.alias("key"), value(raw).alias("value"))).cast("array<struct<key: string, value: string>>")
        out = F.when(raw != "", F.concat(acc["out"], given)).otherwise(acc["out"])
        open_ = F.when(is_item, above).otherwise(F.concat(above, F.array(F.struct(depth.alias("depth"), key.alias("key")))))
        skip = ~is_item & ~is_key | line.rlike(r"^\s*#")
        return F.struct(F.when(skip, acc["open"]).otherwise(open_).alias("open"), F.when(skip, acc["out"]).otherwise(out).alias("out"))

    return F.when(there, F.aggregate(F.split(head, r"\r?\n"), start, step)["out"])


def page_text(text: Column) -> Column:
    """A page without what stands in front of it."""
    return F.regexp_replace(text, r"(?s)\A(?:﻿)?---[ \t]*\r?\n(.*?\n)?---[ \t]*(?:\r?\n|\z)", "")

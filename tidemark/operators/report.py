"""Summaries and text reports of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import present


def summary(df: DataFrame, keys: list[str], kind: str, time: str) -> DataFrame:
    """n, distinct kinds (null is one) and the latest time of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.col(kind).cast("string"), F.lit("<null>"))).alias("n_kinds"), F.max(time).alias("latest"))


def by_group(df: DataFrame, group: str, time: str) -> DataFrame:
    """n and the latest time of each group; null and empty groups are one, unknown."""
    return df.groupBy(F.coalesce(present(F.col(group)), F.lit("unknown")).alias(group)).agg(F.count("*").alias("n"), F.max(time).alias("latest"))


def report(df: DataFrame, group: str, order: list[str], line: Column, width: int = 30) -> DataFrame:
    """One text per group: a heading, a rule and its lines in order. Groups are what a reader exports, so they are small."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n")
    return df.groupBy(group).agg(F.concat(F.col(group), F.lit("\n"), F.repeat(F.lit("-"), F.lit(width)), F.lit("\n"), body).alias("report"))


def interval_json(df: DataFrame, chapter: str) -> DataFrame:
    """One JSON array of index, start and end per chapter, in order."""
    rows = F.array_sort(F.collect_list(F.struct("index", "start", "end")))
    return df.groupBy(chapter).agg(F.to_json(rows).alias("json"))


def interval_literal(df: DataFrame, chapter: str) -> DataFrame:
    """The same as lines of a script literal."""
    rows = F.array_sort(F.collect_list(F.struct("index", "start", "end")))
    line = lambda x: F.concat(F.lit("{ index: "), x["index"].cast("string"), F.lit(", start: "), x["start"].cast("string"), F.lit(", end: "), x["end"].cast("string"), F.lit(" },"))
    return df.groupBy(chapter).agg(F.array_join(F.transform(rows, line), "\n").alias("literal"))


def with_dimension(df: DataFrame, dimension: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """df with the dimension's columns by key; where the key isn't there, the computed ones. Spark broadcasts the dimension
    if its size is known to be small."""
    hit = df.join(dimension, key, "left")
    return hit.withColumns({c: F.coalesce(F.col(c), fallback) for c, fallback in columns.items()})


def export(entries: DataFrame, goals: DataFrame, user: str, made: Column) -> DataFrame:
    """One text per user: a header, the entries under their headings, and the goals with their states.

    entries: user, heading, at and content; goals: user, text, status and created. Sections come in the order of their
    headings, entries by time, goals newest first. One user's export is small."""
    line = F.concat(F.date_format("at", "MMM d, yyyy"), F.lit(": "), F.col("content"))
    sections = entries.groupBy(user, "heading").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("_line")))), lambda x: x["_line"]), "\n").alias("lines"))
    block = F.concat(F.col("heading"), F.lit("\n" + "-" * 30 + "\n"), F.col("lines"))
    texts = sections.groupBy(user).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("heading", block.alias("_b")))), lambda x: x["_b"]), "\n\n").alias("body"))
    state = F.concat(F.when(F.col("status") == "completed", "[COMPLETED] ").otherwise("[ACTIVE] "), F.col("text"))
    listed = goals.groupBy(user).agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("created", state.alias("_s"))))), lambda x: x["_s"]), "\n").alias("goals"))
    header = F.concat(F.lit("MY ENTRIES\nExported "), F.date_format(made, "MMMM d, yyyy"), F.lit("\n" + "=" * 50 + "\n"))
    goals_part = F.when(F.col("goals").isNotNull(), F.concat(F.lit("\n\nGOALS\n" + "-" * 30 + "\n"), F.col("goals"))).otherwise("")
    return texts.join(listed, user, "full").select(user, F.concat(header, F.coalesce("body", F.lit("")), goals_part).alias("report"))

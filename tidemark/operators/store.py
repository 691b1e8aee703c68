"""Keyed entries: upsert by identity, merges of two copies, deletes, updates, migration of older layouts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import first_of

ENTRY = "struct<id: string, type: string, chapterId: string, chapterTitle: string, promptLabel: string, content: string, timestamp: string, meta: struct<cardId: string, tier: string, confidence: int, pathway: string, step: string>>"


def identity(*extra: Column) -> Column:
    """What makes two entries the same: type, prompt and the three optional fields of meta, missing ones as empty."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(F.col("type"), F.col("promptLabel"), *[part(F.col(f"meta.{m}")).alias(m) for m in ("pathway", "step", "cardId")], *extra)


def upserted(base: DataFrame, updates: DataFrame, keys: list[str], order: list[str], id_col: str, values: list[str]) -> DataFrame:
    """One row per key: the values of the last row of both tables, the id of the first one of base, else of updates."""
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    row = F.struct("_new", *order, *[c for c in (id_col, *values) if c not in order])
    out = both.groupBy(*keys).agg(F.max(row).alias("_last"), F.min(row).alias("_first"))
    return out.select(*keys, F.col(f"_first.{id_col}").alias(id_col), *[F.col(f"_last.{v}").alias(v) for v in values])


def newest_wins(local: DataFrame, remote: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Full outer merge: the remote row replaces the local one if there is none, or if it is strictly newer."""
    side = lambda df, n: df.select(*keys, F.struct(time, *values).alias(n))
    both = side(local, "_l").join(side(remote, "_r"), keys, "full_outer")
    take = F.col("_l").isNull() | F.coalesce(F.col(f"_r.{time}") > F.col(f"_l.{time}"), F.lit(False))
    return both.select(*keys, F.when(take, F.col("_r")).otherwise(F.col("_l")).alias("_x"), F.when(take, "remote").otherwise("local").alias("origin")).select(*keys, "_x.*", "origin")


def merged_progress(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Field by field: the greater position with its sentence (local on a tie), the local bookmark if there is one."""
    fields = ("position", "sentence", "bookmark")
    side = lambda df, n: df.select(*keys, F.struct(*fields).alias(n))
    both = side(local, "l").join(side(remote, "r"), keys, "full_outer")
    further = F.col("l").isNull() | (F.coalesce(F.col("r.position"), F.lit(-1)) > F.coalesce(F.col("l.position"), F.lit(-1)))
    return both.select(*keys, *[F.when(further, F.col(f"r.{f}")).otherwise(F.col(f"l.{f}")).alias(f) for f in fields[:2]], F.coalesce(F.nullif(F.col("l.bookmark"), F.lit("")), F.col("r.bookmark")).alias("bookmark"))


def deleted(df: DataFrame, key: str, value) -> DataFrame:
    """df without the rows of that value; rows with a null key stay."""
    return df.filter(~F.col(key).eqNullSafe(F.lit(value)))


def with_confidence(df: DataFrame, value: int) -> DataFrame:
    """All commitments with that confidence in their meta."""
    return df.withColumn("meta", F.when(F.col("type") == "commitment", F.col("meta").withField("confidence", F.lit(value))).otherwise(F.col("meta")))


def toggled(df: DataFrame, chosen: Column, now: Column, status: str = "status", done_at: str = "completedAt") -> DataFrame:
    """Chosen rows change between active and completed; the time of completion is set or cleared."""
    done = F.col(status) == "completed"
    at = F.when(chosen & ~done, now).when(chosen & done, F.lit(None)).otherwise(F.col(done_at))
    state = F.when(chosen, F.when(done, "active").otherwise("completed")).otherwise(F.col(status))
    return df.withColumns({done_at: at, status: state})


def migrated(buckets: DataFrame, prefix: str) -> DataFrame:
    """Entries from key and value rows of numbered reflections: keys <prefix><chapter>-<1..3>, values objects.

    An object's own chapter_slug and title are preferred to the key's. Values that don't parse, or have no content, are
    dropped; arrays under unified keys are no objects and stay out."""
    p = rf"^{re.escape(prefix)}(.+)-([123])$"
    rows = buckets.filter(F.col("key").rlike(p)).withColumn("_v", F.from_json("value", "content string, timestamp string, chapter_slug string, title string"))
    rows = rows.filter((F.col("_v.content") != "") & F.col("_v.content").isNotNull())
    chapter, number = F.regexp_extract("key", p, 1), F.regexp_extract("key", p, 2)
    prompt = first_of(F.col("_v.title"), F.concat(F.lit("Prompt "), number))
    return rows.select(F.sha2("key", 256).alias("id"), F.lit("reflection").alias("type"), first_of(F.col("_v.chapter_slug"), chapter).alias("chapterId"), prompt.alias("promptLabel"), F.col("_v.content").alias("content"), F.col("_v.timestamp").alias("timestamp"))


def migrated_steps(buckets: DataFrame, prefix: str, chapter: str, paths: list[str], steps: list[str]) -> DataFrame:
    """Entries from keys <prefix><path>_<step>, plain texts of a chapter whose questions are those paths by those steps."""
    p = rf"^{re.escape(prefix)}({'|'.join(map(re.escape, paths))})_({'|'.join(map(re.escape, steps))})$"
    rows = buckets.filter(F.col("key").rlike(p) & (F.trim("value") != ""))
    path, step = F.regexp_extract("key", p, 1), F.regexp_extract("key", p, 2)
    return rows.select(F.sha2("key", 256).alias("id"), F.lit("reflection").alias("type"), F.lit(chapter).alias("chapterId"), F.concat(path, F.lit(" – "), step).alias("promptLabel"), F.col("value").alias("content"), F.lit(None).cast("string").alias("timestamp"), path.alias("pathway"), step.alias("step"))


def migrated_cards(buckets: DataFrame, prefix: str) -> DataFrame:
    """Entries from keys <prefix><chapter>, objects of cards: a commitment for each card, and a reflection where one is attached."""
    p = rf"^{re.escape(prefix)}(.+)$"
    card = "map<string, struct<commitment: string, tier: string, confidence: int, reflection: string, timestamp: string>>"
    rows = buckets.filter(F.col("key").rlike(p)).select(F.regexp_extract("key", p, 1).alias("chapterId"), F.explode(F.map_entries(F.from_json("value", card))).alias("_e"))
    rows = rows.select("chapterId", F.col("_e.key").alias("cardId"), "_e.value.*")
    parts = F.array(F.struct(F.lit("commitment").alias("type"), F.col("commitment").alias("content")), F.struct(F.lit("reflection").alias("type"), F.col("reflection").alias("content")))
    out = rows.select("chapterId", "cardId", "tier", "confidence", "timestamp", F.inline(F.filter(parts, lambda x: F.coalesce(x["content"] != "", F.lit(False)))))
    return out.select(F.sha2(F.concat_ws("|", "chapterId", "cardId", "type"), 256).alias("id"), "type", "chapterId", "cardId", "content", F.when(F.col("type") == "commitment", F.col("tier")).alias("tier"), F.when(F.col("type") == "commitment", F.col("confidence")).alias("confidence"), "timestamp")


def migration(buckets: DataFrame, numbered: str, chapter: str, stepwise: str, paths: list[str], steps: list[str], cards: str, unified: str = "entry/") -> DataFrame:
    """The changes (key, value, gone) that bring key and value rows of three older layouts into one: an entry under <unified><id> for each of
    migrated(), migrated_steps() and migrated_cards(), and the end of each key that gave its entries. Keys whose values can't be read stay."""
    first, second, third = migrated(buckets, numbered), migrated_steps(buckets, stepwise, chapter, paths, steps), migrated_cards(buckets, cards)
    new = first.unionByName(second, True).unionByName(third, True)
    new = new.select(F.concat(F.lit(unified), "id").alias("key"), F.to_json(F.struct(*new.columns)).alias("value"), F.lit(False).alias("gone"))
    whole = F.col("key").startswith(cards) & F.from_json("value", "map<string, string>").isNotNull()
    old = buckets.join(first.unionByName(second, True).select("id").distinct(), F.sha2("key", 256) == F.col("id"), "left_semi").unionByName(buckets.filter(whole)).distinct()
    return new.unionByName(old.select("key", "value", F.lit(True).alias("gone")))


def for_service(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """Entries as a service takes them: the numbered prompt's title (by chapterId and promptLabel, else the label itself), the
    chapter's slug and the content. Every entry with content goes, whether a title is known or not."""
    hit = entries.filter("content is not null and content <> ''").join(titles.select("chapterId", "promptLabel", F.col("title").alias("_title")), ["chapterId", "promptLabel"], "left")
    return hit.select("id", F.coalesce("_title", "promptLabel").alias("title"), F.col("chapterId").alias("chapter_slug"), "content")


def routed(changes: DataFrame, known: DataFrame, key: str, gone: Column) -> DataFrame:
    """changes with what a sink does with them: delete or patch where the key is known, post where it isn't, skip a
    delete of an unknown one."""
    hit = changes.join(known.select(key, F.lit(True).alias("_known")), key, "left")
    there, away = F.col("_known").isNotNull(), F.coalesce(gone, F.lit(False))
    return hit.withColumn("action", F.when(away & there, "delete").when(away, "skip").when(there, "patch").otherwise("post")).drop("_known")


def applied(base: DataFrame, changes: DataFrame, key: str, values: list[str]) -> DataFrame:
    """base after routed changes, one per key: new rows, patched fields (null leaves a field as it is), deleted rows gone."""
    both = base.select(key, F.struct(*values).alias("_b")).join(changes.filter("action <> 'skip'").select(key, "action", F.struct(*values).alias("_c")), key, "full")
    both = both.filter(~F.col("action").eqNullSafe(F.lit("delete")))
    return both.select(key, *[F.coalesce(F.col(f"_c.{v}"), F.col(f"_b.{v}")).alias(v) for v in values])


def spread(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Both sides' rows, field by field: the right one's value if it has one, else the left one's."""
    both = left.select(*keys, F.struct(*values).alias("_l")).join(right.select(*keys, F.struct(*values).alias("_r")), keys, "full")
    return both.select(*keys, *[F.coalesce(F.col(f"_r.{v}"), F.col(f"_l.{v}")).alias(v) for v in values])


def sent(rows: DataFrame, status: Column) -> DataFrame:
    """Rows with the outcome of sending them: delivered (2xx), rejected (400, for good), else kept for a replay."""
    return rows.withColumn("outcome", F.when(status.between(200, 299), "delivered").when(status == 400, "rejected").otherwise("kept"))


def replay(outcomes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What a replay sends: of each key the last row kept, unless a later one of it was delivered."""
    last = F.struct(*order, *[c for c in outcomes.columns if c not in (key, *order)])
    newest = outcomes.filter("outcome <> 'rejected'").groupBy(key).agg(F.max(last).alias("_last")).select(key, "_last.*")
    return newest.filter("outcome = 'kept'").select(*outcomes.columns)


def by_id(df: DataFrame, id_col: str, value, order: list[str]) -> DataFrame:
    """The first row of that id by an order."""
    return df.filter(F.col(id_col) == F.lit(value)).orderBy(*order).limit(1)


def own(df: DataFrame, user: str, me) -> DataFrame:
    """df with own: whether a row is the reader's; false without a reader or a user."""
    return df.withColumn("own", F.coalesce(F.col(user) == F.lit(me), F.lit(False)))


def labelled(df: DataFrame, labels: DataFrame, key: str, label: str, keep: bool = True) -> DataFrame:
    """df with the label of its key; without one, under its own key, or dropped. labels: one row per key."""
    hit = df.join(labels.select(key, label), key, "left" if keep else "inner")
    return hit.withColumn(label, F.coalesce(F.col(label), F.col(key).cast("string")))


def keyed(df: DataFrame, labels: DataFrame, label: str, key: str) -> DataFrame:
    """The reverse: df with the key of its label; of several keys with one label the first. Unknown labels have none."""
    back = labels.groupBy(label).agg(F.min(key).alias(key))
    return df.join(back, label, "left")


def with_map(df: DataFrame, values: DataFrame, on: str, key: str, value: str, name: str) -> DataFrame:
    """df with a map of the values' keys to values; an empty one where there are none."""
    maps = values.groupBy(on).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))
    kinds = dict(values.dtypes)
    none = F.map_from_arrays(F.array().cast(f"array<{kinds[key]}>"), F.array().cast(f"array<{kinds[value]}>"))
    return df.join(maps, on, "left").withColumn(name, F.coalesce(F.col(name), none))


def tagged(elements: DataFrame, intervals: DataFrame, on: list[str]) -> DataFrame:
    """Elements with their intervals by index; an interval may tag several elements, each is kept."""
    return elements.join(intervals, on)


def start_of(value: Column) -> Column:
    """The start that a JSON value holds: a number itself, or an object's start."""
    return F.coalesce(F.get_json_object(value, "$.start").try_cast("double"), value.try_cast("double"))


def first_values(df: DataFrame, keys: list[str], item: str, order: list[str], value: str) -> DataFrame:
    """The greatest value over the first row of each item: best, by key."""
    firsts = df.groupBy(*keys, item).agg(F.min_by(value, F.struct(*order)).alias("_v"))
    return firsts.groupBy(*keys).agg(F.max("_v").alias("best"))


def all_entries(buckets: DataFrame, prefix: str) -> DataFrame:
    """Entries of every bucket whose key has the prefix; values that are no arrays or don't parse are skipped."""
    rows = buckets.filter(F.col("key").startswith(prefix) & F.trim("value").startswith("["))
    return rows.select("key", F.inline(F.from_json("value", f"array<{ENTRY}>")))


def inserted_after(lines: DataFrame, marker: Column, text: Column, columns: list[str]) -> DataFrame:
    """Lines (line and other columns) with one more line after each that the marker picks; part is 0 or 1."""
    both = F.when(marker, F.array(F.col("line"), text)).otherwise(F.array("line"))
    return lines.select(*columns, F.posexplode(both).alias("part", "line"))

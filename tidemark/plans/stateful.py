"""Queries on states: streams whose rows come out of order, a table that batches are merged into, machines and imputed times within a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import align, catalog, store
from tidemark.sources.shared import shared_folder
from tidemark.sources.versioned import Versioned
from tidemark.streaming import events as streams
from tidemark.streaming.ordered import Letters, Machine, Periods, Saves, in_order

from .registered import QUERIES, SQL, query, table

#: Hours that a row may come late, microseconds in an hour.
LATE, HOUR = 12, 3_600_000_000


def slices(events: DataFrame, n: int = 3) -> list[DataFrame]:
    """Events in n slices of the time at which they come: up to LATE hours after their own, by their ids."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    comes = F.unix_micros("ts") + F.pmod(F.col("event_id") * 7919, F.lit(LATE * 60)) * (HOUR // 60)
    low, high = events.agg(F.min(comes), F.max(comes)).first()
    width = ((high or 0) - (low or 0)) // n + 1
    return [events.filter((comes >= F.lit((low or 0) + i * width)) & (comes < F.lit((low or 0) + (i + 1) * width))) for i in range(n)]


def _streamed(spark, sf_dir, machine: Machine, **columns) -> DataFrame:
    path = f"{shared_folder(spark)}/{streams.new_name()}"
    out = streams.run_over_slices(slices(table(spark, sf_dir, "events")), lambda s: in_order(s, ["user_id"], "ts", ["event_id"], machine, f"{LATE} hours", **columns), path)
    return out.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("at", "sent_at") if c in out.columns})


_MARK = f"(SELECT date_trunc('millisecond', max(ts)) - INTERVAL {LATE} HOUR FROM events)"


@query(f"""
WITH a AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saves FROM events),
b AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, saves ORDER BY ts, event_id) AS before FROM a),
c AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, saves ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM b),
d AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS written_at, count(*) AS n_events, bool_or(event_type = 'purchase') AS by_save FROM c GROUP BY user_id, saves, burst)
SELECT * FROM d WHERE CASE WHEN by_save THEN written_at ELSE written_at + INTERVAL 2 HOUR END < {_MARK}""")
def stream_flushed_on_save(spark, sf_dir):
    """What a debounced writer with a save button writes, but for what the watermark holds open."""
    out = _streamed(spark, sf_dir, Saves("string", 2 * HOUR), value=F.col("event_type"), save=F.col("event_type") == "purchase")
    return out.select("user_id", F.col("value").alias("event_type"), F.col("at").alias("written_at"), F.col("n").alias("n_events"), "by_save")


@query(f"""
WITH a AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS visit FROM events WHERE event_type <> 'click'),
b AS (SELECT user_id, visit, max_by((event_id, ts, event_type), (ts, event_id)) FILTER (event_type <> 'signup') AS newest, min(ts) FILTER (event_type = 'signup') AS sent_at FROM a GROUP BY ALL)
SELECT user_id, newest[1] AS event_id, newest[2] AS kept_at, sent_at FROM b
WHERE newest[3] = 'error' AND sent_at IS NOT NULL AND sent_at - newest[2] < INTERVAL 48 HOUR AND sent_at < {_MARK}""")
def stream_replayed_letters(spark, sf_dir):
    """Errors as letters that were kept, views and purchases as delivered ones, clicks as rejected ones, signups as the sender's return within two days."""
    kind = F.col("event_type")
    outcome = F.when(kind == "signup", "back").when(kind == "error", "kept").when(kind == "click", "rejected").otherwise("delivered")
    out = _streamed(spark, sf_dir, Letters("long", 48 * HOUR), value=F.col("event_id"), outcome=outcome)
    return out.select("user_id", F.col("value").alias("event_id"), F.col("at").alias("kept_at"), "sent_at")


@query(f"""
WITH w AS (SELECT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS flushed_at, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY ALL),
f AS (SELECT user_id, flushed_at, event_type FROM w WINDOW o AS (PARTITION BY user_id ORDER BY flushed_at) QUALIFY lag(event_type) OVER o IS DISTINCT FROM event_type OR row_number() OVER o = 1)
SELECT * FROM f WHERE flushed_at <= {_MARK}""")
def stream_dirty_periods(spark, sf_dir):
    """The last value of each day, where it isn't what was written before."""
    out = _streamed(spark, sf_dir, Periods("string", 24 * HOUR), value=F.col("event_type"))
    return out.select("user_id", F.col("at").alias("flushed_at"), F.col("value").alias("event_type"))


# A table that batches are merged into


@query("""
SELECT user_id, max(ts) AS at, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value
FROM events GROUP BY user_id HAVING max_by(event_type, (ts, event_id)) <> 'error'""")
def stream_merged_store(spark, sf_dir):
    """The newest event of each user, merged from three files out of order; an error deletes. The last batch is merged once more, in vain."""
    path = f"{shared_folder(spark)}/{streams.new_name()}"
    users = Versioned(spark, f"{path}/table", "user_id long, at timestamp, event_id long, event_type string, value double", ["user_id"], ["at", "event_id"])
    for i, part in enumerate(slices(table(spark, sf_dir, "events"))):
        part.select("user_id", F.col("ts").alias("at"), "event_id", "event_type", "value", (F.col("event_type") == "error").alias("gone")).write.parquet(f"{path}/in/slice={i}")
        changes = spark.read.parquet(f"{path}/in/slice={i}")
        stream = spark.readStream.schema(changes.schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
        stream.writeStream.foreachBatch(users.sink("events")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    users.merge(changes, "events", 2)
    return users.rows().withColumn("at", F.col("at").cast("timestamp_ntz"))


_MIGRATED = """
one AS (SELECT 'r-' || conv_id || '-' || turn AS key, turn, conv_id::VARCHAR AS chapter, CASE WHEN role = 'user' THEN 'Asked' ELSE 'Prompt ' || turn END AS label, text FROM conversations),
two AS (SELECT 'q-' || r_name || '_' || (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1) AS key, r_name AS path, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS step, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
three AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus FROM orders)"""


@query(f"""
WITH {_MIGRATED}
SELECT 'reflection' AS type, chapter AS "chapterId", label AS "promptLabel", text AS content, NULL AS "cardId", NULL AS pathway, NULL AS step, NULL AS tier, sha256(key) AS id FROM one WHERE turn BETWEEN 1 AND 3 AND text <> ''
UNION ALL SELECT 'reflection', 'six', path || ' – ' || step, n_name, NULL, path, step::VARCHAR, NULL, sha256(key) FROM two WHERE path IN ('ASIA', 'EUROPE') AND step < 3
UNION ALL SELECT 'commitment', o_custkey::VARCHAR, NULL, o_orderpriority, o_orderkey::VARCHAR, NULL, NULL, o_orderstatus, sha256(o_custkey || '|' || o_orderkey || '|commitment') FROM three
UNION ALL SELECT NULL, key, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM one WHERE turn NOT BETWEEN 1 AND 3 OR text = ''
UNION ALL SELECT NULL, key, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM two WHERE path NOT IN ('ASIA', 'EUROPE') OR step >= 3""")
def migrated_store(spark, sf_dir):
    """Keys of three layouts in one table, migrated by two runs of which the second finds it done; what is left there, entries by their fields and old keys as chapterId."""
    said = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("r"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
        F.to_json(F.struct(F.col("text").alias("content"), F.when(F.col("role") == "user", "Asked").alias("title"))).alias("value"),
    )
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    steps = nations.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n")).select("r_name", F.posexplode("n").alias("step", "n"))
    steps = steps.select(F.concat(F.lit("q-"), "r_name", F.lit("_"), F.col("step").cast("string")).alias("key"), F.col("n.n_name").alias("value"))
    card = F.struct(F.col("o_orderpriority").alias("commitment"), F.col("o_orderstatus").alias("tier"))
    cards = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), card))).alias("m"))
    cards = cards.select(F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("key"), F.to_json("m").alias("value"))
    kept = Versioned(spark, f"{shared_folder(spark)}/{streams.new_name()}", "key string, run int, value string", ["key"], ["run"])
    kept.merge(said.unionByName(steps).unionByName(cards).select("key", F.lit(0).alias("run"), "value", F.lit(False).alias("gone")), "load", 0)
    for _ in range(2):
        changes = store.migration(kept.rows().select("key", "value"), "r-", "six", "q-", ["ASIA", "EUROPE"], ["0", "1", "2"], "c-")
        kept.merge(changes.withColumn("run", F.lit(1)), "migration", 1)
    fields = ["type", "chapterId", "promptLabel", "content", "cardId", "pathway", "step", "tier", "id"]
    entry = F.from_json(F.when(F.col("key").startswith("entry/"), F.col("value")), ", ".join(f"{f} string" for f in fields))
    return kept.rows().select(entry.alias("e"), "key").select(*[F.when(F.col("e").isNull(), F.col("key")).otherwise(F.col("e.chapterId")).alias(f) if f == "chapterId" else F.col(f"e.{f}").alias(f) for f in fields])


# States within a key


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, (event_id % 7)::INTEGER AS target, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, -1 AS track, 0 AS mode FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL SELECT e.user_id, e.n, e.event_id,
        CASE WHEN event_type = 'purchase' THEN CASE WHEN target < 5 THEN target ELSE track END
             WHEN track < 0 THEN track
             WHEN event_type = 'view' THEN CASE WHEN track < 4 THEN track + 1 WHEN mode = 1 THEN 0 ELSE track END
             WHEN event_type = 'error' THEN CASE WHEN track > 0 THEN track - 1 WHEN mode = 1 THEN 4 ELSE track END
             WHEN event_type = 'click' AND mode <> 2 THEN CASE WHEN track < 4 THEN track + 1 WHEN mode = 1 THEN 0 ELSE -1 END
             ELSE track END,
        CASE WHEN event_type = 'signup' THEN (mode + 1) % 3 ELSE mode END
      FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, track, ['none', 'all', 'one'][mode + 1] AS repeat FROM w WHERE n > 0""")
def played_tracks(spark, sf_dir):
    """Purchases choose a track, views go on, errors back, clicks are ends of tracks, signups press the button for repeats."""
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "play").when(kind == "view", "next").when(kind == "error", "back").when(kind == "click", "ended").otherwise("repeat")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", action.alias("action"), (F.col("event_id") % 7).cast("int").alias("target"))
    return catalog.played(rows, ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id", "track", "repeat")


_GAPS = "SELECT user_id, event_id, event_type IN ('purchase', 'view') AS found, event_id * 0.5::DOUBLE AS s, event_id * 0.5::DOUBLE + 0.25 AS e, event_id % 30 AS words, count(*) FILTER (event_type IN ('purchase', 'view')) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events"


def imputed_sql(length: str, front: bool, before: str = "", rows: str = _GAPS, key: str = "user_id", at: str = "event_id") -> str:
    """Intervals of what is found in rows, and of what comes between; front: those before the first count as well. Rounded by exact binary values."""
    return f"""
WITH RECURSIVE {before} a AS ({rows}),
k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {at}) AS n FROM a WHERE run > 0 OR {front}),
w AS (SELECT {key}, {at}, n, CASE WHEN found THEN s ELSE 0 END AS start, CASE WHEN found THEN e ELSE 1 END AS e, NOT found AS estimated FROM k WHERE n = 1
      UNION ALL SELECT {key}, {at}, n, CASE WHEN found THEN s ELSE last END,
        CASE WHEN found THEN e ELSE (r + CASE WHEN p - r > 0.5 OR p - r = 0.5 AND (lost > 0 OR lost = 0 AND r % 2 = 1) THEN 1 ELSE 0 END) / 1000::DOUBLE END, NOT found
      FROM (SELECT *, floor(p) AS r, (high * 1000::DOUBLE - p) + (x - high) * 1000::DOUBLE AS lost
            FROM (SELECT *, x * 1000::DOUBLE AS p, x * 134217729::DOUBLE - (x * 134217729::DOUBLE - x) AS high
                  FROM (SELECT k.*, w.e AS last, w.e + {length} AS x FROM w JOIN k ON k.{key} = w.{key} AND k.n = w.n + 1))))
SELECT {key}, {at}::INTEGER AS index, start, e AS "end", estimated FROM w"""


def _imputed(strategy):
    def run(spark, sf_dir):
        found = F.col("event_type").isin("purchase", "view")
        rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("int").alias("index"), F.when(found, F.col("event_id") * 0.5).alias("start"), F.when(found, F.col("event_id") * 0.5 + 0.25).alias("end"), (F.col("event_id") % 30).cast("int").alias("words"))
        return align.imputed(rows, strategy, "user_id")

    return run


for _name, _strategy, _length, _front in (("imputed_seconds", "exact_prefix5", "3.0::DOUBLE", False), ("imputed_means", "subsequence", "w.e / w.n", False), ("imputed_by_words", "fuzzy", "greatest(1.0::DOUBLE, 0.15::DOUBLE * k.words)", True)):
    QUERIES[_name], SQL[_name] = _imputed(_strategy), imputed_sql(_length, _front)

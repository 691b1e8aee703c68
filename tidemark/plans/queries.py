"""Queries that apply the operators to the given tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import numbers, references, text
from tidemark.operators import asof, checks, ordered, pages, report, search, store
from tidemark.plans.registered import QUERIES, SQL, query, table
from tidemark.sources import readers
from tidemark.sources.shared import shared_folder
from tidemark.streaming import events as streams

# Summaries and groups


@query("SELECT user_id, count(*) AS n, count(DISTINCT coalesce(event_type, '<null>')) AS n_kinds, max(ts) AS latest FROM events GROUP BY user_id")
def activity_summary(spark, sf_dir):
    return report.summary(table(spark, sf_dir, "events"), ["user_id"], "event_type", "ts")


@query("SELECT coalesce(nullif(event_type, ''), 'unknown') AS event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1")
def activity_by_type(spark, sf_dir):
    return report.by_group(table(spark, sf_dir, "events"), "event_type", "ts")


@query("""
SELECT event_type, event_type || chr(10) || repeat('-', 30) || chr(10) || string_agg(strftime(d, '%Y-%m-%d') || ': ' || n, chr(10) ORDER BY d) AS report
FROM (SELECT event_type, ts::DATE AS d, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type""")
def report_export(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return report.report(daily, "event_type", ["d"], F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit(": "), F.col("n").cast("string")))


@query("""
SELECT c_custkey, coalesce(n_name, 'Nation ' || c_nationkey) AS nation
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON c_nationkey = n_nationkey""")
def dimension_fallback(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return report.with_dimension(rows, nations, "c_nationkey", {"nation": F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"))}).drop("c_nationkey")


# Keyed entries


@query("""
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, min_by(event_id, (ts, event_id)) AS first_event_id, min_by(value, (ts, event_id)) AS first_value
FROM events GROUP BY user_id, event_type""")
def latest_per_identity(spark, sf_dir):
    return ordered.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id", "value")


_HALVES = "a AS (SELECT *, ts >= TIMESTAMP '2024-01-16' AS new FROM events)"


@query(f"""
WITH {_HALVES}
SELECT user_id, event_type, min_by(event_id, (new, ts, event_id)) AS event_id, max_by(value, (new, ts, event_id)) AS value, max_by(ts, (new, ts, event_id)) AS ts
FROM a GROUP BY user_id, event_type""")
def identity_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    new = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    return store.upserted(rows.filter(~new), rows.filter(new), ["user_id", "event_type"], ["ts", "event_id"], "event_id", ["value", "ts"])


_SIDES = """
l AS (SELECT user_id, max(ts) AS ts, max_by(value, (ts, event_id)) AS value FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
r AS (SELECT user_id, max(ts) AS ts, max_by(value, (ts, event_id)) AS value FROM events WHERE event_id % 2 = 1 GROUP BY user_id)"""


def _sides(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return [ordered.latest(rows.filter(F.col("event_id") % 2 == side), ["user_id"], ["ts", "event_id"], "ts", "value").select("user_id", "ts", "value") for side in (0, 1)]


@query(f"""
WITH {_SIDES}
SELECT user_id, CASE WHEN l.ts IS NULL OR r.ts > l.ts THEN r.ts ELSE l.ts END AS ts, CASE WHEN l.ts IS NULL OR r.ts > l.ts THEN r.value ELSE l.value END AS value,
       CASE WHEN l.ts IS NULL OR r.ts > l.ts THEN 'remote' ELSE 'local' END AS origin
FROM l FULL JOIN r USING (user_id)""")
def newest_wins_merge(spark, sf_dir):
    return store.newest_wins(*_sides(spark, sf_dir), ["user_id"], "ts", ["value"])


@query("""
WITH p AS (SELECT user_id, event_id % 2 AS side, max(event_id % 101) AS position, max_by(event_type, (event_id % 101, event_id)) AS sentence,
                  max(CASE WHEN event_type = 'signup' THEN event_id::VARCHAR ELSE '' END) AS bookmark FROM events GROUP BY ALL),
l AS (SELECT * FROM p WHERE side = 0), r AS (SELECT * FROM p WHERE side = 1)
SELECT user_id, CASE WHEN l.side IS NULL OR coalesce(r.position, -1) > coalesce(l.position, -1) THEN r.position ELSE l.position END AS position,
       CASE WHEN l.side IS NULL OR coalesce(r.position, -1) > coalesce(l.position, -1) THEN r.sentence ELSE l.sentence END AS sentence, coalesce(nullif(l.bookmark, ''), r.bookmark) AS bookmark
FROM l FULL JOIN r USING (user_id)""")
def progress_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("p", F.col("event_id") % 101)
    sides = [rows.filter(F.col("event_id") % 2 == side).groupBy("user_id").agg(F.max("p").alias("position"), F.max_by("event_type", F.struct("p", "event_id")).alias("sentence"), F.max(F.when(F.col("event_type") == "signup", F.col("event_id").cast("string")).otherwise("")).alias("bookmark")) for side in (0, 1)]
    return store.merged_progress(*sides, ["user_id"])


@query("""
SELECT event_id, CASE WHEN pick AND event_type = 'purchase' THEN 'view' WHEN pick THEN 'purchase' ELSE event_type END AS status,
       CASE WHEN pick AND event_type <> 'purchase' THEN TIMESTAMP '2024-02-01' WHEN pick THEN NULL ELSE ts END AS done_at
FROM (SELECT *, value > 50 AS pick FROM events WHERE event_type IN ('view', 'purchase') AND value IS NOT NULL)""")
def goal_toggle(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type in ('view', 'purchase') and value is not null")
    rows = rows.select("event_id", "value", F.when(F.col("event_type") == "purchase", "completed").otherwise("active").alias("status"), F.col("ts").alias("done_at"))
    out = store.toggled(rows, F.col("value") > 50, F.lit("2024-02-01").cast("timestamp_ntz"), "status", "done_at")
    return out.select("event_id", F.when(F.col("status") == "completed", "purchase").otherwise("view").alias("status"), "done_at")


# As-of and nearest


@query("""
SELECT p.event_id, p.user_id, v.event_id AS mark_event_id, v.value AS mark_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN
     (SELECT user_id, ts, max_by(event_id, event_id) AS event_id, max_by(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v
ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_last_view(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    hit = asof.asof(rows.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), rows.filter("event_type = 'view'"), ["user_id"], "ts", "event_id", ["event_id", "value"])
    return hit.drop("ts")


@query("""
WITH v AS (SELECT user_id, event_id, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ts FROM events WHERE event_type = 'view'),
m AS (SELECT user_id, ts, max(event_id) AS event_id FROM v GROUP BY user_id, ts)
SELECT p.event_id, p.user_id, m.event_id AS mark_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.ts >= m.ts""")
def asof_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    hit = asof.asof(rows.filter("event_type = 'purchase'").drop("event_type"), rows.filter("event_type = 'view'"), ["user_id"], "ts", "event_id", ["event_id"], "prefix")
    return hit.drop("ts")


@query("""
WITH s AS (SELECT * FROM events WHERE event_type = 'signup'), e AS (SELECT * FROM events WHERE event_type = 'error'),
c AS (SELECT s.event_id, s.user_id, e.event_id AS m, row_number() OVER (PARTITION BY s.event_id ORDER BY abs(epoch_us(e.ts) - epoch_us(s.ts)), e.ts, CASE WHEN e.ts <= s.ts THEN -e.event_id ELSE e.event_id END) AS r
      FROM s LEFT JOIN e ON s.user_id = e.user_id)
SELECT event_id, user_id, m AS mark_event_id FROM c WHERE r = 1""")
def nearest_event(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    hit = asof.nearest(rows.filter("event_type = 'signup'").drop("event_type"), rows.filter("event_type = 'error'"), ["user_id"], "ts", "event_id", ["event_id"])
    return hit.drop("ts")


# Ordered rows


@query("""
SELECT user_id, event_id, event_type, previous FROM (SELECT *, lag(event_type) OVER w AS previous, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE n = 1 OR event_type IS DISTINCT FROM previous""")
def change_points(spark, sf_dir):
    return ordered.changes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "previous")


_BURSTS = """
WITH a AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM a)
SELECT user_id, event_type, max_by(value, (ts, value)) AS value, max(ts) AS last_at, count(*) AS n_events FROM b GROUP BY user_id, event_type, burst"""


@query(_BURSTS)
def debounced_values(spark, sf_dir):
    return ordered.debounced(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "value", "6 hours")


@query("""
SELECT user_id, min(CASE WHEN total > 5 THEN ts END) AS in_progress, min(CASE WHEN total > 90 THEN ts END) AS completed
FROM (SELECT *, sum(coalesce(value, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events) GROUP BY user_id""")
def threshold_first_cross(spark, sf_dir):
    total = F.sum(F.coalesce("value", F.lit(0.0))).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return ordered.crossings(table(spark, sf_dir, "events").withColumn("total", total), ["user_id"], "ts", "total", {"in_progress": 5.0, "completed": 90.0})


@query("SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS high FROM events")
def high_water(spark, sf_dir):
    return ordered.high_water(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "high")


@query("""
SELECT p_partkey, p_brand, section, row_number() OVER (PARTITION BY p_brand ORDER BY section DESC, p_size, p_partkey) AS number
FROM (SELECT *, 'primary' AS section FROM part WHERE p_size <= 25 UNION ALL SELECT *, 'alternate' FROM part WHERE p_size > 10)""")
def track_numbering(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return ordered.numbered_union({"primary": parts.filter("p_size <= 25"), "alternate": parts.filter("p_size > 10")}, ["p_brand"], ["p_size", "p_partkey"]).drop("p_size")


@query("""
SELECT n_name, coalesce(lag(n_name) OVER w, last_value(n_name) OVER a) AS previous, coalesce(lead(n_name) OVER w, first_value(n_name) OVER a) AS next
FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey), a AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def adjacent_wrap(spark, sf_dir):
    return ordered.neighbours(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], "n_name", True).select("n_name", "previous", "next")


@query("""
SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def adjacent_orders(spark, sf_dir):
    return ordered.neighbours(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", False).select("o_orderkey", "previous", "next")


@query("""
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS carried FROM conversations""")
def carry_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return ordered.carried(rows, ["conv_id"], ["turn"], F.when(F.col("role") == "system", F.col("text")), "carried").select("conv_id", "turn", "role", "carried")


# Texts


@query("""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, unnest(range(0, len(l)))::INTEGER AS index, unnest(l) AS text FROM l""")
def document_lines(spark, sf_dir):
    return readers.lines(table(spark, sf_dir, "documents"), "text", ["doc_id"])


_NORMAL = "trim(regexp_replace(lower(text), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"


@query(f"""
WITH p AS (SELECT item_id, {_NORMAL} AS p FROM benchmark), d AS (SELECT doc_id, {_NORMAL} AS t FROM documents)
SELECT item_id, doc_id, instr(' ' || t || ' ', ' ' || p || ' ')::INTEGER AS position FROM p JOIN d ON contains(' ' || t || ' ', ' ' || p || ' ') WHERE p <> ''""")
def passage_locate(spark, sf_dir):
    return search.located(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")


@query(f"""
WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split({_NORMAL}, ' '), lambda w: w <> '')) AS term FROM benchmark),
w AS (SELECT doc_id, unnest(string_split({_NORMAL}, ' ')) AS term FROM documents),
t AS (SELECT term, doc_id, count(*) AS tf FROM w WHERE term <> '' AND term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS w FROM t GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(tf * w), 6) AS score FROM q JOIN f USING (term) JOIN t USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 3""")
def search_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    postings = search.index(docs, "doc_id", "text", queries.select("term").distinct())
    return search.top_documents(postings, queries, docs.count(), 3)


@query("""
WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) AS lang, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number FROM pages)
SELECT page_id, scheme, host, number, coalesce(n, 0) AS n_documents FROM u LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) d USING (lang)""")
def dictionary_extract(spark, sf_dir):
    part = lambda p: F.regexp_extract("url", p, 1)
    urls = table(spark, sf_dir, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), part("^[a-z]+://([^/?#]+)").alias("host"), part("^[a-z]+://[^/]+/([a-z]{2})/").alias("lang"), part("/([0-9]+)").try_cast("long").alias("number"))
    languages = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_documents"))
    return urls.join(languages, "lang", "left").select("page_id", "scheme", "host", "number", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


@query("""
WITH r AS (SELECT o_orderkey, 'see ' || upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) || ' ' || (o_orderkey % 40 + 1) || ':' || (o_orderkey % 30 + 1) || CASE WHEN o_orderkey % 3 = 0 THEN '-' || (o_orderkey % 30 + 4) ELSE '' END AS t,
                  n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' WHERE instr(n_name, ' ') = 0)
SELECT o_orderkey, 0 AS ref_no, (o_orderkey % 40 + 1)::INTEGER AS chapter, (o_orderkey % 30 + 1)::INTEGER AS verse, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 30 + 4)::INTEGER END AS last_verse,
       CASE WHEN r_name IS NOT NULL THEN '/study/scriptures/' || lower(r_name) || '/' || (o_orderkey % 40 + 1) || '?id=p' || (o_orderkey % 30 + 1) || CASE WHEN o_orderkey % 3 = 0 THEN '-p' || (o_orderkey % 30 + 4) ELSE '' END || '#p' || (o_orderkey % 30 + 1) END AS url
FROM r""")
def reference_links(spark, sf_dir):
    """Orders' nations as books of references, built into texts and found again; one region's books have no path."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").filter("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left").filter("instr(n_name, ' ') = 0")
    people = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    words = F.concat(F.lit("see "), F.initcap("n_name"), F.lit(" "), s(k % 40 + 1), F.lit(":"), s(k % 30 + 1), F.when(k % 3 == 0, F.concat(F.lit("-"), s(k % 30 + 4))).otherwise(""))
    orders = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", words.alias("t"))
    books = nations.select(F.col("n_name").alias("name"), F.lower("r_name").alias("path"))
    names = [r.name for r in books.select("name").collect()]  # the dictionary: a fixed number of nations
    return references.linked(orders, "t", books, names, "/study/scriptures/").select("o_orderkey", "ref_no", "chapter", "verse", "last_verse", "url")


@query("""
SELECT p_partkey, array_to_string(list_transform(string_split(regexp_replace(slug, '^(?:chapter-)?(?:[0-9]+-)?', ''), '-'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title
FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'chapter-' ELSE '' END || lpad((p_partkey % 90 + 10)::VARCHAR, 2, '0') || '-' || replace(lower(p_name), ' ', '-') AS slug FROM part)""")
def slug_titles(spark, sf_dir):
    k = F.col("p_partkey")
    slug = F.concat(F.when(k % 2 == 0, "chapter-").otherwise(""), text.padded(k % 90 + 10), F.lit("-"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")))
    return table(spark, sf_dir, "part").select("p_partkey", text.title_of(slug).alias("title"))


@query("""
SELECT c_custkey, upper(array_to_string(list_transform(list_slice(list_filter(string_split(replace(c_name, '#', ' '), ' '), lambda w: w <> ''), 1, 2), lambda w: substr(w, 1, 1)), '')) AS initials,
       CASE WHEN length(c_name) > 12 THEN substr(c_name, 1, 9) || '…' ELSE c_name END AS label, replace(replace(replace(c_name || ' <b>&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM customer""")
def name_labels(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", text.initials(F.replace(name, F.lit("#"), F.lit(" "))).alias("initials"), text.label(name, 12).alias("label"), text.escaped(F.concat(name, F.lit(" <b>&"))).alias("escaped"))


@query("""
SELECT l_orderkey, l_linenumber, (floor(floor(l_extendedprice) / 60))::BIGINT || ':' || lpad((floor(l_extendedprice)::BIGINT % 60)::VARCHAR, 2, '0') AS clock, floor(l_discount * 100.0 / (l_discount + l_tax) + 0.5)::INTEGER AS share,
       greatest(5, least(40, l_quantity)) AS clamped FROM lineitem WHERE l_discount + l_tax > 0""")
def clock_format(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_discount + l_tax > 0")
    return rows.select("l_orderkey", "l_linenumber", numbers.clock(F.col("l_extendedprice")).alias("clock"), numbers.percent(F.col("l_discount"), F.col("l_discount") + F.col("l_tax")).alias("share"), numbers.clamp(F.col("l_quantity"), 5.0, 40.0).alias("clamped"))


@query("""
SELECT event_id, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN m // 60 || 'h ago' WHEN m < 10080 THEN m // 1440 || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS ago
FROM (SELECT *, floor((epoch_us(TIMESTAMP '2024-01-31') // 1000000 - floor(epoch_us(ts) / 1000000)) / 60)::BIGINT AS m FROM events)""")
def relative_times(spark, sf_dir):
    at, now = F.col("ts").cast("timestamp"), F.lit("2024-01-31 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", numbers.relative_time(at, now).alias("ago"))


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(nullif(json_extract_string(props, '$.missing'), ''), event_type) AS shown FROM events""")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), text.first_of(F.get_json_object("props", "$.missing"), F.col("event_type")).alias("shown"))


@query("""
SELECT conv_id, turn, concat_ws('; ', CASE WHEN NOT coalesce(trim(text) <> '', false) THEN 'text: required' END, CASE WHEN NOT coalesce(length(trim(text)) >= 60, false) THEN 'text: too short' END,
       CASE WHEN NOT coalesce(contains(text, '@') AND trim(text) <> '', false) THEN 'email: invalid' END, CASE WHEN NOT coalesce(role <> 'system', false) THEN 'role: reserved' END) AS errors FROM conversations""")
def validate_rows(spark, sf_dir):
    t, r = F.col("text"), F.col("role")
    first, other = {"text": (checks.required(t), "required")}, {"text": (checks.at_least(t, 60), "too short"), "email": (checks.email(t), "invalid"), "role": (r != "system", "reserved")}
    found = F.array_join(F.filter(F.array(checks.errors(first), checks.errors(other)), lambda e: e != ""), "; ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("errors"))


@query("""
WITH l AS (SELECT conv_id, turn, role, unnest(CASE WHEN role = 'assistant' AND turn >= 2 THEN [text, 'back to ' || conv_id] ELSE [text] END) AS line, unnest(CASE WHEN role = 'assistant' AND turn >= 2 THEN [0, 1] ELSE [0] END) AS part FROM conversations)
SELECT conv_id, turn, part, line FROM l""")
def insert_after_marker(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("text", "line")
    marker = (F.col("role") == "assistant") & (F.col("turn") >= 2)
    return store.inserted_after(rows, marker, F.concat(F.lit("back to "), F.col("conv_id").cast("string")), ["conv_id", "turn"])


# Pages


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?(-->|$)|<script[\s>].*?(</script>|$)|<style[\s>].*?(</style>|$)|<(a|code|pre|textarea)(\s[^>]*)?>.*?(</(a|code|pre|textarea)>|$)', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '<[A-Za-z/!][^>]*(>|$)', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(t, '&middot;', chr(183)), '&copy;', chr(169)), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM b),
d AS (SELECT page_id, t, list_filter(string_split(lower(t), ' '), lambda w: w <> '') AS w FROM c)
SELECT page_id, length(t) AS n_chars, len(w) AS n_words, len(list_filter(w, lambda x: x = 'the')) AS n_the, md5(t) AS digest FROM d""")
def html_text_search(spark, sf_dir):
    """Words of pages' searchable text, and how often "the" is among them."""
    words = text.tokens(F.col("text"))
    return pages.with_text(table(spark, sf_dir, "pages")).select("page_id", F.length("text").alias("n_chars"), F.size(words).alias("n_words"), F.size(F.filter(words, lambda w: w == "the")).alias("n_the"), F.md5("text").alias("digest"))


# Streams: what the batch queries give, from a stream of files


def _place(spark) -> str:
    return f"{shared_folder(spark)}/{streams.new_name()}"


@query("SELECT user_id, max(value) AS high, min(CASE WHEN value > 5 THEN ts END) AS in_progress, min(CASE WHEN value > 90 THEN ts END) AS completed FROM events GROUP BY user_id")
def stream_marks(spark, sf_dir):
    stream = streams.marks_stream(streams.read_events(spark, f"{sf_dir}/events.parquet"), ["user_id"], "ts", "value", {"in_progress": 5.0, "completed": 90.0})
    out = streams.run_to_table(stream, _place(spark), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("in_progress", "completed")})


@query(SQL["change_points"])
def stream_change_points(spark, sf_dir):
    stream = streams.changes_stream(streams.read_events(spark, f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"], "event_type")
    return streams.run_to_table(stream, _place(spark)).select("user_id", "event_id", "event_type", "previous")


@query(_BURSTS + " HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_debounced(spark, sf_dir):
    """Bursts that the watermark has closed; the last ones of the table stay open."""
    stream = streams.debounced_stream(streams.read_events(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"], "ts", "value", "6 hours", "1 hour")
    return streams.run_to_table(stream.drop("session_window"), _place(spark)).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))

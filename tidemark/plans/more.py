"""More queries on the given tables: orders, look-ups, entries in a store, links in texts, written-behind values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import numbers, references, text
from tidemark.operators import catalog, ordered, report, search, store
from tidemark.plans import queries
from tidemark.plans.registered import query, table
from tidemark.sources import readers
from tidemark.sources.shared import shared_folder
from tidemark.streaming import events as streams

# Orders


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS place FROM events")
def newest_first(spark, sf_dir):
    return ordered.placed(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], ordered.newest_first("ts", "event_id")).drop("ts")


@query("""
SELECT page_id, lang, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN number = '' THEN 0 ELSE TRY_CAST(number AS DOUBLE) END NULLS LAST, page_id) AS place
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) AS lang, regexp_extract(url, '/[a-z]{2}/([0-9?a-z=&_]*)', 1) AS number FROM pages)""")
def number_order(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]{2})/", 1).alias("lang"), F.regexp_extract("url", "/[a-z]{2}/([0-9?a-z=&_]*)", 1).alias("number"))
    return ordered.placed(rows, ["lang"], ordered.by_number("number", "page_id")).drop("number")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id) AS place FROM events")
def active_first(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ordered.placed(rows, ["user_id"], ordered.chosen_first(F.col("event_type") == "purchase", "event_id")).drop("event_type")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3")
def last_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ordered.placed(rows, ["o_custkey"], ordered.newest_first("o_orderdate", "o_orderkey")).filter("place <= 3").drop("o_orderdate")


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('17:' || p_partkey), p_partkey) AS place FROM part")
def shuffled_parts(spark, sf_dir):
    return ordered.placed(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_brand"], ordered.shuffled("p_partkey", 17))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber IN (1, 3, 7)")
def picked_lines(spark, sf_dir):
    return ordered.picked(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_linenumber", [1, 3, 7])


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id, resets ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked
FROM (SELECT *, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS resets FROM conversations)""")
def carried_until_reset(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return ordered.carried(rows, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), "asked", F.col("role") == "system").select("conv_id", "turn", "asked")


# Look-ups


@query("""
SELECT s_suppkey, coalesce(n_name, s_nationkey::VARCHAR) AS n_name, back.key AS back
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON s_nationkey = n_nationkey
LEFT JOIN (SELECT n_name AS name, min(n_nationkey) AS key FROM nation WHERE n_regionkey <> 1 GROUP BY n_name) back ON back.name = coalesce(n_name, s_nationkey::VARCHAR)""")
def label_lookup(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("key"))
    named = store.labelled(rows, nations.filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("key"), "n_name"), "key", "n_name").drop("key")
    return store.keyed(named, nations.filter("n_regionkey <> 1").select("n_name", F.col("n_nationkey").alias("back")), "n_name", "back")


@query("""
SELECT n_nationkey, count(s_suppkey)::INTEGER AS n_suppliers, min_by(s_acctbal, s_suppkey) AS first_balance FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON s_nationkey = n_nationkey GROUP BY n_nationkey""")
def maps_by_nation(spark, sf_dir):
    balances = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_acctbal")
    rows = store.with_map(table(spark, sf_dir, "nation").select("n_nationkey"), balances, "n_nationkey", "s_suppkey", "s_acctbal", "balances")
    first = F.try_element_at("balances", F.array_min(F.map_keys("balances")))
    return rows.select("n_nationkey", F.size("balances").alias("n_suppliers"), first.alias("first_balance"))


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def tagged_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return store.tagged(lines, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), ["l_orderkey"])


@query("SELECT event_id, value AS start FROM events")
def starts_of_json(spark, sf_dir):
    """Starts written as objects for purchases and as numbers for the rest, read back."""
    value = F.when(F.col("event_type") == "purchase", F.to_json(F.struct(F.col("value").alias("start")))).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", store.start_of(value).alias("start"))


@query("SELECT event_id, user_id, ts FROM events WHERE user_id = 7 ORDER BY ts, event_id LIMIT 1")
def first_by_id(spark, sf_dir):
    return store.by_id(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", 7, ["ts", "event_id"])


@query("SELECT o_orderkey, coalesce(o_custkey = 7, false) AS own FROM orders")
def own_orders(spark, sf_dir):
    return store.own(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 7).drop("o_custkey")


@query("SELECT user_id, greatest(4, count(DISTINCT event_type))::BIGINT AS n_kinds FROM events GROUP BY user_id")
def at_least_known(spark, sf_dir):
    kinds = report.summary(table(spark, sf_dir, "events"), ["user_id"], "event_type", "ts")
    return kinds.select("user_id", numbers.clamp(F.col("n_kinds"), 4, 1 << 40).cast("long").alias("n_kinds"))


@query("SELECT user_id, max(v) AS best FROM (SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL) GROUP BY user_id")
def best_of_firsts(spark, sf_dir):
    return store.first_values(table(spark, sf_dir, "events").filter("value is not null"), ["user_id"], "event_type", ["ts", "event_id"], "value")


@query("SELECT user_id, coalesce(n, 0) + 1 AS n FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id) USING (user_id)")
def counters(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    errors = rows.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id").distinct().join(errors, "user_id", "left").select("user_id", numbers.increment(F.col("n")).alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'unknown' WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 'large, done' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'in part' WHEN o_totalprice > 400000 THEN 'large' ELSE 'open' END AS word
FROM orders WHERE o_orderpriority <> '5-LOW'""")
def case_ladder(spark, sf_dir):
    s, large = F.col("o_orderstatus"), F.col("o_totalprice") > 400000
    cases = [(F.col("o_totalprice").isNull(), "unknown"), ((s == "F") & large, "large, done"), (s == "F", "done"), (s == "P", "in part"), (large, "large")]
    return store.deleted(table(spark, sf_dir, "orders"), "o_orderpriority", "5-LOW").select("o_orderkey", text.first_case(cases, "open").alias("word"))


# Entries in a store


_CHANGES = """
b AS (SELECT user_id, max_by(value, event_id) AS value, max_by(event_type, event_id) AS kind FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
c AS (SELECT user_id, CASE WHEN max_by(event_type, event_id) <> 'click' THEN max_by(value, event_id) END AS value, max_by(event_type, event_id) AS kind FROM events WHERE event_id % 2 = 1 GROUP BY user_id)"""


def _changes(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    half = lambda odd: rows.filter(F.col("event_id") % 2 == odd).groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max_by("event_type", "event_id").alias("kind"))
    return half(0), half(1).withColumn("value", F.when(F.col("kind") != "click", F.col("value")))


@query(f"""
WITH {_CHANGES}
SELECT user_id, CASE WHEN c.kind = 'error' AND b.user_id IS NOT NULL THEN 'delete' WHEN c.kind = 'error' THEN 'skip' WHEN b.user_id IS NOT NULL THEN 'patch' ELSE 'post' END AS action FROM c LEFT JOIN b USING (user_id)""")
def routed_changes(spark, sf_dir):
    base, changes = _changes(spark, sf_dir)
    return store.routed(changes, base, "user_id", F.col("kind") == "error").select("user_id", "action")


@query(f"""
WITH {_CHANGES}
SELECT user_id, coalesce(c.value, b.value) AS value, coalesce(c.kind, b.kind) AS kind FROM b FULL JOIN c USING (user_id) WHERE c.kind IS NULL OR c.kind <> 'error'""")
def applied_changes(spark, sf_dir):
    base, changes = _changes(spark, sf_dir)
    return store.applied(base, store.routed(changes, base, "user_id", F.col("kind") == "error"), "user_id", ["value", "kind"])


@query(f"""
WITH {_CHANGES}
SELECT user_id, coalesce(c.value, b.value) AS value, coalesce(c.kind, b.kind) AS kind FROM b FULL JOIN c USING (user_id)""")
def spread_merge(spark, sf_dir):
    base, changes = _changes(spark, sf_dir)
    return store.spread(base, changes, ["user_id"], ["value", "kind"])


_OUTCOMES = "o AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'delivered' WHEN event_type = 'error' THEN 'rejected' ELSE 'kept' END AS outcome FROM events)"


@query(f"""
WITH {_OUTCOMES}, l AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(outcome, (ts, event_id)) AS outcome FROM o WHERE outcome <> 'rejected' GROUP BY user_id)
SELECT user_id, event_id FROM l WHERE outcome = 'kept'""")
def replayed_letters(spark, sf_dir):
    """Events as sendings: views and clicks get 200, errors 400, others 503."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    status = F.when(F.col("event_type").isin("view", "click"), 200).when(F.col("event_type") == "error", 400).otherwise(503)
    return store.replay(store.sent(rows, status), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


# Written-behind values


@query("""
WITH a AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saves FROM events),
b AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, saves ORDER BY ts, event_id) AS before FROM a),
c AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, saves ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM b)
SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS written_at, count(*) AS n_events, bool_or(event_type = 'purchase') AS by_save FROM c GROUP BY user_id, saves, burst""")
def flushed_on_save(spark, sf_dir):
    return ordered.flushed(table(spark, sf_dir, "events"), ["user_id"], "ts", ["ts", "event_id"], "event_type", "2 hours", F.col("event_type") == "purchase")


@query("""
WITH w AS (SELECT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS flushed_at, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY ALL)
SELECT user_id, flushed_at, event_type FROM w WINDOW o AS (PARTITION BY user_id ORDER BY flushed_at) QUALIFY lag(event_type) OVER o IS DISTINCT FROM event_type OR row_number() OVER o = 1""")
def periodic_flushes(spark, sf_dir):
    return ordered.flushes(table(spark, sf_dir, "events"), ["user_id"], "ts", ["ts", "event_id"], "event_type", "1 day")


@query("""
SELECT * FROM (SELECT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS flushed_at, max_by(event_type, (ts, event_id)) AS event_type, count(*) AS n_events FROM events GROUP BY 1, 2)
WHERE flushed_at <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_periodic(spark, sf_dir):
    """Periods that the watermark has closed."""
    stream = streams.periodic_stream(streams.read_events(spark, f"{sf_dir}/events.parquet"), ["user_id"], "ts", ["ts", "event_id"], "event_type", "1 day", "1 hour")
    return streams.run_to_table(stream, f"{shared_folder(spark)}/{streams.new_name()}").withColumn("flushed_at", F.col("flushed_at").cast("timestamp_ntz"))


# Texts


_BOOKS = {f"Nation_{i}": f"r{i % 5}" if i % 5 else None for i in range(25)}
_LINKED = """
WITH r AS (SELECT o_orderkey, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS name, n_nationkey AS k, month(o_orderdate) AS c, day(o_orderdate) AS v, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT *, name || ' ' || c || ':' || v AS ref, CASE WHEN k % 5 <> 0 THEN '/books/r' || (k % 5) || '/' || c || '?id=p' || v || '#p' || v END AS url FROM r)"""


def _order_texts(spark, sf_dir):
    """Orders' nations and dates as references in texts; orders in part have theirs linked already."""
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    ref = F.concat(F.initcap("n_name"), F.lit(" "), F.month("o_orderdate").cast("string"), F.lit(":"), F.day("o_orderdate").cast("string"))
    first = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit('<a href="#">'), ref, F.lit("</a>"))).otherwise(ref)
    return orders.select("o_orderkey", F.concat(F.lit("from "), first, F.lit(", see "), ref, F.lit(".")).alias("t"))


@query(f"""{_LINKED}
SELECT o_orderkey, 'from ' || CASE WHEN s = 'P' THEN '<a href="#">' || ref || '</a>' WHEN url IS NULL THEN ref ELSE '<a href="' || url || '">' || ref || '</a>' END || ', see ' ||
       CASE WHEN url IS NULL THEN ref ELSE '<a href="' || url || '">' || ref || '</a>' END || '.' AS html, url FROM t""")
def spliced_links(spark, sf_dir):
    t = F.col("t")
    return _order_texts(spark, sf_dir).select("o_orderkey", references.spliced(t, _BOOKS, "/books/").alias("html"), references.ref_url(t, _BOOKS, "/books/").alias("url"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%b %-d, %Y') AS medium, strftime(o_orderdate, '%b %-d') AS short, strftime(o_orderdate, '%b %-d, %Y, %-I:%M %p') AS timed, strftime(o_orderdate, '%A, %B %-d, %Y') AS long FROM orders""")
def shown_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *[numbers.shown_date(F.col("o_orderdate"), s).alias(s) for s in numbers.DATE_STYLES])


@query("""
SELECT p_partkey, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS kind, CASE WHEN starts_with(p_name, 'small ') THEN p_name ELSE 'small ' || p_name END AS small,
       CASE WHEN ends_with(p_name, ' bolt') THEN substr(p_name, 1, length(p_name) - 5) ELSE p_name END AS bare FROM part""")
def part_words(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.capitalised(F.col("p_type")).alias("kind"), text.with_prefix(name, "small ").alias("small"), text.without_suffix(name, " bolt").alias("bare"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) / 3)::INTEGER AS n FROM documents")
def occurrence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.occurrences(F.col("text"), "the").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS key, 'k' AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def inverted_props(spark, sf_dir):
    """Props as JSON within a string of JSON, parsed and inverted."""
    twice = F.to_json(F.struct(F.col("props").alias("v")))
    inner = text.inner_json(F.regexp_replace(twice, r'^\{"v":|\}$', ""), "map<string, string>")
    return table(spark, sf_dir, "events").select("event_id", F.inline(text.inverted(inner)))


_WORDS = "list_filter(string_split(trim(regexp_replace(lower(text), '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"""
WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark), qs AS (SELECT query_id, list(term) AS terms FROM q GROUP BY query_id),
w AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), t AS (SELECT term, doc_id, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS w FROM t GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(tf * w), 6) AS score FROM q JOIN f USING (term) JOIN t USING (term) GROUP BY ALL),
h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 3),
l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE doc_id IN (SELECT doc_id FROM h)),
p AS (SELECT doc_id, unnest(range(0, len(l)))::INTEGER AS index, unnest(l) AS text FROM l),
m AS (SELECT query_id, doc_id, rank, index, terms, {_WORDS} AS words, len(list_intersect(list_distinct({_WORDS}), terms))::INTEGER AS n_terms FROM h JOIN qs USING (query_id) JOIN p USING (doc_id)),
b AS (SELECT * FROM m WHERE n_terms > 0 QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY n_terms DESC, index) = 1)
SELECT query_id, doc_id, rank, index, n_terms, array_to_string(list_transform(words, lambda w: CASE WHEN list_contains(terms, w) THEN '<mark>' || w || '</mark>' ELSE w END), ' ') AS excerpt FROM b""")
def search_sections(spark, sf_dir):
    """The best line of each of a query's three best documents, with the query's words marked."""
    docs = table(spark, sf_dir, "documents")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    postings = search.index(docs, "doc_id", "text", queries.select("term").distinct())
    hits = search.top_documents(postings, queries, docs.count(), 3)
    return search.sub_results(hits, readers.lines(docs, "text", ["doc_id"]), queries)


@query("SELECT conv_id, 'Chapter ' || conv_id || ': ' || text AS shown_title FROM conversations WHERE turn = 0")
def chapter_titles(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("turn = 0").select("conv_id", F.col("conv_id").alias("chapter"), F.col("text").alias("title"))
    return catalog.titles(rows).select("conv_id", "shown_title")


@query("SELECT doc_id, greatest(1, ceil(len(list_filter(string_split(trim(regexp_replace(lower(text), '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' '), lambda w: w <> '')) / 200.0))::INTEGER AS minutes FROM documents")
def reading_times(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.reading_minutes(F.col("text")).alias("minutes"))


# An index that is kept


def _kept_index(spark, sf_dir) -> str:
    """An index of the documents in three segments: nine tenths, of which some have an older text, then those as they are now and the rest, and some that leave."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_folder(spark)}/index-{streams.new_name()}"
    older = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("an older text of "), F.col("text"))).otherwise(F.col("text"))
    search.add_segment(docs.filter("doc_id % 10 < 9").withColumn("text", older), path, 1)
    search.add_segment(docs.filter("doc_id % 10 in (3, 9)"), path, 2)
    search.add_segment(docs.filter("doc_id % 50 = 7"), path, 3, gone=F.lit(True))
    return path


@query(queries.SQL["search_topk"].replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 50 <> 7)"))
def kept_index_topk(spark, sf_dir):
    """search_topk over an index that was kept and updated."""
    path = _kept_index(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    postings = search.kept_postings(spark, path, asked.select("term").distinct())
    return search.top_documents(postings, asked, search.indexed(spark, path).count(), 3)


@query(f"""
WITH q AS (SELECT item_id AS query_id, list_filter({_WORDS}, lambda w: w <> '')[4:6] AS q FROM benchmark), d AS (SELECT doc_id, list_filter({_WORDS}, lambda w: w <> '') AS w FROM documents WHERE doc_id % 50 <> 7),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2)
SELECT query_id, doc_id, array_to_string(list((i - 1)::INTEGER ORDER BY i), ' ') AS places FROM g JOIN q ON q = w[i:i + 2] GROUP BY ALL""")
def kept_index_phrases(spark, sf_dir):
    """Where the fourth to sixth word of each benchmark text stand in the documents, by the places in the index."""
    path = _kept_index(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(F.slice(text.tokens(F.col("text")), 4, 3)).alias("at", "term"))
    asked = asked.join(asked.groupBy("query_id").agg(F.count("*").alias("n")).filter("n = 3").select("query_id"), "query_id", "left_semi")
    found = search.phrases(search.kept_postings(spark, path, asked.select("term").distinct()), asked)
    return found.select("query_id", "doc_id", F.array_join(F.col("places").cast("array<string>"), " ").alias("places"))

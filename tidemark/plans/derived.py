"""Queries whose nested, written or JSON inputs are derived from the given tables: layouts, entries, navigation, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import numbers, text
from tidemark.operators import align, catalog, checks, ordered, report, search, store
from tidemark.plans.registered import query, table
from tidemark.sources import readers, writers
from tidemark.sources.shared import shared_folder
from tidemark.streaming.events import new_name

# Intervals, words and characters


def _lines(spark, sf_dir):
    """Line items as intervals of an order."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("index"), F.col("l_quantity").alias("start"), F.col("l_extendedprice").alias("end"))


@query("""
SELECT l_orderkey, l_linenumber AS index, max(l_quantity) AS start, arg_max(l_extendedprice, (l_quantity, l_extendedprice)) AS end
FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def interval_lists(spark, sf_dir):
    """Line items written as a JSON list of each order and read back; the last of equal indices wins."""
    return readers.intervals(report.interval_json(_lines(spark, sf_dir), "l_orderkey"), "json", ["l_orderkey"])


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber AS index, max(l_quantity) AS start FROM lineitem GROUP BY ALL)
SELECT l_orderkey, index, start, lead(start) OVER (PARTITION BY l_orderkey ORDER BY index) AS end FROM s""")
def interval_maps(spark, sf_dir):
    """The same as JSON maps of index to start, where the next start is the end."""
    starts = _lines(spark, sf_dir).groupBy("l_orderkey", "index").agg(F.max("start").alias("start"))
    maps = starts.groupBy("l_orderkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("index").cast("string"), "start")))).alias("json"))
    return readers.intervals(maps, "json", ["l_orderkey"])


@query("""
SELECT l_orderkey, string_agg('{ index: ' || l_linenumber || ', start: ' || l_quantity || ', end: ' || l_extendedprice || ' },', chr(10) ORDER BY l_linenumber, l_quantity, l_extendedprice) AS literal
FROM lineitem GROUP BY l_orderkey""")
def interval_literals(spark, sf_dir):
    return report.interval_literal(_lines(spark, sf_dir), "l_orderkey")


@query("""
WITH s AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations WHERE role <> 'system'),
u AS (SELECT conv_id, turn, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, ws, i) - 1)::INTEGER AS pos, w AS word, (turn + 0.5)::DOUBLE AS start, (turn + 1)::DOUBLE AS end FROM u""")
def transcript_rows(spark, sf_dir):
    """Turns as a transcript's segments, those of the system without words, flattened."""
    word = lambda w: F.struct(w.alias("word"), (F.col("turn") + 0.5).cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"))
    words = F.when(F.col("role") != "system", F.transform(F.split("text", " "), word)).alias("words")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", words).alias("s"))
    segments = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("segments"))
    return readers.transcript_words(segments, ["conv_id"])


@query("""
SELECT s_suppkey, w.i::BIGINT AS pos, w.t AS word, w.a::DOUBLE AS start, (w.a + length(w.t))::DOUBLE AS end
FROM (SELECT s_suppkey, unnest([{i: 0, t: s_name, a: 0}, {i: 1, t: 'of', a: length(s_name) + 1}, {i: 2, t: n_name, a: length(s_name) + 4}]) AS w
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def spelled_words(spark, sf_dir):
    """Suppliers' names as timed characters, one a second, put together as words."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    names = table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select("s_suppkey", F.split(F.concat_ws(" of ", "s_name", "n_name"), "").alias("characters"))
    at = lambda n: F.transform("characters", lambda _, i: (i + n).cast("double"))
    rows = readers.characters(names.select("*", at(0).alias("character_start_times_seconds"), at(1).alias("character_end_times_seconds")), ["s_suppkey"])
    return align.words_of_characters(rows, "s_suppkey")


@query("""
WITH e AS (SELECT user_id, event_id, value AS a, CASE WHEN event_type = 'view' THEN value + 1 ELSE value END AS b, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events)
SELECT user_id, event_id, a, CASE WHEN b <= a THEN next ELSE b END AS b FROM e WHERE CASE WHEN b <= a THEN next ELSE b END > a""")
def closed_intervals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("a"), F.when(F.col("event_type") == "view", F.col("value") + 1).otherwise(F.col("value")).alias("b"))
    return ordered.filled_ends(rows, ["user_id"], "event_id", "a", "b")


@query("""
SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS matched, count(*) AS total, arg_max(l_quantity, (l_linenumber, l_quantity)) / count(*) AS mean_seconds
FROM lineitem GROUP BY l_orderkey""")
def match_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_quantity").alias("index"), F.col("l_quantity").alias("end"), (F.col("l_returnflag") == "R").alias("estimated"))
    return align.match_report(rows, "l_orderkey")


# Entries, bodies and pages


def _buckets(spark, sf_dir):
    """Conversations as JSON arrays of entries under keys, those of every third as text that is no array."""
    kind = F.when(F.col("role") == "user", "commitment").otherwise("reflection")
    meta = F.struct(F.col("role").alias("cardId"), F.lit(1).alias("confidence"))
    entry = F.struct(F.col("turn").cast("string").alias("id"), kind.alias("type"), F.col("conv_id").cast("string").alias("chapterId"), F.col("text").alias("content"), meta.alias("meta"))
    arrays = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(entry)).alias("json"))
    return arrays.select(F.concat(F.lit("e-"), F.col("conv_id").cast("string")).alias("key"), F.when(F.col("conv_id") % 3 == 0, F.lit("{}")).otherwise(F.col("json")).alias("value"))


@query("""
SELECT 'e-' || conv_id AS key, turn::VARCHAR AS id, text AS content, role AS card, CASE WHEN role = 'user' THEN 4 ELSE 1 END AS confidence FROM conversations WHERE conv_id % 3 <> 0""")
def confident_entries(spark, sf_dir):
    """Every entry of the buckets, with a new confidence for commitments."""
    entries = store.with_confidence(store.all_entries(_buckets(spark, sf_dir), "e-"), 4)
    return entries.select("key", "id", "content", F.col("meta.cardId").alias("card"), F.col("meta.confidence").alias("confidence"))


@query("""
SELECT CASE WHEN role = 'user' THEN 'commitment' ELSE 'reflection' END AS type, role AS card, count(*) AS n FROM conversations WHERE conv_id % 3 <> 0 GROUP BY ALL""")
def entry_identities(spark, sf_dir):
    entries = store.all_entries(_buckets(spark, sf_dir), "e-")
    return entries.groupBy(store.identity().alias("i")).agg(F.count("*").alias("n")).select("i.type", F.col("i.cardId").alias("card"), "n")


@query("""
SELECT sha256('r-' || conv_id || '-' || turn) AS id, 'reflection' AS type, conv_id::VARCHAR AS "chapterId", CASE WHEN role = 'user' THEN 'Asked' ELSE 'Prompt ' || turn END AS "promptLabel", text AS content, turn::VARCHAR AS timestamp
FROM conversations WHERE turn BETWEEN 1 AND 3 AND text <> ''""")
def migrated_entries(spark, sf_dir):
    key = F.concat_ws("-", F.lit("r"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    value = F.to_json(F.struct(F.col("text").alias("content"), F.col("turn").cast("string").alias("timestamp"), F.when(F.col("role") == "user", "Asked").alias("title")))
    return store.migrated(table(spark, sf_dir, "conversations").select(key.alias("key"), value.alias("value")), "r-")


@query("""
SELECT turn::VARCHAR AS id, CASE WHEN role = 'user' THEN 'Asked by the reader' ELSE role END AS title, conv_id::VARCHAR AS chapter_slug, text AS content FROM conversations WHERE text <> ''""")
def service_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    entries = rows.select(F.col("turn").cast("string").alias("id"), F.col("conv_id").cast("string").alias("chapterId"), F.col("role").alias("promptLabel"), F.col("text").alias("content"))
    titles = entries.filter("promptLabel = 'user'").select("chapterId", "promptLabel").distinct().withColumn("title", F.lit("Asked by the reader"))
    return store.for_service(entries, titles)


@query("SELECT user_id, event_id, value FROM events WHERE user_id % 3 < 2")
def body_rows(spark, sf_dir):
    """Events as bodies of a user: a list, an object with results, or an object without."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.collect_list(F.struct("event_id", "value"))).alias("list"))
    body = F.when(F.col("user_id") % 3 == 0, F.col("list")).when(F.col("user_id") % 3 == 1, F.concat(F.lit('{"count": 1, "results": '), F.col("list"), F.lit("}"))).otherwise('{"count": 0}')
    return rows.select("user_id", F.inline(readers.unwrapped(body, "struct<event_id: bigint, value: double>")))


@query("""
SELECT event_id, CASE event_type WHEN 'view' THEN 'user ' || user_id WHEN 'click' THEN 'a ' || user_id WHEN 'error' THEN 'kind: x; value: must be 1' ELSE 'Something went wrong' END AS message FROM events""")
def error_messages(spark, sf_dir):
    """Bodies of errors for the kinds of events: a detail, general errors, errors of fields, none."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    detail, general = F.to_json(F.struct(F.concat(F.lit("user "), user).alias("detail"))), F.to_json(F.struct(F.array(F.lit("a"), user).alias("non_field_errors")))
    body = F.when(kind == "view", detail).when(kind == "click", general).when(kind == "error", '{"value":["must be 1"],"kind":"x"}').otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", catalog.error_text(body).alias("message"))


@query("SELECT doc_id, coalesce(nullif(source, 'web'), 'none') AS layout, 'en' AS language FROM documents WHERE doc_id % 7 <> 0")
def page_defaults(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.nullif("source", F.lit("web")).alias("layout"), (F.col("doc_id") % 7 == 0).alias("excluded"))
    return readers.with_defaults(pages, {"layout": "none", "language": "en"}).drop("excluded")


@query("""
SELECT o_orderkey, '' AS errors FROM orders WHERE o_totalprice >= 1000 AND length(trim(o_orderpriority)) >= 6
UNION ALL SELECT o_orderkey, concat_ws('; ', CASE WHEN NOT coalesce(o_totalprice >= 1000, false) THEN 'price: too low' END, CASE WHEN NOT coalesce(length(trim(o_orderpriority)) >= 6, false) THEN 'priority: too short' END)
FROM orders WHERE NOT coalesce(o_totalprice >= 1000 AND length(trim(o_orderpriority)) >= 6, false)""")
def quarantined_orders(spark, sf_dir):
    rules = {"price": (F.col("o_totalprice") >= 1000, "too low"), "priority": (checks.at_least(F.col("o_orderpriority"), 6), "too short")}
    good, bad = checks.split_valid(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), rules)
    return good.select("o_orderkey", F.lit("").alias("errors")).unionByName(bad.select("o_orderkey", "errors"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def undismissed_orders(spark, sf_dir):
    dismissed = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return search.without_dismissed(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), dismissed, ["o_custkey"])


# Navigation


_MENU = ["/", ".com/en/", ".com/fr/", "page=2"]


@query(f"SELECT page_id, url AS page_url, link_url FROM pages, unnest({_MENU}) AS l(link_url) WHERE url = link_url OR (link_url <> '/' AND contains(url, link_url))")
def active_navigation(spark, sf_dir):
    return catalog.active_links(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url")), _MENU)


@query("""
WITH c AS (SELECT o_orderkey AS url, lead(o_orderkey) OVER d AS next_url, lag(o_orderkey) OVER k AS prev_url FROM orders
           WINDOW d AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), k AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT c.url, c.next_url, n.prev_url AS _back FROM c LEFT JOIN c n ON n.url = c.next_url WHERE c.next_url IS NOT NULL AND n.prev_url IS DISTINCT FROM c.url""")
def broken_navigation(spark, sf_dir):
    """A customer's orders as chapters: the next one by date, the previous one by key."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("url"))
    after = ordered.neighbours(rows, ["o_custkey"], ["o_orderdate", "url"], "url", False).withColumnRenamed("next", "next_url").drop("previous")
    both = ordered.neighbours(after, ["o_custkey"], ["url"], "url", False).withColumnRenamed("previous", "prev_url")
    return catalog.broken_links(both.select("url", "prev_url", "next_url"))


@query("""
WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INTEGER AS card FROM conversations)
SELECT conv_id, card, 'scripture' AS kind, i::INTEGER AS item, s[i] AS text, role AS detail FROM (SELECT *, string_split(text, '. ') AS s FROM c), unnest(range(1, len(s) + 1)) AS u(i)
UNION ALL SELECT conv_id, card, 'commitment', 1, role, turn::VARCHAR FROM c""")
def card_rows(spark, sf_dir):
    """Turns as cards: their sentences as scriptures, and one commitment each."""
    verses = F.transform(F.split("text", r"\. "), lambda s: F.struct(s.alias("display"), F.col("role").alias("url")))
    card = F.struct("turn", "role", "text", verses.alias("scriptures"), F.array(F.struct(F.col("role").alias("text"), F.col("turn").cast("string").alias("tier"))).alias("commitments"))
    cards = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(card)).alias("cards"))
    return catalog.card_items(cards, ["conv_id"])


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, (event_id % 7)::INTEGER AS target, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, 1 AS place FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL SELECT e.user_id, e.n, e.event_id, greatest(1, least(5, CASE e.event_type WHEN 'view' THEN w.place + 1 WHEN 'click' THEN w.place - 1 WHEN 'purchase' THEN e.target ELSE w.place END))
      FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, place FROM w WHERE n > 0""")
def walked_places(spark, sf_dir):
    """Views as steps on, clicks as steps back, purchases as jumps."""
    kind = F.col("event_type")
    action = F.when(kind == "view", "next").when(kind == "click", "back").when(kind == "purchase", "go").otherwise("stay")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", action.alias("action"), (F.col("event_id") % 7).cast("int").alias("target"))
    return catalog.replayed(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "place")


@query("""
SELECT o_orderkey, n::INTEGER AS code_no, CASE n WHEN 0 THEN o_orderstatus ELSE o_orderpriority END AS argument, CASE n WHEN 0 THEN 'key ' || o_orderkey ELSE '' END AS content FROM orders, range(2) AS r(n)""")
def shortcode_rows(spark, sf_dir):
    code = lambda name, argument, content: F.concat(F.lit(f"{{% {name} "), argument, F.lit(" %}"), content, F.lit(f"{{% end{name} %}}"))
    whole = F.concat(code("note", F.col("o_orderstatus"), F.concat(F.lit("key "), F.col("o_orderkey").cast("string"))), F.lit("\n"), code("aside", F.lit("x"), F.lit("y")), code("note", F.col("o_orderpriority"), F.lit("")))
    return catalog.shortcodes(table(spark, sf_dir, "orders").select("o_orderkey", whole.alias("t")), "t", "note").drop("t")


# Files


@query("SELECT event_id, event_type AS kind, CASE WHEN event_type = 'error' THEN -value ELSE value END AS value FROM events WHERE event_type IN ('error', 'view')")
def rewritten_buckets(spark, sf_dir):
    """All events by bucket, one bucket replaced, two read."""
    path = f"{shared_folder(spark)}/buckets-{new_name()}"
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), "value")
    writers.write_buckets(rows, path, "kind")
    writers.write_buckets(rows.filter("kind = 'error'").withColumn("value", -F.col("value")), path, "kind")
    return spark.read.parquet(path).filter(F.col("kind").isin("error", "view"))


@query("SELECT p_partkey::INTEGER AS index, p_name || '|' || p_brand AS text FROM part")
def indexed_sentences(spark, sf_dir):
    """Parts written as lines index|text, and lines without an index, read back."""
    path = f"{shared_folder(spark)}/lines-{new_name()}"
    line = F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", "p_brand")
    table(spark, sf_dir, "part").select(F.explode(F.array(line, F.col("p_name"))).alias("value")).write.text(path)
    return readers.read_indexed_sentences(spark, path)


@query("SELECT doc_id, octet_length(encode(text)) / 1048576.0::DOUBLE AS megabytes, sha256(text) AS sha FROM documents")
def decoded_bodies(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.base64(F.col("text").cast("binary")).alias("b"))
    return writers.decoded_audio(rows, "b").select("doc_id", "megabytes", F.sha2("bytes", 256).alias("sha"))


# Columns


@query("""
SELECT event_id, ((user_id + 2) % 5 + 1)::BIGINT AS ring, ts, regexp_extract(event_id || ' of ' || user_id, '^[0-9]+')::INTEGER AS number,
       ((event_id % 600) // 60 * 60 + event_id % 60)::INTEGER AS seconds, value / 1048576 AS megabytes, instr(substr(event_type, 3), 'e') - 1 + CASE WHEN contains(substr(event_type, 3), 'e') THEN 2 ELSE 0 END AS place
FROM (SELECT event_id, user_id, value, event_type, date_trunc('second', ts) AS ts FROM events)""")
def parsed_values(spark, sf_dir):
    """Ring places, times as ISO text or epoch milliseconds, leading numbers, clocks and places in texts, read back."""
    at = F.date_trunc("second", "ts").cast("timestamp")
    written = F.when(F.col("event_id") % 2 == 0, (F.unix_seconds(at) * 1000).cast("string")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    name = F.concat(F.col("event_id").cast("string"), F.lit(" of "), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        numbers.wrapped(F.col("user_id") % 5 + 1, 2, F.lit(5)).cast("long").alias("ring"),
        numbers.to_timestamp(written).cast("timestamp_ntz").alias("ts"),
        text.leading_int(name).alias("number"),
        numbers.clock_seconds(numbers.clock(F.col("event_id") % 600)).alias("seconds"),
        numbers.megabytes(F.col("value")).alias("megabytes"),
        text.find_from(F.lit("e"), F.col("event_type"), F.lit(2)).cast("long").alias("place"),
    )


@query("SELECT page_id, url_encode(url) AS part FROM pages")
def encoded_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.uri_component(F.col("url")).alias("part"))


@query("""
SELECT r_name AS region, i::INTEGER AS place, n[i].name AS nation, n[i].k AS key, 'about ' || r_name AS note
FROM (SELECT r_name, list({'name': n_name, 'k': n_nationkey} ORDER BY n_nationkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL), unnest(range(1, len(n) + 1)) AS u(i)""")
def global_data(spark, sf_dir):
    """Regions as JSON files with nested lists of their nations, written, and read as global data."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = nations.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))).alias("items"))
    path = f"{shared_folder(spark)}/globals-{new_name()}"
    lists.select("r_name", F.to_json(F.struct(F.struct(F.concat(F.lit("about "), "r_name").alias("note"), "items").alias("menu"))).alias("value")).write.partitionBy("r_name").text(path)
    data = readers.read_globals(spark, path, "r_name=([^/]+)/").withColumn("region", F.url_decode("name"))
    items = F.variant_get("data", "$.menu.items", "array<struct<key: int, name: string>>")
    rows = data.select("region", F.posexplode(items).alias("place", "i"), F.variant_get("data", "$.menu.note", "string").alias("note"))
    return rows.select("region", (F.col("place") + 1).alias("place"), F.col("i.name").alias("nation"), F.col("i.key").alias("key"), "note")


@query("""
SELECT o_orderkey, u.k AS key, u.v AS value FROM orders, unnest([
  {'k': 'title', 'v': 'Order ' || o_orderkey}, {'k': 'nav.prev.url', 'v': '/orders/' || (o_orderkey - 1)}, {'k': 'nav.prev.title', 'v': o_orderpriority}, {'k': 'nav.next', 'v': '/orders/' || (o_orderkey + 1)},
  {'k': 'tags', 'v': o_orderstatus}, {'k': 'tags', 'v': 'c' || o_custkey}, {'k': 'draft', 'v': 'false'}]) AS t(u)""")
def front_matter_rows(spark, sf_dir):
    """Orders as pages with nested keys in front, and what these say."""
    p = "\n".join(["---", "# of an order", 'title: "Order %d"', "nav:", "  prev:", "    url: /orders/%d", "    title: '%s'", "  next: /orders/%d", "tags:", "  - %s", "  - %s", "draft: false", "---", "text: none", ""])
    key = F.col("o_orderkey")
    page = F.format_string(p, key, key - 1, F.col("o_orderpriority"), key + 1, F.col("o_orderstatus"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(readers.front_matter(page)))


@query("""
SELECT o_orderkey, u.n::INTEGER AS code_no, u.d::INTEGER AS depth, u.m AS name, u.a AS argument, u.c AS content, u.s AS state FROM orders, unnest([
  {'n': 0, 'd': 0, 'm': 'note', 'a': o_orderstatus, 'c': 'key ' || o_orderkey || ' of ' || o_orderpriority || '!', 's': 'closed'},
  {'n': 1, 'd': 1, 'm': 'box', 'a': 'wide', 'c': o_orderkey || ' of ' || o_orderpriority, 's': 'closed'},
  {'n': 2, 'd': 2, 'm': 'ref', 'a': 'c' || o_custkey, 'c': NULL, 's': 'inline'},
  {'n': 3, 'd': 2, 'm': 'tip', 'a': '', 'c': o_orderpriority, 's': 'closed'},
  {'n': 4, 'd': 0, 'm': 'box', 'a': '', 'c': CASE WHEN o_orderkey % 3 = 0 THEN 'end' ELSE ' end' END, 's': CASE WHEN o_orderkey % 3 = 0 THEN 'closed' ELSE 'unclosed' END}]) AS t(u)""")
def nested_code_rows(spark, sf_dir):
    """Codes within codes, three deep, of each order; two thirds of the orders leave the last one open."""
    t = F.format_string("{%% note %s %%}key {%% box wide %%}%d {%% ref c%d %%}of {%% tip %%}%s{%% endtip %%}{%% endbox %%}!{%% endnote %%}{%% box %%}", "o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority")
    t = F.concat(t, F.when(F.col("o_orderkey") % 3 == 0, "end{% endbox %}").otherwise(" end"))
    return catalog.nested_codes(table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t")), "t", ["ref"]).drop("t")

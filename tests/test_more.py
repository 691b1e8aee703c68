"""Migrations, exports, spliced links and other functions on rows that the given tables don't have."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.functions import references, text
from tidemark.operators import catalog, ordered, report, search, store

BOOKS = {"Luke": "nt/luke", "John": None}


def test_spliced_links(spark):
    texts = ["see luke 2:4-9, then John 1:1.", '<a href="x">Luke 1:1</a> and Luke 1:2', "", None, "Luke 3:1Luke 3:2", "no reference"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    parts = rows.select("t", references.segments(F.col("t"), BOOKS, "/r/").alias("s")).collect()
    assert all("".join(p.value for p in r.s or []) == (r.t or "") for r in parts)
    html = [r[0] for r in rows.select(references.spliced(F.col("t"), BOOKS, "/r/")).collect()]
    assert html[0] == 'see <a href="/r/nt/luke/2?id=p4-p9#p4">luke 2:4-9</a>, then John 1:1.'
    assert html[1] == '<a href="x">Luke 1:1</a> and <a href="/r/nt/luke/1?id=p2#p2">Luke 1:2</a>' and html[5] == texts[5]
    assert [r[0] for r in rows.select(references.ref_url(F.col("t"), BOOKS, "/r/")).collect()][-1] is None


def test_legacy_layouts(spark):
    card = json.dumps({"1": {"commitment": "do", "tier": "seeker", "confidence": 7, "reflection": "why"}, "2": {"commitment": "", "reflection": "only this"}})
    rows = [("n-ch-1", '{"content": "hi", "chapter_slug": "one", "title": "Own"}'), ("n-ch-2", '{"content": "ho"}'), ("s_faith_ask", "text"), ("s_faith_other", "no"), ("s_hope_act", " "), ("card-ch6", card), ("card-ch7", "broken")]
    b = spark.createDataFrame(rows, "key string, value string")
    numbered = store.migrated(b, "n-").orderBy("content").collect()
    assert [(r.chapterId, r.promptLabel, r.content) for r in numbered] == [("one", "Own", "hi"), ("ch", "Prompt 2", "ho")]
    assert [(r.pathway, r.step, r.content) for r in store.migrated_steps(b, "s_", "six", ["faith", "hope"], ["ask", "act"]).collect()] == [("faith", "ask", "text")]
    cards = sorted((r.cardId, r.type, r.content, r.confidence) for r in store.migrated_cards(b, "card-").collect())
    assert cards == [("1", "commitment", "do", 7), ("1", "reflection", "why", None), ("2", "reflection", "only this", None)]
    titles = spark.createDataFrame([("ch", "Prompt 2", "What now?")], "chapterId string, promptLabel string, title string")
    assert sorted((r.title, r.chapter_slug) for r in store.for_service(store.migrated(b, "n-"), titles).collect()) == [("Own", "one"), ("What now?", "ch")]


def test_export(spark):
    at = dt.datetime(2024, 1, 2)
    entries = spark.createDataFrame([("u", "B", at, "two"), ("u", "A", at, "one"), ("u", "A", dt.datetime(2024, 1, 1), "zero")], "user string, heading string, at timestamp, content string")
    goals = spark.createDataFrame([("u", "g1", "active", at), ("u", "g2", "completed", dt.datetime(2024, 1, 3)), ("v", "g3", "active", at)], "user string, text string, status string, created timestamp")
    got = {r.user: r.report for r in report.export(entries, goals, "user", F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got["u"] == "MY ENTRIES\nExported February 1, 2024\n" + "=" * 50 + "\nA\n" + "-" * 30 + "\nJan 1, 2024: zero\nJan 2, 2024: one\n\nB\n" + "-" * 30 + "\nJan 2, 2024: two\n\nGOALS\n" + "-" * 30 + "\n[COMPLETED] g2\n[ACTIVE] g1"
    assert got["v"].endswith("[ACTIVE] g3")


def test_shortcodes_and_inner_json(spark):
    t = '{% sentence 3 %}One\ntwo.{% endsentence %} x {%- sentence 4 -%}Three{%- endsentence -%}'
    rows = catalog.shortcodes(spark.createDataFrame([(1, t)], "k int, t string"), "t", "sentence").orderBy("code_no").collect()
    assert [(r.argument, r.content) for r in rows] == [("3", "One\ntwo."), ("4", "Three")]
    inner = [json.dumps(json.dumps({"a": "1"})), json.dumps({"a": "2"}), "broken", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in inner], "t string").select(text.inner_json(F.col("t"), "map<string, string>")).collect()]
    assert got[:2] == [{"a": "1"}, {"a": "2"}] and got[3] is None


def test_passages_as_whole_words(spark):
    docs = spark.createDataFrame([(1, "Some part of the deep season here"), (2, "art of  the deep"), (3, None)], "doc_id int, text string")
    passages = spark.createDataFrame([(1, "art of the deep sea"), (2, "art of the"), (3, "DEEP"), (4, " "), (5, "part of the deep season")], "item_id int, text string")
    assert sorted(tuple(r) for r in search.located(passages, docs, "item_id", "doc_id").collect()) == [(2, 2, 1), (3, 1, 18), (3, 2, 12), (5, 1, 6)]


def test_orders(spark):
    rows = spark.createDataFrame([(1, "7"), (2, None), (3, "?"), (4, "-1"), (5, "10")], "i int, n string")
    assert [r.i for r in rows.orderBy(*ordered.by_number("n", "i")).collect()] == [4, 2, 1, 5, 3]
    assert sorted(r.i for r in rows.orderBy(*ordered.shuffled("i", 3)).collect()) == [1, 2, 3, 4, 5]
    assert [r.i for r in rows.orderBy(*ordered.chosen_first(F.col("n") > "5", "i")).collect()][0] == 1


def test_walks_of_many_keys(spark):
    """Each reader's own steps alone count, however rows lie."""
    rows = [(k, i, "next" if (k + i) % 3 else "back", None) for k in range(40) for i in range(30)]
    got = {(r.k, r.n): r.place for r in catalog.replayed(spark.createDataFrame(rows, "k int, n int, action string, target int").repartition(5), ["k"], ["n"]).collect()}
    for k in range(40):
        at = 1
        for i in range(30):
            at = max(1, min(5, at + (1 if (k + i) % 3 else -1)))
            assert got[k, i] == at


def test_linking_takes_time_in_proportion(spark):
    """As many references in long texts as in short ones take about as long: the text isn't matched again for each of them."""
    import time

    took = {}
    for each in (10, 10, 160):
        rows = spark.range(3200 // each).select(F.repeat(F.lit("see Luke 2:4, "), each).alias("t")).repartition(1).cache()
        rows.count()
        began = time.perf_counter()
        n = rows.select(F.regexp_count(references.spliced(F.col("t"), BOOKS, "/r/"), F.lit("<a ")).alias("n")).agg(F.sum("n")).first()[0]
        took[each] = time.perf_counter() - began
        assert n == 3200
    assert took[160] < 4 * took[10] + 1

"""Nested collections, navigation and words from characters."""

from pyspark.sql import functions as F

from tidemark.operators import align, catalog


def test_tracks(spark):
    kind = "chapter int, title string, url string, audio struct<testimony: struct<file: string, title: string, alternates: array<struct<file: string, label: string>>>>"
    rows = [(2, "Two", "/2", (("b.mp3", None, [("b2.mp3", "live"), ("b3.mp3", None)]),)), (1, "One", "/1", (("a.mp3", "Song", None),)), (3, "Three", "/3", None), (4, "Four", "/4", (("", None, []),))]
    got = catalog.tracks(spark.createDataFrame(rows, kind)).orderBy("number").collect()
    assert [(r.number, r.file, r.label) for r in got] == [(1, "a.mp3", "Song"), (2, "b.mp3", "Two"), (3, "b2.mp3", "live"), (4, "b3.mp3", "")]


def test_cards(spark):
    kind = "slug string, cards array<struct<title: string, scriptures: array<struct<display: string, url: string>>, commitments: array<struct<text: string, tier: string>>>>"
    got = catalog.card_items(spark.createDataFrame([("s", [("a", [("x", "u"), ("y", "v")], []), ("b", None, [("do", "seeker")])])], kind), ["slug"])
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(1, "scripture", 1, "x", "u"), (1, "scripture", 2, "y", "v"), (2, "commitment", 1, "do", "seeker")]


def test_links(spark):
    pages, links = spark.createDataFrame([("/",), ("/read/one/",)], "page_url string"), ["/", "/read/"]
    assert sorted(tuple(r) for r in catalog.active_links(pages, links).collect()) == [("/", "/"), ("/read/one/", "/read/")]
    assert [tuple(r) for r in catalog.active_links(pages, links, "equal").collect()] == [("/", "/")]
    chain = spark.createDataFrame([("a", None, "b"), ("b", "a", "c"), ("c", "x", None)], "url string, prev_url string, next_url string")
    assert [r.url for r in catalog.broken_links(chain).collect()] == ["b"]


def test_navigation(spark):
    steps = [("back", None), ("next", None), ("next", None), ("go", 5), ("next", None), ("back", None)]
    rows = spark.createDataFrame([("k", i, a, t) for i, (a, t) in enumerate(steps)], "k string, n int, action string, target int")
    assert [r.place for r in catalog.replayed(rows, ["k"], ["n"]).orderBy("n").collect()] == [1, 2, 3, 5, 5, 4]


def test_error_text(spark):
    rows = ['{"detail": "no"}', '{"non_field_errors": ["a", "b"]}', '{"email": ["bad", "worse"], "name": "short"}', "broken", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "b string").select(catalog.error_text(F.col("b"))).collect()]
    assert got == ["no", "a b", "email: bad; name: short", "Something went wrong", "Something went wrong"]


def test_words_of_characters(spark):
    rows = [("c", i, ch, i * 0.1, i * 0.1 + 0.1) for i, ch in enumerate("ab  cd e")]
    got = align.words_of_characters(spark.createDataFrame(rows, "chapter_id string, pos int, character string, start double, end double")).orderBy("start").collect()
    assert [(r.word, round(r.start, 1), round(r.end, 1)) for r in got] == [("ab", 0.0, 0.2), ("cd", 0.4, 0.6), ("e", 0.7, 0.8)]


def test_nested_codes(spark):
    """Codes in codes, inline ones, and texts whose codes don't match."""
    rows = [
        ("deep", "a{% note x %}b{% box %}c{% ref 1:2 %}d{% tip %}e{% endtip %}{% endbox %}f{% endnote %}g"),
        ("cross", "{% note %}a{% box %}b{% endnote %}c{% endbox %}"),
        ("open", "x{%- note 'q' -%}y{% ref %}"),
        ("stray", "{% endnote %}text{% note %}{% endnote %}"),
        ("twice", "{% note 1 %}a{% note 2 %}b{% endnote %}c{% endnote %}"),
        ("none", "no codes { % note % }"), ("null", None), ("broken", "{% note"),
    ]
    out = catalog.nested_codes(spark.createDataFrame(rows, "id string, t string"), "t", ["ref"]).orderBy("id", "code_no").collect()
    got = {}
    for r in out:
        got.setdefault(r.id, []).append((r.code_no, r.depth, r.name, r.argument, r.content, r.state))
    assert got == {
        "deep": [(0, 0, "note", "x", "bcdef", "closed"), (1, 1, "box", "", "cde", "closed"), (2, 2, "ref", "1:2", None, "inline"), (3, 2, "tip", "", "e", "closed")],
        "cross": [(0, 0, "note", "", "ab", "closed"), (1, 1, "box", "", "b", "unclosed"), (2, 0, "box", None, None, "stray")],
        "open": [(0, 0, "note", "'q'", "y", "unclosed"), (1, 1, "ref", "", None, "inline")],
        "stray": [(0, 0, "note", None, None, "stray"), (1, 0, "note", "", "", "closed")],
        "twice": [(0, 0, "note", "1", "abc", "closed"), (1, 1, "note", "2", "b", "closed")],
    }

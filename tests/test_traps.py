"""Cases that are easily got wrong, on rows made by hand."""

import difflib
import html.parser
import random
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers, references, text
from tidemark.operators import align, asof, checks, ordered, pages, report, search, store
from tidemark.sources import readers, writers

from .test_align import timed


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column).first()[0]


def test_prefix_scan_stops_where_time_goes_back(spark):
    marks = spark.createDataFrame([("c", i, t) for i, t in ((126, 770.0), (127, 779.44), (128, 776.54), (129, 782.0))], "c string, index int, t double")
    probe = spark.createDataFrame([("c", 777.0), ("c", 1.0)], "c string, t double")
    assert [r.mark_index for r in asof.asof(probe, marks, ["c"], "t", "index", ["index"], "prefix").orderBy("t").collect()] == [None, 126]
    assert [r.mark_index for r in asof.asof(probe, marks, ["c"], "t", "index", ["index"]).orderBy("t").collect()] == [None, 128]


def test_asof_equals_a_scan(spark):
    draw = random.Random(3)
    marks = [(k, i, float(draw.randint(0, 40))) for k in "ab" for i in range(30)]
    probes = [(k, i, draw.random() * 45 - 2) for k in "abc" for i in range(40)]
    m, p = spark.createDataFrame(marks, "k string, i int, t double"), spark.createDataFrame(probes, "k string, n int, t double")

    def scan(k, t):
        last = None
        for kk, i, s in marks:
            if kk == k:
                if s > t:
                    break
                last = i
        return last

    def true(k, t):
        return max(((s, i) for kk, i, s in marks if kk == k and s <= t), default=(0, None))[1]

    for strategy, want in (("prefix", scan), ("asof", true)):
        got = {(r.k, r.n): r.mark_i for r in asof.asof(p, m, ["k"], "t", "i", ["i"], strategy).collect()}
        assert got == {(k, n): want(k, t) for k, n, t in probes}


@pytest.mark.parametrize("slug,title", [("01-introduction", "Introduction"), ("chapter-01-the-iron-rod", "The Iron Rod"), ("", ""), ("NASA-and-us", "NASA And Us"), (None, None)])
def test_titles(spark, slug, title):
    assert spark.createDataFrame([(slug,)], "s string").select(text.title_of(F.col("s"))).first()[0] == title


def test_small_functions(spark):
    assert one(spark, text.initials(F.col("a")), a="  ada  king lovelace ") == "AK" and one(spark, text.initials(F.col("a")), a="  ") == "?"
    assert one(spark, text.padded(F.col("a")), a=123) == "123" and one(spark, text.padded(F.col("a")), a=7) == "07"
    assert one(spark, text.label(F.col("a")), a="x" * 81) == "x" * 77 + "…" and one(spark, text.label(F.col("a")), a="x" * 80) == "x" * 80
    assert one(spark, text.escaped(F.col("a")), a="<a&b>") == "&lt;a&amp;b&gt;"
    assert one(spark, text.uri_component(F.col("a")), a="a b&c!~") == "a%20b%26c!~"
    assert one(spark, text.find_from(F.lit("b"), F.col("a"), F.lit(2)), a="abcb") == 3 and one(spark, text.find_from(F.lit("z"), F.col("a"), F.lit(0)), a="abc") == -1
    assert one(spark, text.leading_int(F.col("a")), a="12abc") == 12 and one(spark, text.leading_int(F.col("a")), a="abc") is None
    assert one(spark, text.last_items(F.split("a", " "), 3), a="x y") == ["x", "y"]
    assert one(spark, text.normalise_words(F.col("a")), a="Évé—x,  Y") == "évéx y"
    assert one(spark, text.first_of(F.col("a"), F.col("b")), a="", b="0") == "0"
    assert one(spark, numbers.clock(F.col("a")), a=float("nan")) == "0:00" and one(spark, numbers.clock(F.col("a")), a=125.9) == "2:05"
    assert one(spark, numbers.clock_seconds(F.col("a")), a="3:07") == 187 and one(spark, numbers.clock_seconds(F.col("a")), a="x") is None
    assert one(spark, numbers.wrapped(F.col("a"), 1, F.lit(5)), a=5) == 1 and one(spark, numbers.wrapped(F.col("a"), -1, F.lit(5)), a=1) == 5
    assert one(spark, numbers.percent(F.col("a"), F.lit(200)), a=101) == 51 and one(spark, numbers.percent(F.col("a"), F.lit(0)), a=1) == 0
    assert one(spark, numbers.to_timestamp(F.col("a")), a="1700000000000") == one(spark, numbers.to_timestamp(F.col("a")), a="2023-11-14T22:13:20Z")
    assert one(spark, readers.narration(F.col("a")), a="head============body") == "body" and one(spark, readers.narration(F.col("a")), a="all") == "all"


NAMES = ["John", "1 John", "1 Nephi", "1 Ne", "D&C", "Matthew", "Luke"]


@pytest.mark.parametrize(
    "words,dialect,want",
    [
        ("see D&C 93:1.", "loose", [("D&C", 93, 1, None)]),
        ("1 Ne 3:7 and 1 John 2:1", "strict", [("1 Ne", 3, 7, None), ("1 John", 2, 1, None)]),
        ("Matthew 5:3-12", "strict", [("Matthew", 5, 3, 12)]),
        ("Matthew 5:3–12", "inline", [("Matthew", 5, 3, 12)]),
        ("Matthew 5:3—12", "loose", [("Matthew", 5, 3, 12)]),
        ("Matthew 5:3—12", "strict", [("Matthew", 5, 3, None)]),
        ("John3:16", "loose", [("John", 3, 16, None)]),
        ("John3:16", "strict", []),
        ("John 3:16, 18", "loose", [("John", 3, 16, None)]),
        ("nothing", "loose", []),
    ],
)
def test_references(spark, words, dialect, want):
    rows = references.extracted(spark.createDataFrame([(words,)], "t string"), "t", NAMES, dialect).orderBy("ref_no").collect()
    assert [(r["name"], r.chapter, r.verse, r.last_verse) for r in rows] == want


def test_reference_links(spark):
    books = spark.createDataFrame([("Luke", "nt/luke")], "name string, path string")
    rows = references.linked(spark.createDataFrame([("luke 2:4-4; Luke 2:4-9; John 1:1",)], "t string"), "t", books, NAMES, "/study/scriptures/", "strict").orderBy("ref_no").collect()
    assert [r.url for r in rows] == ["/study/scriptures/nt/luke/2?id=p4#p4", "/study/scriptures/nt/luke/2?id=p4-p9#p4-p9", None]
    # what lies between the matches and the matches make up the text
    t, at = "luke 2:4-4; Luke 2:4-9; John 1:1", 0
    for r in rows:
        at = t.index(r.matched, at) + len(r.matched)
    assert at == len(t)


def test_upsert_keeps_the_first_id_and_is_idempotent(spark):
    a = spark.createDataFrame([("x", 1, 10, "old"), ("y", 2, 11, "keep")], "k string, id int, at int, v string")
    b = spark.createDataFrame([("x", 7, 20, "new"), ("z", 8, 21, "add")], "k string, id int, at int, v string")
    once = store.upserted(a, b, ["k"], ["at"], "id", ["at", "v"])
    rows = {r.k: (r.id, r.v) for r in once.collect()}
    assert rows == {"x": (1, "new"), "y": (2, "keep"), "z": (8, "add")}
    again = store.upserted(once.select("k", "id", "at", "v"), b, ["k"], ["at"], "id", ["at", "v"])
    assert {r.k: (r.id, r.v) for r in again.collect()} == rows


def test_progress_takes_the_further_place_whatever_its_time(spark):
    kind = "k int, position int, sentence string, bookmark string"
    local = spark.createDataFrame([(1, 10, "l", "here"), (2, 90, "l", ""), (3, 5, "l", None), (4, None, "l", None)], kind)
    remote = spark.createDataFrame([(1, 50, "r", "there"), (2, 50, "r", "there"), (5, 1, "r", "x"), (4, 0, "r", None)], kind)
    rows = {r.k: tuple(r)[1:] for r in store.merged_progress(local, remote, ["k"]).collect()}
    assert rows == {1: (50, "r", "here"), 2: (90, "l", "there"), 3: (5, "l", None), 4: (0, "r", None), 5: (1, "r", "x")}


def test_store(spark):
    e = "id string, type string, meta struct<cardId: string, confidence: int>"
    rows = spark.createDataFrame([("1", "commitment", ("a", 1)), ("1", "reflection", ("a", 1)), (None, "commitment", None)], e)
    assert store.deleted(rows, "id", "1").count() == 1
    assert [r.meta.confidence if r.meta else None for r in store.with_confidence(rows, 9).collect()] == [9, 1, None]
    b = spark.createDataFrame([("notes-ch-1-2", '{"content": "hi", "timestamp": "t"}'), ("notes-ch-1-3", "{broken"), ("notes-ch-1", '[{"id": "9", "type": "reflection"}]'), ("other", "[]")], "key string, value string")
    assert [(r.chapterId, r.promptLabel, r.content) for r in store.migrated(b, "notes-").collect()] == [("ch-1", "Prompt 2", "hi")]
    assert [r.id for r in store.all_entries(b, "notes-").collect()] == ["9"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one\n\n two \r\n")
    assert [(r.chapter_id, r["index"], r.text) for r in readers.read_sentences(spark, str(tmp_path / "a.txt")).orderBy("index").collect()] == [("a", 0, "one"), ("a", 1, "two")]
    (tmp_path / "b.txt").write_text("3|x|y\nno\n4|z\n")
    assert [(r["index"], r.text) for r in readers.read_indexed_sentences(spark, str(tmp_path / "b.txt")).orderBy("index").collect()] == [(3, "x|y"), (4, "z")]
    j = spark.createDataFrame([(1, '[{"index": 0, "start": 1.0, "end": 2.0}, {"index": 0, "start": 1.5, "end": 2.5}]'), (2, '{"10": 5.0, "2": 1.0}')], "k int, j string")
    assert sorted(tuple(r) for r in readers.intervals(j, "j", ["k"]).collect() if r.end) == [(1, 0, 1.5, 2.5), (2, 2, 1.0, 5.0)]
    body = spark.createDataFrame([('[{"id": 1}]',), ('{"results": [{"id": 2}], "next": "u"}',), ("null",), (None,)], "b string")
    assert [[x.id for x in r[0]] for r in body.select(readers.unwrapped(F.col("b"), "struct<id: long>")).collect()] == [[1], [2], [], []]
    words = spark.createDataFrame([(1, [([("a", 0.0, 1.0)],), (None,), ([("b", 1.0, 2.0)],)])], "k int, segments array<struct<words: array<struct<word: string, start: double, end: double>>>>")
    assert [(r.pos, r.word) for r in readers.transcript_words(words, ["k"]).orderBy("pos").collect()] == [(0, "a"), (1, "b")]
    chars = spark.createDataFrame([(1, ["a", "b"], [0.0, 1.0], [1.0, 2.0]), (2, [], [], []), (3, ["a"], None, None)], f"k int, {readers.CHARACTERS}")
    assert [(r.k, r.character, r.end) for r in readers.characters(chars, ["k"]).orderBy("pos").collect()] == [(1, "a", 1.0), (1, "b", 2.0)]
    (tmp_path / "l.txt").write_text("0.0\t0.0\tfirst\n2.5\t3.0\tsecond\n4.0\t4.0\tlast\n")
    labels = ordered.filled_ends(readers.read_labels(spark, str(tmp_path / "l.txt")), ["file"], "line", "start", "end")
    assert [(r.start, r.end, r.label) for r in labels.orderBy("line").collect()] == [(0.0, 2.5, "first"), (2.5, 3.0, "second")]
    front = spark.createDataFrame([(1, None, None), (2, "own", True), (3, "own", False)], "k int, layout string, excluded boolean")
    assert [(r.k, r.layout, r.tag) for r in readers.with_defaults(front, {"layout": "base", "tag": "t"}).orderBy("k").collect()] == [(1, "base", "t"), (3, "own", "t")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("c", 1, 1.5, 2.0), ("c", 0, 0.0, 1.5)], "chapter_id string, index int, start double, end double")
    writers.write_interval_json(rows, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '[{"index":0,"start":0.0,"end":1.5},{"index":1,"start":1.5,"end":2.0}]'
    writers.write_interval_literals(rows, str(tmp_path / "l"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "l")).collect()] == ["{ index: 0, start: 0.0, end: 1.5 },", "{ index: 1, start: 1.5, end: 2.0 },"]
    for content in ("a", "b"):
        writers.write_buckets(spark.createDataFrame([(content, content), ("same", content)], "chapterId string, v string"), str(tmp_path / "b"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "b")).select("chapterId", "v").collect()) == [("a", "a"), ("b", "b"), ("same", "b")]


@pytest.mark.parametrize("strategy", align.STRATEGIES)
def test_alignment_finds_plain_sentences(strategy):
    words = [(w, i * 1.0, i + 0.5) for i, w in enumerate("in the beginning there was a word and the word was long and it went on and on".split())]
    got = timed([(0, "In the beginning, there was a word"), (1, "and the word was long"), (2, "zzz qqq"), (3, "and it went on and on")], words, strategy)
    spans = {r["index"]: (r["start"], r["end"]) for r in got if not r["estimated"]}
    assert spans[0] == (0.0, 6.5) and spans[1] == (7.0, 11.5) and spans[3] == (12.0, 17.5)
    assert [r["index"] for r in got] == [0, 1, 2, 3] and got[2]["estimated"] and got[2]["start"] == 11.5


def test_alignment_of_missing_first_sentences():
    words = [("hello", 1.0, 2.0), ("there", 2.0, 3.0)]
    for strategy in align.STRATEGIES:
        got = timed([(0, "qqqq"), (1, "hello there")], words, strategy)
        assert [r["index"] for r in got] == ([0, 1] if strategy == "fuzzy" else [1])


@pytest.mark.parametrize("said, heard", [("moroni buried nephite records", "maroni berried nefite record"), ("christs atonement heals everyone", "christ atonements heal every one"), ("remember", "remembers")])
def test_fuzzy_alignment_of_misspelt_words(said, heard):
    words = [(w, i * 1.0, i + 0.5) for i, w in enumerate(f"some other talk {heard} quite unlike".split())]
    got = timed([(0, said)], words, "fuzzy")
    assert [(r["start"], r["end"], r["estimated"]) for r in got] == [(3.0, 2.5 + len(heard.split()), False)]


def test_fuzzy_alignment_tries_all_windows():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcde") for _ in range(draw.randint(1, 6))) for _ in range(30)]
    for _ in range(60):
        words = draw.choices(vocabulary, k=draw.randint(1, 40))
        sentence = ["".join(draw.choice("abcde") if draw.random() < 0.2 else c for c in w) for w in words[draw.randrange(len(words)) :][: draw.randint(1, 6)]]
        best, want = 0.7, None
        for i in range(len(words)):
            for n in range(max(1, len(sentence) - 2), len(sentence) + 5):
                if i + n <= len(words) and (r := difflib.SequenceMatcher(None, " ".join(sentence), " ".join(words[i : i + n])).ratio()) > best:
                    best, want = r, (i, i + n - 1)
        assert list(align.by_ratio([" ".join(sentence)], words)) == [want]


def walked(spark, texts, **scope):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, html string").select("id", pages.nodes(F.col("html"), **scope).alias("n"))
    return [r.n for r in rows.orderBy("id").collect()]


def test_page_text(spark):
    page = '<body><p>a &amp; b<script>x<</script><a href=1>link</a></p><div data-s><p>in<br>side</p><i data-no>out</i></div><pre>p</pre>tail'
    assert walked(spark, [page, None, "", " "]) == [["a &amp; b", "in", "side", "out", "tail"], [], [], []]
    assert walked(spark, [page], body="data-s", ignore="data-no") == [["in", "side"]]
    rows = pages.with_text(spark.createDataFrame([(page, "x")], "html string, text string"))
    assert [tuple(r) for r in rows.collect()] == [(page, "a & b in side out tail")]


def test_pages_that_are_not_well_formed(spark):
    for page, want in (
        ("x<a>y</b>z</a>w", ["x", "w"]),  # an end tag without its start closes nothing
        ("<div><a>x</div>y", ["y"]),  # an end tag closes what is open within
        ("x<a/>y<A HREF='>'>z</A >w<pre", ["x", "y", "w"]),
        ("<!-- <a> -->x<!-- y", ["x"]),
        ("a < b <1> c <", ["a < b <1> c <"]),
        ('<p title="<a>">x</p></a>y', ["x", "y"]),
        ("<style>x<b></style >y<script src=1>z</scriptx>w", ["y"]),
        ("x\u00a0<b>\u00a0\u2003</b>&nbsp;y", ["x\u00a0", "&nbsp;y"]),
        ("<abbr>x</abbr><article>y</article>", ["x", "y"]),
    ):
        assert walked(spark, [page]) == [want], page
    assert walked(spark, ["<script>x<b>y</b></script>z"], excluded=()) == [["x<b>y</b>", "z"]]
    assert walked(spark, ["<p id='data-no'>x</p><p class=data-no>y</p><p DATA-NO>z</p><p data-not>w"], ignore="data-no") == [["x", "y", "w"]]


def test_pages_as_a_parser_reads_them(spark):
    """Random trees, with elements that are left open, against a walk of the standard library's parser."""

    class Plain(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.open, self.out = [], []

        def handle_starttag(self, tag, attrs):
            if tag not in pages.VOID:
                self.open.append((tag, tag in pages.EXCLUDED or "n" in dict(attrs), "s" in dict(attrs)))

        def handle_endtag(self, tag):
            at = max((i for i, x in enumerate(self.open) if x[0] == tag), default=len(self.open))
            del self.open[at:]

        def handle_data(self, data):
            if data.strip() and not any(x[1] for x in self.open) and any(x[2] for x in self.open):
                self.out.append(data)

    draw, texts, want = random.Random(4), [], []
    for size in [3, 10, 40, pages.BLOCK - 1, pages.BLOCK, 2 * pages.BLOCK + 3] * 8:
        parts = [draw.choice(["x", "yz ", " ", "<!--c-->", "<br>", "<!doctype html>"] + [f"<{draw.choice('/ /').strip()}{t}>" for t in ("p", "div", "a", "pre", "b")] + ["<p s>", '<div n="1">', "<div s='>'>", "</p>", "</div>"]) for _ in range(size)]
        page = re.sub("(x|yz | )+", lambda m: m[0], "".join(parts))
        parser = Plain()
        parser.feed(page + "<i>")
        texts.append(page)
        want.append(parser.out)
    assert walked(spark, texts, body="s", ignore="n") == want


def test_hostile_pages_are_read_once(spark):
    n = 200_000
    texts = ["<a " * n, '<a b="' * n, "<!--" * n, "<script>" * n, "<" * n, "<a b='c" + '"' * n, "<p>x</p>" * 20_000, "</p>" * n]
    began = time.time()
    assert [len(x) for x in walked(spark, texts)] == [0, 0, 0, 0, 1, 0, 20_000, 0] and time.time() - began < 60


def test_debounce_and_changes(spark):
    t0 = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, i, t0 + timedelta(seconds=s), v) for i, (s, v) in enumerate([(0, "a"), (1, "ab"), (3, "abc"), (10, ""), (11, " "), (20, "z")])], "k int, n int, ts timestamp, v string")
    got = ordered.debounced(rows, ["k"], "ts", "v", "2 seconds", F.trim("v") == "").orderBy("last_at").collect()
    assert [r.v for r in got] == ["abc", "z"]  # a gap of exactly two seconds joins
    c = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, None, "a", "a", None, "b"])], "k int, n int, v string")
    assert [r.n for r in ordered.changes(c, ["k"], ["n"], "v").orderBy("n").collect()] == [0, 2, 4, 5]


def test_reports_and_checks(spark):
    rows = spark.createDataFrame([("a", 1, "x"), (None, 2, "y"), ("", 3, None)], "g string, t int, k string")
    assert {r.g: (r.n, r.latest) for r in report.by_group(rows, "g", "t").collect()} == {"a": (1, 1), "unknown": (2, 3)}
    assert report.summary(rows.withColumn("one", F.lit(1)), ["one"], "k", "t").first().n_kinds == 3
    good, bad = checks.split_valid(rows, {"g": (checks.required(F.col("g")), "required"), "k": (checks.at_least(F.col("k"), 1), "short")})
    assert good.count() == 1 and sorted(r.errors for r in bad.collect()) == ["g: required", "g: required; k: short"]


def test_search_dismissed(spark):
    hits, gone = spark.createDataFrame([(1, 2), (1, 3)], "q int, d int"), spark.createDataFrame([(1, 3)], "q int, d int")
    assert [r.d for r in search.without_dismissed(hits, gone, ["q", "d"]).collect()] == [2]

"""Front matter, global data and jobs on files as they come, whole and broken."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.sources import readers


@pytest.mark.parametrize(
    "page, want, rest",
    [
        ("---\ntitle: A b\nn: 1\n---\nbody\n---\nmore", [("title", "A b"), ("n", "1")], "body\n---\nmore"),
        ("---\r\na: 'x: y'\r\nb:\r\n  c: \"q\"\r\n  d:\r\n    e: 1\r\nf: 2\r\n---\r\nt", [("a", "x: y"), ("b.c", "q"), ("b.d.e", "1"), ("f", "2")], "t"),
        ("---\nl:\n  - one\n  - two: x\nm:\n- three\nz: http://a:1/b\n---\n", [("l", "one"), ("l", "two: x"), ("m", "three"), ("z", "http://a:1/b")], ""),
        ("---\n---\nonly text", [], "only text"),
        ("---\n# note\nno key here\n  \nk:\nv: 'it''s'\n---", [("v", "it''s")], ""),
        ("no front", None, "no front"),
        ("\n---\na: 1\n---\n", None, "\n---\na: 1\n---\n"),
        ("---\na: 1\nnever closed", None, "---\na: 1\nnever closed"),
        ("", None, ""),
        (None, None, None),
    ],
)
def test_front_matter(spark, page, want, rest):
    r = spark.createDataFrame([(page,)], "t string").select(readers.front_matter(F.col("t")).alias("m"), readers.page_text(F.col("t")).alias("rest")).first()
    assert (r.m if r.m is None else [tuple(x) for x in r.m]) == want and r.rest == rest


def test_global_data(spark, tmp_path):
    (tmp_path / "site.json").write_text('{"a": {"b": [1, "x"]}, "title": "T"}')
    (tmp_path / "broken.json").write_text('{"a": ')
    (tmp_path / "list.json").write_text("[1, 2]")
    rows = {r.name: r for r in readers.read_globals(spark, str(tmp_path)).select("name", F.col("data").isNull().alias("none"), F.try_variant_get("data", "$.a.b[1]", "string").alias("x"), F.try_variant_get("data", "$[0]", "int").alias("first")).collect()}
    assert rows["site"].x == "x" and rows["broken"].none and rows["list"].first == 1 and not rows["list"].none and len(rows) == 3


def intervals(path):
    return {p.parent.name.removeprefix("chapter_id="): p.read_text().strip() for p in path.glob("chapter_id=*/part-*.txt")}


def test_jobs(spark, tmp_path):
    for name in ("said", "spelled", "heard", "marks"):
        (tmp_path / name).mkdir()
    text = "Hello there you. Good day now"
    (tmp_path / "said" / "one.txt").write_text("Hello there you.\n\nGood day now\n")
    starts = [i / 10 for i in range(len(text))]
    (tmp_path / "spelled" / "one.json").write_text(json.dumps({"characters": list(text), "character_start_times_seconds": starts, "character_end_times_seconds": [s + 0.1 for s in starts]}, indent=1))
    words = [{"word": w, "start": i, "end": i + 0.5} for i, w in enumerate(text.split())]
    (tmp_path / "heard" / "one.json").write_text(json.dumps({"segments": [{"words": words[:2]}, {}, {"words": words[2:]}]}))
    (tmp_path / "marks" / "one.txt").write_text("0.0\t1.5\ta\r\n2.0\t2.0\tb\n3.5\t4.0\tc\nbad line\n")
    path = lambda *x: [str(tmp_path / n) for n in x]
    assert jobs.main(["characters", *path("spelled", "said", "out1")]) == 0
    assert json.loads(intervals(tmp_path / "out1")["one"]) == [{"index": 0, "start": 0.0, "end": 1.6}, {"index": 1, "start": 1.7, "end": 2.9}]
    for strategy in ([], ["subsequence"]):
        assert jobs.main(["transcript", *path("heard", "said", f"out2{len(strategy)}"), *strategy]) == 0
        assert json.loads(intervals(tmp_path / f"out2{len(strategy)}")["one"]) == [{"index": 0, "start": 0.0, "end": 2.5}, {"index": 1, "start": 3.0, "end": 5.5}]
    assert jobs.main(["labels", *path("marks", "out3")]) == 0
    assert intervals(tmp_path / "out3")["one"].splitlines() == ["{ index: 0, start: 0.0, end: 1.5 },", "{ index: 1, start: 2.0, end: 3.5 },", "{ index: 2, start: 3.5, end: 4.0 },"]
    assert jobs.main(["query", "activity_by_type", "/root/testdata/sf0.001", str(tmp_path / "out4")]) == 0 and spark.read.parquet(str(tmp_path / "out4")).count() > 0
    assert jobs.main([]) == jobs.main(["nothing"]) == jobs.main(["labels", "x"]) == 2

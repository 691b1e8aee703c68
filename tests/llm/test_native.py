"""Exact dedup, quality rules and mixing: against SQL, and on hard rows."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard_join, mixing, quality_rules, registry, sentence_pieces

from .conftest import HARD


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = con.sql(registry.SQL[name])
    at = [found.columns.index(c) for c in columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


@pytest.mark.parametrize("range_rows", [exact_dedup.RANGE_ROWS, 4])
def test_exact_groups(spark, hard, none, range_rows):
    more = [(1, "same text here"), (1, "same text here"), (1, "same  text here"), (1, "same  text here"), (None, "alone"), (None, "alone"), (11, "alone")]
    rows = [(i, t) for i, t, *_ in HARD] + more
    docs = hard.select("doc_id", "text", F.lit(1).alias("_id"), F.lit(2).alias("_sha"), F.lit(3).alias("kept"), F.lit(4).alias("_range"))
    docs = docs.unionByName(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in more], docs.schema))
    groups = defaultdict(list)
    for at, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, at, i))
    want, stay = [], []
    for at, (i, t) in enumerate(rows):
        s = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[s])
        want.append((i, keep[4], len(groups[s]), at == keep[3], hashlib.sha256(s.encode()).hexdigest()))
        stay += [(i, t)] if at == keep[3] else []
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, range_rows).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_groups(none, range_rows).count() == 0 and exact_dedup.drop_copies(none, range_rows).count() == 0
    kept = exact_dedup.drop_copies(docs, range_rows)
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, len(r.text or "")) for r in kept.collect()], key=repr) == sorted([(i, len(t or "")) for i, t in stay], key=repr)


def test_rows_that_pass_the_filter_never_shuffle(docs, monkeypatch):
    """Neither the test nor what leaves it has an exchange but broadcasts, with one range or many."""
    rows = docs.select("doc_id", exact_dedup.digest(docs).alias("s"))
    for range_rows in (exact_dedup.RANGE_ROWS, 50):
        ranges, blocks = exact_dedup.ranges_of(200, range_rows)
        rows_ = exact_dedup.placed(rows, "s", ranges, blocks)
        plan = exact_dedup.tested(rows_.filter("_range = 0"), exact_dedup.written(exact_dedup.repeated_bits(rows_, "s")), "s")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan and "Python" not in plan
        flags = exact_dedup.flagged(rows, "s", 200, range_rows)
        once = {r.s for r in rows.groupBy("s").count().filter("count = 1").collect()}
        got = flags.collect()
        assert len(got) == docs.count() and all(r.maybe_repeated for r in got if r.s not in once)
        assert sum(r.maybe_repeated for r in got if r.s in once) < 0.2 * len(got)


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    repeat = {i + j for places in seen.values() if len(places) > 1 for i in places for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat)


def test_quality_rules(hard, none):
    out = quality_rules.judged(hard.select("doc_id", "text")).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in out) == sorted(repr((i, *counts(t))) for i, t, *_ in HARD)
    assert {r.doc_id for r in out if r.kept} == {1, 2, 6, None}
    assert quality_rules.judged(none).count() == 0
    kept = quality_rules.keep_good(hard)
    assert kept.columns == hard.columns and kept.count() == 5


def test_order_of_rules_never_changes_the_verdict(docs):
    rules, names = quality_rules.RULES, list(quality_rules.RULES)
    rows = quality_rules.with_counts(docs.select("doc_id", "text"))
    found = [{r.doc_id for r in quality_rules.cascade(rows, rules, order, quality_rules.from_counts).filter("rejected_by is null").collect()} for order in (names, names[::-1])]
    raw = quality_rules.cascade(docs, rules, names, lambda r: quality_rules.from_text(docs, r)).filter("rejected_by is null").collect()
    assert found[0] == found[1] == {r.doc_id for r in raw} == {r.doc_id for r in quality_rules.keep_good(docs).collect()} and 0 < len(found[0]) < docs.count()


def test_cascade_stops_at_the_first_rejection(spark, monkeypatch):
    """A later rule that fails on every row is never reached by rows that an earlier one rejects."""
    rows = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    rules = {"early": (("n_words",), lambda n: n < 10), "late": (("n_repeat_words",), lambda n: F.raise_error(F.lit("reached")).isNull() | (n > 0))}
    monkeypatch.setattr(quality_rules, "order_for", lambda *_: ["early", "late"])
    assert quality_rules.keep_good(rows, rules).count() == 0
    monkeypatch.setattr(quality_rules, "order_for", lambda *_: ["late", "early"])
    with pytest.raises(Exception, match="reached"):
        quality_rules.keep_good(rows, rules).collect()


def test_rules_are_ordered_by_rejection_per_cost(spark, monkeypatch):
    rows = spark.createDataFrame([("a b",)] * 30 + [("# " * 40,)] * 10 + [("one two three " * 10,)] * 10, "text string")
    cost = {"few_words": 1.0, "symbols": 1.0, "repeats": 9.0}
    rules = {n: quality_rules.RULES[n] for n in cost}
    took = iter([0.5, *(0.5 + cost[n] for n in rules)])
    monkeypatch.setattr(quality_rules, "seconds", lambda *_: next(took))
    assert quality_rules.ordered(rows, rules) == ["few_words", "symbols", "repeats"]
    took = iter([0.5, 100.5, 1.5, 1.5])
    assert quality_rules.ordered(rows, rules) == ["repeats", "few_words", "symbols"]


def test_clashing_names(spark):
    """Every stage leaves columns of the names that it uses inside as they are, with their values."""
    names = "_id _sha _s _n _key _row _range _block _words _lines n_words n_lines _end _start _bucket _draw kept keep_row group_size component_id root rid digest keys piece_ids size taken target _own_0 _own_7".split()
    rows = spark.createDataFrame([(i, f"document {i} " + "with some words that are not like those of others " * (1 + i % 2) + f"and {i}", f"s{i % 2}", *[f"{n}{i}" for n in names]) for i in range(8)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for stage in (exact_dedup.drop_copies, jaccard_join.drop_near_copies, quality_rules.keep_good, mixing.mixture, mixing.planned, quality_rules.judged, sentence_pieces.encoded):
        out = stage(rows)
        new = {"planned": ["size", "source_size", "target", "taken"], "judged": [*quality_rules.counts(rows), "rejected_by", "kept"], "encoded": ["piece_ids"]}.get(stage.__name__, [])
        assert out.columns == [c for c in rows.columns if c not in new] + new, stage
        got = out.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names if n not in new), stage


def filled(sizes, weights, cap=3):
    """Water-filling by the book: clamp what is above its cap, share the rest again, until nothing is."""
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * left / weight > cap * sizes[i]]
        if not over:
            return [fixed.get(i, weights[i] * left / weight if i not in fixed else 0) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


@pytest.mark.parametrize("sizes", [[5, 1000, 30, 1], [100, 100, 100], [1, 1, 1, 1, 1, 5000], [0, 7, 0, 90], [10]])
def test_targets(spark, sizes):
    s = spark.createDataFrame([(False, f"s{i}", n) for i, n in enumerate(sizes)], "_null boolean, _source string, source_size long")
    got = [r.target for r in mixing.targets(s).orderBy("_source").collect()]
    assert got == pytest.approx(filled(sizes, [i % 3 + 1 for i in range(len(sizes))]))


def test_mixture(hard, none, docs):
    rows = mixing.planned(docs).collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    again = {(r.doc_id, r.taken) for r in mixing.planned(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    assert abs(words - sum(r.taken for r in rows)) <= 0.01 * words
    assert mixing.mixture(hard).columns == hard.columns and mixing.mixture(hard).count() > 0 and mixing.planned(none).count() == 0


def test_counts_that_nobody_asked_for_stand_behind_the_rules(docs, hard):
    """The same verdicts as with all counts; rules whose counts are at hand come first and aren't timed."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for rows in (docs.select("doc_id", "text"), hard.select("doc_id", "text")):
        want = sorted((repr(r.doc_id), r.n_words, r.n_repeat_words, r.kept) for r in quality_rules.judged(rows).collect())
        out = quality_rules.reported(rows, names)
        assert out.columns == ["doc_id", "text", *names, "rejected_by", "kept"]
        assert sorted((repr(r.doc_id), r.n_words, r.n_repeat_words, r.kept) for r in out.collect()) == want
    seen, timed = quality_rules.seconds, []
    quality_rules.seconds = lambda rows, tested: timed.append(1) or seen(rows, tested)
    try:
        order = quality_rules.order_for(docs, quality_rules.RULES, 100, names)
    finally:
        quality_rules.seconds = seen
    assert len(timed) == 3 and set(order[-2:]) == {"duplicate_lines", "shouting"}

"""Phrases: against counts by hand, with windows, collisions and hard rows."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrases

from .conftest import HARD, KIND


def by_hand(rows, minimum, longest, top):
    """The result for rows of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    f = {g: c for g, c in f.items() if c >= minimum}
    inside = Counter()
    for (lang, w), c in f.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], c)
    out = []
    for (lang, w), a in f.items():
        if len(w) > 1 and 100 * inside[lang, w] < 100 * a:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    ranked, last = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        last[lang] += 1
        if last[lang] <= top:
            ranked.append((lang, last[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return ranked


def found(rows, *args, **kind):
    return sorted(tuple(r) for r in phrases.collocations(rows, *args, **kind).collect())


@pytest.mark.parametrize("minimum, longest, top, bits", [(20, 5, 2000, 64), (8, 5, 50, 64), (8, 5, 2000, 9), (8, 3, 2000, 14), (15, 2, 7, 64), (3, 7, 100, 64)])
def test_against_counts(docs, minimum, longest, top, bits):
    some = docs.filter("doc_id < 60")
    want = by_hand([(r.lang, r.text) for r in some.collect()], minimum, longest, top)
    assert want and found(some, minimum, longest, top, bits) == sorted(want)


def test_hard_rows(hard, none, spark):
    want = by_hand([(r.lang, r.text) for r in hard.collect()], 2, 5, 100)
    assert {w[0] for w in want} >= {"en"} and found(hard, 2, 5, 100) == sorted(want)
    assert found(none) == []
    odd = [(i % 3, t, lang, None, 0) for i, (t, lang) in enumerate([("A b\tc  d. A b;c", None), ("a  B c D\r\na b", "und"), ("İ é É ß\x00 x", ""), ("İ é É ß\x00 x", ""), ("..,;", "de"), (None, "de")] * 3)]
    rows = spark.createDataFrame(odd, KIND)
    assert found(rows, 2, 5, 100) == sorted(by_hand([(r[2], r[1]) for r in odd], 2, 5, 100))


def test_long_texts_are_cut_into_windows(spark, docs, monkeypatch):
    text = " ".join(r.text or "" for r in docs.limit(30).collect())
    rows = spark.createDataFrame([(1, text, "en", None, 0), (1, "x" * 3000 + " a b c " + "y" * 3000, "en", None, 0)], KIND)
    want = phrases.Grams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), np.zeros(1, np.uint64), len(text.encode()))
    whole = {k: Counter(want.phrases(k, want.starting(k)).to_pylist()) for k in (1, 2, 3, 5)}
    monkeypatch.setattr(phrases, "CHUNK", 500)
    data = np.frombuffer(text.encode(), np.uint8)
    for k, count in whole.items():
        cut = Counter()
        for part, ends, _, own in phrases.windows(data, np.array([0, len(data)]), 5):
            grams = phrases.Grams(part, ends, np.zeros(1, np.uint64), own)
            cut.update(grams.phrases(k, grams.starting(k)).to_pylist())
        assert cut == count
    assert [len(p) for p, *_ in phrases.windows(np.frombuffer(b"x" * 3000, np.uint8), np.array([0, 3000]), 5)] == [3000]
    assert rows.count() == 2


def test_a_bitmap_holds_all_its_fingerprints(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("print"))
    bits = phrases.bitmap(rows).value
    prints = np.array([r.print for r in rows.collect()]).view(np.uint64)
    other = np.array([r.print for r in spark.range(9000, 19000).select(F.xxhash64("id").alias("print")).collect()]).view(np.uint64)
    assert bits.holds(prints).all() and bits.holds(other).mean() < 0.02


def test_rows_are_added_up(monkeypatch):
    draw, want, least = np.random.default_rng(2), Counter(), {}
    monkeypatch.setattr(phrases, "HELD", 100)

    def parts():
        for _ in range(40):
            a, n, d = draw.integers(0, 30, 50), draw.integers(1, 5, 50), draw.integers(0, 1000, 50)
            for x, y, z in zip(a.tolist(), n.tolist(), d.tolist()):
                want[x] += y
                least[x] = min(least.get(x, z), z)
            yield a, n, n * 3, d

    got, low = Counter(), {}
    for a, n, c, d in phrases.added_up(parts()):
        assert len(a) <= 60 and (c == n * 3).all()
        for x, y, z in zip(a.tolist(), n.tolist(), d.tolist()):
            got[x] += y
            low[x] = min(low.get(x, z), z)
    assert got == want and low == least and list(phrases.added_up(iter([]))) == []
    assert [len(x[0]) for x in phrases.added_up(iter([tuple(np.zeros(0, int) for _ in range(4))]))] == [0]


def test_pointers_that_several_documents_share(docs, monkeypatch):
    """With two bits of a pointer each leads to a quarter of the documents; the result is the same."""
    some = docs.filter("doc_id < 60")
    want = found(some, 15, 4, 500)
    monkeypatch.setattr(phrases, "POINTER", 2)
    assert want and found(some, 15, 4, 500) == want


def test_extra_columns_are_ignored(hard):
    assert found(hard, 2, 4) == found(hard.select("doc_id", "lang", "text"), 2, 4) and len(HARD) == hard.count()

"""Alignment strategies against plain loops, on words that are lost, changed or misspelt."""

import random
import sys
from difflib import SequenceMatcher

import pytest

from tidemark.operators import align, windows

WORDS = "organise favourite colours moroni buried nephite records christs atonement heals everyone a the of and in sea deep art some part season here".split()


def by_text(sentences, words, prefix):
    """First and last word of each sentence: where it stands in the words' text, else its first words do; then its last three, or its length."""
    text, at = " ".join(words), 0
    for s in sentences:
        w = align.bare(s)
        whole, found = " ".join(w), None
        if w and (hit := text.find(whole, at)) >= 0:
            found = (hit, hit + len(whole))
        elif w and (hit := text.find(" ".join(w[:prefix]), at)) >= 0:
            behind = text.find(" ".join(w[-3:]), hit + len(" ".join(w[:prefix])))
            found = (hit, min(len(text), hit + len(whole)) if behind < 0 else behind + len(" ".join(w[-3:])))
        at = found[1] if found else at
        yield (text[: found[0]].count(" "), text[: found[1] - 1].count(" ")) if found else None


def by_subsequence(sentences, words):
    """First and last of the words that match a sentence's in order; equal, or one the other's beginning."""
    at = 0
    for s in sentences:
        w, i, first, last = align.bare(s), 0, None, None
        for j in range(max(0, at - 5), len(words)):
            if i == len(w):
                break
            if words[j].startswith(w[i]) or w[i].startswith(words[j]):
                first, last, i = (j if first is None else first), j, i + 1
            elif 0 < i <= 2:
                first, i = None, 0
        if i == len(w) and w:
            at = last + 1
        yield (first, last) if first is not None and i else None


def timed(sentences, words, strategy):
    """One chapter by itself: what aligned() gives for it."""
    out, texts, plain = [], [t for _, t in sentences], ["".join(align.bare(w)) for w, _, _ in words]
    spans = by_text(texts, plain, int(strategy[-1])) if strategy.startswith("exact") else by_subsequence(texts, plain) if strategy == "subsequence" else align.by_ratio(texts, plain)
    for (index, text), span in zip(sentences, spans):
        if span:
            out.append({"index": index, "start": round(words[span[0]][1], 3), "end": round(words[span[1]][2], 3), "estimated": False})
        elif out:
            start = out[-1]["end"]
            length = align.GUESS if strategy.startswith("exact") else start / len(out) if strategy == "subsequence" else max(1.0, align.GUESS_PER_WORD * len(align.bare(text)))
            out.append({"index": index, "start": start, "end": round(start + length, 3), "estimated": True})
        elif strategy == "fuzzy":
            out.append({"index": index, "start": 0.0, "end": 1.0, "estimated": True})
    return out


def spans_of(spark, strategy, said, words):
    """What the library finds for one chapter: first and last word of each sentence, from 0."""
    s = spark.createDataFrame([(1, i, t) for i, t in enumerate(said)], "chapter_id int, index int, text string")
    w = spark.createDataFrame([(1, i, x, float(i), float(i)) for i, x in enumerate(words)], "chapter_id int, pos int, word string, start double, end double")
    if strategy == "subsequence":
        return [(r["first"] - 1, r["last"] - 1) if r["first"] else None for r in align.in_order(s, w).orderBy("index").collect()]
    found = {r["index"]: (int(r.start), int(r.end)) for r in align.aligned(s, w, strategy).collect() if not r.estimated}
    return [found.get(i) for i in range(len(said))]


def fuzzy(sentences, words):
    """Every window from the cursor on, by its ratio; the earliest and shortest of equals."""
    at, out = 0, []
    for s in sentences:
        w, best, found = align.bare(s), align.LEAST_RATIO, None
        for i in range(at, min(len(words), at + align.REACH + 2 * len(w))):
            for n in range(max(1, len(w) - 2), len(w) + 5):
                if w and i + n <= len(words) and (r := SequenceMatcher(None, " ".join(w), " ".join(words[i : i + n])).ratio()) > best:
                    best, found = r, (i, i + n - 1)
        out.append(found)
        at = found[1] + 1 if found else at
    return out


def test_fuzzy_tries_every_window():
    draw = random.Random(3)
    for _ in range(12):
        said = [" ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 7))) for _ in range(8)]
        heard = []
        for w in " ".join(said).split():
            w = w if draw.random() < 0.8 else w[:1] + draw.choice("aeiou") + w[1:] if draw.random() < 0.7 else ""
            heard += [w] if w else []
        assert list(align.by_ratio(said, heard)) == fuzzy(said, heard)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_bounds_of_windows_in_lanes():
    draw = random.Random(5)
    for n, starts in ((1, 3), (2, 30), (6, 9), (9, 200)):
        text, heard = " ".join(draw.choices(WORDS, k=n)), [*draw.choices([*WORDS, ""], k=40)]
        sizes, want = range(max(1, n - 2), n + 5), []
        for i in range(min(starts, len(heard) - sizes[0] + 1)):
            for m in [m for m in sizes if i + m <= len(heard)]:
                part = " ".join(heard[i : i + m])
                bound = 2.0 * lcs(text, part) / (len(text) + len(part))
                want += [(bound, i, m)] if bound > align.LEAST_RATIO else []
        assert align.likely(text, heard, starts, sizes) == sorted(want, key=lambda x: (-x[0], x[1:]))
    assert align.likely("a b c", ["a"], 10, range(2, 8)) == []


def test_words_are_read_once_for_all_windows():
    steps, text, heard = [0], " ".join(WORDS), WORDS * 6

    def count(frame, event, arg):
        steps[0] += event == "line"
        return count

    sys.settrace(count)
    align.likely(text, heard, 100, range(len(WORDS) - 2, len(WORDS) + 5))
    sys.settrace(None)
    assert steps[0] < 20 * len(" ".join(heard))


def changed(draw, text, letters):
    """A text with some letters lost, some put in and a stretch that is moved."""
    out = list(text)
    for _ in range(draw.randint(0, 6)):
        at = draw.randint(0, len(out))
        out[at : at + draw.randint(0, 8)] = draw.choices(letters, k=draw.randint(0, 5))
    return "".join(out)


def test_ratio_is_that_of_the_standard_library():
    draw = random.Random(11)
    for length in (0, 1, 2, 20, 90, 199, 200, 201, 320):
        for letters in ("ab", "abc ", "etaoin shrdlu q\u00e9\u00df", "abcdefghijklmnopqrstuvwxyz  \u03c3\U0001f600"):
            for _ in range(12):
                a = "".join(draw.choices(letters, k=length))
                b = changed(draw, a, letters) if draw.random() < 0.7 else "".join(draw.choices(letters, k=draw.randint(0, 2 * length)))
                want = SequenceMatcher(None, a, b).ratio()
                assert windows.ratio(a, b) == windows.ratio(a, b, want) == want
                assert windows.ratio(a, b, want + 0.05) in (0.0, want)


def story(draw, sentences):
    """Sentences of one word to sixty and what was heard of them, some of it lost, misspelt or empty."""
    vocabulary = ["".join(draw.choices("etaoinshrdlucmfwypvbgkjqxz\u00e9\u0436", k=draw.randint(1, 9))) for _ in range(80)] + WORDS
    said = [draw.choices(vocabulary, k=draw.choice([1, 2, 4, 8, 8, 12, 20, 40, 60])) for _ in range(sentences)]
    heard = []
    for w in (w for s in said if draw.random() < 0.9 for w in s):
        heard += [] if draw.random() < 0.12 else [draw.choice(["", "zz", w[1:], w + "s"])] if draw.random() < 0.1 else [w]
    return [" ".join(s) for s in said], heard


def test_windows_side_by_side_lose_none():
    """Every window whose ratio is above over is there, by no less than its ratio, whatever stands beside it."""
    draw, asks = random.Random(13), []
    for _ in range(30):
        said, words = story(draw, 6)
        heard = windows.Heard(words)
        for s in said:
            n, first = len(s.split()), draw.randrange(len(words))
            sizes = range(max(1, n - 2), n + 5)
            starts = range(first, min(first + 30, len(words) - sizes[0] + 1))
            asks += [windows.Ask(s, heard, starts, sizes, draw.choice([0.7, 0.8, 0.9]))] if starts else []
    for limbs in {a.limbs() for a in asks}:
        some = [a for a in asks if a.limbs() == limbs]
        for a, got in zip(some, windows.likely(some * windows.FEW)):
            bounds = {(i, n): bound for bound, i, n in got}
            assert got == sorted(got, key=lambda x: (-x[0], x[1:])) and all(i in a.starts and n in a.sizes and i + n <= len(a.heard.words) for i, n in bounds)
            for i in a.starts[::3]:
                for n in a.sizes:
                    part = a.heard.words[i : i + n]
                    if len(part) == n and SequenceMatcher(None, a.text, " ".join(part)).quick_ratio() > a.over:
                        r = SequenceMatcher(None, a.text, " ".join(part)).ratio()
                        assert r <= a.over or bounds[i, n] >= r


def test_chapters_side_by_side_are_as_by_themselves():
    draw = random.Random(17)
    chapters = [(k, *story(draw, 8)) for k in range(40)]
    got = dict(align.side_by_side(chapters))
    assert got == {k: list(align.by_ratio(said, heard)) for k, said, heard in chapters}
    assert all(got[k] == fuzzy(said, heard) for k, said, heard in chapters[:8])


def test_chapters_are_read_side_by_side():
    """Steps don't grow with the letters of a sentence's windows, as they did before."""
    draw, steps, chapters = random.Random(19), [0], []
    for k in range(60):
        said = [draw.choices(WORDS, k=8) for _ in range(20)]
        chapters.append((k, [" ".join(s) for s in said], [w for s in said for w in s if draw.random() < 0.9]))

    def count(frame, event, arg):
        steps[0] += event == "line"
        return count

    sys.settrace(count)
    got = dict(align.side_by_side(chapters))
    sys.settrace(None)
    assert sum(len(x) for x in got.values()) == 1200
    assert steps[0] < 1200 * 800


def test_words_are_bared_together():
    for words in ([], [""], ["A\u03a3", "\u0391\u03a3 \u0391", "don't", " x y ", "...", "\u0130"], ["a\nb", "c"], ["\n", "\r\u2028z"]):
        assert align.bare_words(words) == ["".join(align.bare(w)) for w in words]


def test_one_chapter_alone_is_as_among_others():
    """A chapter that nothing stands beside, as the last of a task, with starts left out by pairs and triples of letters."""
    draw = random.Random(23)
    said, heard = story(draw, 40)
    among = dict(align.side_by_side([(k, said, heard) for k in range(windows.FEW)]))
    assert list(align.by_ratio(said, heard)) == fuzzy(said, heard) == among[0] == among[windows.FEW - 1]


def test_fuzzy_by_odd_chapters(spark):
    """A null chapter is one of its own; null words and texts, sentences without words and words without sentences."""
    s = spark.createDataFrame([(None, 1, "the sea"), (None, 0, None), (1, 0, "deep sea"), (2, 5, "x")], "chapter_id string, index int, text string")
    w = spark.createDataFrame([(None, 2, "sea", 2.0, 2.5), (None, 1, "the", 1.0, 1.5), (1, 3, "sea", 3.0, None), (1, 2, None, 2.0, 2.5), (1, 1, "Deep!", 1.0, 1.5), (3, 0, "x", 0.0, 1.0)], "chapter_id string, pos int, word string, start double, end double")
    got = {(r.chapter_id, r["index"]): (r.start, r.end, r.estimated) for r in align.aligned(s, w).collect()}
    assert got == {(None, 0): (0.0, 1.0, True), (None, 1): (1.0, 2.5, False), ("1", 0): (1.0, None, False), ("2", 5): (0.0, 1.0, True)}


@pytest.mark.parametrize("said,heard", [("organise favourite colours", "organize favorite colors"), ("moroni buried nephite records", "maroni berried nefite record"), ("christs atonement heals everyone", "christ atonements heal every one"), ("remember", "remembers")])
def test_fuzzy_finds_misspelt_words(said, heard):
    words = ["zzz", *heard.split(), "qqq"]
    assert list(align.by_ratio([said], words)) == [(1, len(words) - 2)]


def test_prefix_ends_with_the_last_words(spark):
    words = "one two three four five x y z seven eight nine ten eleven".split()
    for said, want in (
        (["one two three four five six seven eight nine", "ten eleven"], [(0, 10), (11, 12)]),
        (["one two three four five six six six"], [(0, 8)]),  # no such end: as many characters on
        (["two three four five"], [(1, 4)]),
        (["", "no"], [None, None]),
        (["hree fou", "ven e", "four"], [(2, 3), (8, 9), None]),  # within words, and not before the cursor
    ):
        assert list(by_text(said, words, 5)) == spans_of(spark, "exact_prefix5", said, words) == want


def test_subsequence_begins_anew(spark):
    words = "a b x a b c".split()
    assert list(by_subsequence(["a b c"], words)) == spans_of(spark, "subsequence", ["a b c"], words) == [(3, 5)]


def test_subsequence_over_blocks(spark):
    """Sentences that end in a later block of words than they begin in, partial ones, five words back."""
    draw = random.Random(9)
    for n in (align.BLOCK - 1, align.BLOCK, 3 * align.BLOCK + 5):
        words = [draw.choice(WORDS) for _ in range(n)]
        said = [" ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 4))) for _ in range(30)] + [" ".join(words[5:8] + words[-2:])]
        assert spans_of(spark, "subsequence", said, words) == list(by_subsequence(said, words))


def test_placed_in_texts(spark):
    """Punctuation is kept where a sentence is sought whole; chapters without text, sentences without words, equal rows."""
    s = spark.createDataFrame([(1, 0, "Well, then!"), (1, 1, " ... "), (1, 2, None), (1, 3, "the SEA,  said"), (1, 4, "...Well then"), (2, 0, "x"), (2, 0, "x"), (3, 0, "x")], "chapter_id int, index int, text string")
    t = spark.createDataFrame([(1, "Oh well, then! The sea, said he ... well then"), (2, "xx"), (3, None), (4, "x")], "chapter_id int, text string")
    got = sorted(((r.chapter_id, r["index"], r["first"], r["last"]) for r in align.placed(s, t).collect()), key=str)
    assert got == sorted([(1, 0, 4, 14), (1, 1, 33, 35), (1, 2, None, None), (1, 3, None, None), (1, 4, 37, 45), (2, 0, 1, 1), (2, 0, 2, 2), (3, 0, None, None)], key=str)
    assert align.placed(s.limit(0), t).count() == 0 and align.in_order(s.limit(0), t.selectExpr("chapter_id", "1 AS pos", "text AS word")).count() == 0


@pytest.mark.parametrize("strategy", align.STRATEGIES)
def test_chapters_side_by_side_are_as_each_alone(spark, strategy):
    """Sentences that aren't found in front, in between, at the end and everywhere."""
    draw, sentences, words, want = random.Random(5), [], [], {}
    for chapter in range(6):
        said = [" ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 6))) for _ in range(12)]
        heard = [(w, i * 0.37, i * 0.37 + 0.2) for i, w in enumerate(" ".join(said[2:5] + said[6:9]).split())] if chapter else []
        sentences += [(chapter, i, t) for i, t in enumerate(said)]
        words += [(chapter, i, *w) for i, w in enumerate(heard)]
        want |= {(chapter, r["index"]): (r["start"], r["end"], r["estimated"]) for r in timed(list(enumerate(said)), heard, strategy)}
    out = align.aligned(spark.createDataFrame(sentences, "chapter_id int, index int, text string"), spark.createDataFrame(words, "chapter_id int, pos int, word string, start double, end double"), strategy).collect()
    assert {(r.chapter_id, r["index"]) for r in out} == set(want) and len(out) == len(want)
    for r in out:
        assert (r.start, r.end, r.estimated) == want[r.chapter_id, r["index"]]

"""Suffix-array dedup, the Jaccard join, components and the pipeline against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, components, jaccard_join, sentence_pieces, suffix_dedup
from tidemark.llm.common import shingle_sets, table

from .conftest import HARD
from .test_native import counts, filled


def removed(texts):
    """(bytes, removed, runs, digest) of each text, from a count of all strings of LENGTH bytes."""
    n = suffix_dedup.LENGTH
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + n] for x in data for i in range(len(x) - n + 1))
    out = []
    for x in data:
        covered = np.zeros(len(x) + 1, np.int64)
        for i in range(len(x) - n + 1):
            if seen[x[i : i + n]] > 1:
                covered[i] += 1
                covered[min(i + n, len(x))] -= 1
        gone = np.cumsum(covered)[: len(x)] > 0
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_two_stage_sorting():
    draw = np.random.default_rng(7)
    for letters in (1, 2, 3, 20):
        for n in (1, 2, 30, 400):
            body = draw.integers(98, 98 + letters, n).astype(np.uint8)
            text = np.concatenate([body, np.zeros(240, np.uint8)])
            wanted = np.zeros(len(text), bool)
            wanted[:n] = draw.random(n) < 0.7
            got = suffix_dedup.suffix_array(text, wanted, 400) if wanted.any() else np.zeros(0, int)
            want = sorted(np.flatnonzero(wanted).tolist(), key=lambda i: text[i : n + 1].tobytes())
            assert got.tolist() == want


def test_memory_of_a_block():
    draw, rows = np.random.default_rng(3), []
    body = draw.integers(97, 123, 200_000).astype(np.uint8)
    for at in draw.integers(0, len(body) - 400, 3000).tolist():
        rows.append((body[at : at + 300], np.arange(101), 1))
    tracemalloc.start()
    suffix_dedup.repeated_in_block(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 * 301 * len(rows)


def test_blocks_are_bounded(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    rows = [{"anchor": a, "data": b"x" * 90} for a, n in enumerate((3, 7, 6, 20, 1, 11)) for _ in range(n)]
    got = list(suffix_dedup.blocks(pa.RecordBatch.from_pylist(rows[i : i + 7]) for i in range(0, len(rows), 7)))
    assert [r for b in got for r in b] == rows
    assert [[r["anchor"] for r in b] for b in got] == [[0] * 3 + [1] * 7, [2] * 6, [3] * 20, [4], [5] * 11]


@pytest.mark.parametrize("hot", [8_000, 3])
def test_suffix_dedup(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    draw = random.Random(4)
    shared = "".join(draw.choice("abcdef ") for _ in range(700))
    made = [f"{i} head {shared[i * 7 : 250 + i * 11]} tail {i}" for i in range(30)] + ["ab" * 400, "z" * 900, "é" * 300, shared, shared, None, "", "short"]
    rows = [(i, t) for i, t in enumerate(made)] + [(1000 + r.doc_id, r.text) for r in docs.limit(60).collect()] + [(5, "other text with the same id " + shared)]
    got = suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(i, *x) for (i, _), x in zip(rows, removed([t for _, t in rows]))]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_header_that_goes_on_differently(spark, monkeypatch):
    """Texts that share 100 or 230 bytes in front: their anchor has a run for each text, and is counted by hashes."""
    draw = random.Random(6)
    word = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    short, long = word(100), word(230)
    made = [(short if i % 2 else long) + word(260) for i in range(300)]
    want = sorted((i, *x) for i, x in enumerate(removed(made)))
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    seen = []
    hot_spans = suffix_dedup.hot_spans
    monkeypatch.setattr(suffix_dedup, "hot_spans", lambda *a: seen.append(1) or hot_spans(*a))
    for hot in (8000, 20):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        assert sorted(tuple(r) for r in suffix_dedup.removed(rows).collect()) == want
        assert len(seen) == (hot == 20)


def test_suffix_dedup_of_hard_rows(hard, none):
    got = suffix_dedup.removed(hard).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((i, *x)) for (i, *_), x in zip(HARD, removed([t for _, t, *_ in HARD])))
    assert suffix_dedup.removed(none).count() == 0


@pytest.mark.parametrize("ids", ["id", "cast(null as long)", "cast(7 as long)"])
def test_many_equal_rows(spark, monkeypatch, ids):
    """Each run of a repeated row is cut out once, whatever the rows' ids are, so the work grows with the rows and not with their square."""
    draw = random.Random(9)
    text, other = ("".join(draw.choice(letters) for _ in range(1500)) for letters in ("abcdefghij ", "klmnopqrst "))
    rows = spark.range(20_000).selectExpr(f"{ids} as doc_id", f"'{text}' as text").union(spark.createDataFrame([(-5, other)], "doc_id long, text string")).repartition(4)
    met, of_rows = [], suffix_dedup.of_rows

    def seen(docs, found, alike=True):
        out = of_rows(docs, found, alike)
        met.append((alike, out.count()))
        return out

    monkeypatch.setattr(suffix_dedup, "of_rows", seen)
    got = {tuple(r)[:4]: r[4] for r in suffix_dedup.removed(rows).groupBy("n_bytes", "n_removed", "n_spans", "kept_sha256").count().collect()}
    assert got == {(1500, 1500, 1, hashlib.sha256().hexdigest()): 20_000, (1500, 0, 0, hashlib.sha256(other.encode()).hexdigest()): 1}
    assert all(n == (20_000 if alike else 1) for alike, n in met) and {alike for alike, _ in met} == {True, False}


def joined(rows, k, t):
    """(doc_id, shingles, smallest linked id) of each row from all pairs; null ids come last."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    of = list(range(len(rows)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and t[1] * len(a & b) >= t[0] * len(a | b):
                of[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)] = min((x for x in (least.get(top(i)), doc_id) if x is not None), default=None)
    return [(doc_id, len(s), least[top(i)]) for i, ((doc_id, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("k,t,tile", [(4, (85, 100), jaccard_join.TILE), (4, (85, 100), 300), (5, (80, 100), 2000)])
def test_jaccard_join(spark, docs, k, t, tile):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(120)]
    rows = [(r.doc_id, r.text) for r in docs.limit(80).collect()]
    for i in range(70):  # near copies around the bound, chains of them, and texts of few words
        text = list(base)
        for _ in range(draw.randint(0, 6)):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((1000 + i, " ".join(text)))
        if i % 4 == 0:
            base = text
    rows += [(2000, "a b"), (2001, "A  b"), (2002, "a"), (2003, None), (2004, " "), (2005, "a b c d"), (2006, "a b c d a b c d")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, t, tile).collect()
    assert sorted(tuple(r) for r in got) == sorted(joined(rows, k, t))


def test_jaccard_join_of_hard_rows(hard, none):
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(hard).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (None, None), (8, 8), (9, 9)}
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.drop_near_copies(hard)
    assert kept.columns == hard.columns and kept.count() == len(HARD) - 2


@pytest.mark.parametrize("k", [4, 5])
@pytest.mark.parametrize("words", range(7))
def test_jaccard_join_of_short_texts(k, words):
    """Texts of every number of words up to a shingle's and one more, alone and in front of a text that is cut off by itself."""
    short, long = " ".join("abcdefgh"[:words]), "long text " * 120_000
    for texts in ([short], [short, long], [short, short, long, short], ["x y z w v u", short]):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
        _, ends = shingle_sets(data, offsets, k)
        want = [n for _, n, _ in joined(list(enumerate(texts)), k, (85, 100))]
        assert np.diff(ends).tolist() == want
        assert [n for b in jaccard_join.outlined(k, (85, 100))([batch]) for n in b.column("n_shingles").to_pylist()] == want


def test_jaccard_join_tells_rows_apart(spark):
    """Rows that share an id, ids that are null, rows alike in all: components by all pairs, and exactly one row of each stays."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (5, a), (5, b), (7, b + " more"), (None, a), (None, "c d e f g"), (None, "c d e f g"), (9, "c d e f g h i j"), (9, "c d e f g h i j"), (9, "c d e f g h i j"), (None, None), (4, "")]
    docs = spark.createDataFrame([(*r, i, "x", "y", "z") for i, r in enumerate(rows)], "doc_id long, text string, n int, _id string, component_id string, _key string").repartition(3)
    got = jaccard_join.jaccard_components(docs).collect()
    want = joined(rows, 4, (85, 100))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and (7, 58, 5) in want and (None, 57, 3) in want
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    left = sorted(repr((r.doc_id, r.text)) for r in kept.collect())
    assert left == sorted(map(repr, [(3, a), (5, b), (None, "c d e f g"), (9, "c d e f g h i j"), (None, None), (4, "")]))


def test_heavy_keys_stay_spread(spark, monkeypatch):
    monkeypatch.setattr(common, "MIN_HEAVY", 5)
    rows = spark.createDataFrame([(1, i) for i in range(2000)] + [(k, k) for k in range(2, 500)], "k int, v int")
    keys = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("w", F.col("k") * 10)
    got = common.spread_join(rows, keys.filter("k <> 7"), "k", "n", 2498)
    assert got.columns == ["k", "v", "n", "w"] and got.count() == 2497 and got.filter("w <> k * 10 or (k = 1) <> (n = 2000)").count() == 0


def test_tree_finds_what_all_pairs_find():
    draw = np.random.default_rng(3)
    t = (80, 100)
    for _ in range(8):
        sets = []
        for _ in range(90):
            s = sets[draw.integers(len(sets))].copy() if sets and draw.random() < 0.7 else draw.integers(0, 2**60, draw.integers(1, 60)).astype(np.uint64)
            s[draw.random(len(s)) < 0.05] = draw.integers(0, 2**60)
            sets.append(np.unique(s))

        def label(pairs):
            f = jaccard_join.Forest(len(sets))
            for a, b in pairs:
                f.join(a, b)
            return [min(f.members[x]) for x in f.label]

        every = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard_join.linked(sets[i], sets[j], t)]
        assert label(jaccard_join.tree_links(sets, t)) == label(every)
        across = [(i, j) for i, j in every if (i < 40) != (j < 40)]
        assert label(jaccard_join.tree_links(sets, t, 40)) == label(across)


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    of = {v: v for e in edges for v in e}
    for _ in of:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
        if all(of[a] == of[b] for a, b in edges):
            break
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: c for v, c in of.items() if any(v in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, sf):
    """run() against all stages by brute force, but for the rows that the mix draws, whose words are held to the targets."""
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "source").collect()]

    def good(text):
        n, chars, symbols, dup, repeat = counts(text)
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
        return not (n < 10 or 100 * repeat > 20 * n or 10 * symbols > n or 2 * dup > len(lines) or chars < 2 * n or chars > 20 * n or 2 * sum("A" <= c <= "Z" for c in text) > chars)

    docs = [d for d in docs if good(d[1])]
    best = {}
    for d in docs:
        key = "".join(d[1].split())
        best[key] = min(best.get(key, d), d, key=lambda x: (-len(x[1]), x[0]))
    docs = list(best.values())
    smallest = {i: c for i, _, c in joined([d[:2] for d in docs], 5, (80, 100))}
    docs = [d for d in docs if smallest[d[0]] == d[0]]
    names = sorted({d[2] for d in docs})
    sizes = [sum(len(d[1].split()) for d in docs if d[2] == s) for s in names]
    target = dict(zip(names, filled(sizes, [i % 3 + 1 for i in range(len(names))])))
    rows = corpus_pipeline.run(spark, sf).collect()
    known, whole = {d[0]: d for d in docs}, Counter()
    with open(sentence_pieces.MODEL, "rb") as f:
        pieces = sentence_pieces.Pieces(f.read())
    encoder, words = sentence_pieces.Encoder(pieces), Counter()
    for r in rows:
        text = known[r.doc_id][1]
        assert text.lstrip().startswith(r.text.lstrip()) and r.piece_ids == encoder.encode(r.text)
        whole[r.doc_id] += 1
        words[r.source] += len(r.text.split())
    assert max(whole.values()) <= 3
    for s in names:
        assert abs(words[s] - target[s]) <= 1

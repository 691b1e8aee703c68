"""Toxicity, quality model, language model, pieces and WARC: held-out accuracy, brute force and round trips."""

import json
import math
import struct
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import brown_lm, quality_model, sentence_pieces, toxicity, warc
from tidemark.llm.common import mix, table

from .conftest import HARD

MID = "/root/testdata/sf0.01"


def test_segments_are_all_maximal():
    draw = np.random.default_rng(5)

    def by_definition(s):
        """Split at the best segment, leftmost and shortest of equals, again and again."""
        out, parts = [], [(0, len(s))]
        while parts:
            a, b = parts.pop()
            best = None
            for i in range(a, b):
                total = 0
                for j in range(i, b):
                    total += s[j]
                    if total > 0 and (best is None or total > best[2]):
                        best = (i, j + 1, total)
            if best:
                out.append(best)
                parts += [(a, best[0]), (best[1], b)]
        return sorted(out)

    for _ in range(60):
        s = draw.choice([-3.0, -1.0, 1.5, 2.25, 4.125, -0.5], draw.integers(0, 14)) + draw.random() / 7
        assert [(a, b) for a, b, _ in sorted(toxicity.segments(s))] == [(a, b) for a, b, _ in by_definition(s)]


def held_out(spark, name, query, label):
    rows = query(spark, MID).join(table(spark, MID, "labels"), "doc_id").filter("held_out").collect()
    return sum(r.predicted == r[label] for r in rows) / len(rows), rows


def test_expected_numbers_hold_for_chance():
    """Random tokens: after a fit to one half, as many texts of the other half have a segment of that expectation as it says."""
    draw = np.random.default_rng(8)
    scores = draw.choice([3.5, 2.25, toxicity.DRIFT], (6000, 300), p=[0.002, 0.006, 0.992])
    n = draw.integers(50, 300, 6000)
    best = np.array([max((s for *_, s in toxicity.segments(x[:k])), default=0.0) for x, k in zip(scores, n)])
    rate, k = toxicity.extreme_values(n[:3000], best[:3000], 2.25)
    for expected in (0.02, 0.1, 0.3):
        chance = np.mean(k * n[3000:] * np.exp(-rate * best[3000:]) < expected)
        assert 0.5 * expected < chance < 1.6 * expected
    assert toxicity.extreme_values(n, np.zeros(6000), 2.0)[0] == 1.0


def test_toxicity_recall(spark):
    rows = toxicity.op1_toxicity(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").filter("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)


def test_toxicity(spark, hard, none):
    right, rows = held_out(spark, "op1", toxicity.op1_toxicity, "toxic")
    assert not any(r.predicted and not r.toxic for r in rows) and right > 0.93  # 0.84 are not toxic
    assert all(0 <= r.score <= 1 for r in rows)
    train = spark.createDataFrame([("you idiot " * 3, 1)] * 20 + [("a calm text", 0)] * 40, "text string, label int")
    out = toxicity.toxic_passages(hard, train)
    assert out.count() == len(HARD) and out.filter("score is null").count() == 0
    assert toxicity.toxic_passages(none, train).count() == 0
    assert toxicity.toxic_passages(hard, train.filter("label = 2")).agg(F.max("score")).first()[0] < 1e-6
    found = toxicity.toxic_passages(spark.createDataFrame([(1, "calm words " * 10 + "idiot idiot " + "calm words " * 10)], "doc_id long, text string"), train).first()
    assert [(p.start, p.end) for p in found.passages] == [(20, 22)] and found.score > 0.7


def test_quality_model(spark, hard, none):
    right, rows = held_out(spark, "op7", quality_model.op7_quality_model, "quality")
    assert right > 0.95 and all(0 <= r.score <= 1 for r in rows)
    train = spark.createDataFrame([("%%% &&& $$$", 0)] * 8 + [("good words", 1)] * 8, "text string, label int")
    assert quality_model.quality(hard, train).filter("score between 0 and 1").count() == len(HARD)
    assert quality_model.quality(none, train).count() == 0
    assert {r.score for r in quality_model.quality(hard, train.limit(0)).collect()} == {0.5}


def features(text):
    """Buckets of a text by the book: each word, its character n-grams, and each pair of neighbours."""
    as_words = lambda *w: pa.array(w, pa.large_binary())
    words = (text or "").encode().split()
    out = Counter()
    for w in words:
        _, buckets, ends = quality_model.subwords(as_words(w))
        assert ends.tolist() == [0, 1 + sum(max(0, len(w) + 3 - g) for g in quality_model.GRAMS)]
        out.update(buckets.tolist())
    for a, b in zip(words, words[1:]):
        ha, hb = (int(quality_model.subwords(as_words(w))[0][0]) for w in (a, b))
        out[int(mix(np.array([(hb - ha) % 2**64], np.uint64))[0]) % quality_model.BUCKETS] += 1
    return out


def test_quality_features_and_scores(spark, docs):
    """Features of whole chunks against one text at a time, and scores as sums of their parts."""
    texts = [r.text for r in docs.limit(12).collect()] + [None, "", " ", "one", "a a a b", "Ünïcode é", "x" * 3000]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "label": [0] * len(texts), "_order": list(range(len(texts)))})
    rows = [r for b in quality_model.hashed([batch]) for r in b.to_pylist()]
    for text, row in zip(texts, rows):
        want = features(text)
        assert row["ids"] == sorted(want) and row["shares"] == pytest.approx([want[i] / want.total() for i in row["ids"]], rel=1e-5)
    parts = np.random.default_rng(1).normal(size=quality_model.BUCKETS)
    got = [x for b in quality_model.scored(parts, 0.25)([batch]) for x in b.column("score").to_pylist()]
    for text, x in zip(texts, got):
        want = features(text)
        mean = sum(parts[i] * n for i, n in want.items()) / max(1, want.total())
        assert x == pytest.approx(1 / (1 + math.exp(-mean - 0.25)))


def test_quality_step_follows_the_gradient():
    """A step against numerical differences of the loss, summed over documents for vectors and averaged for the rest."""
    draw = np.random.default_rng(3)
    vectors, out, bias = draw.normal(size=(7, 4)), draw.normal(size=(4, 2)), draw.normal(size=2)
    ids, sizes, y = np.array([0, 2, 5, 2, 3]), np.array([3, 0, 2]), np.array([1, 0, 0])
    shares = np.array([0.5, 0.2, 0.3, 0.9, 0.1])

    def loss(v, o, b):
        total, at = 0.0, 0
        for n, label in zip(sizes, y):
            x = (shares[at : at + n, None] * v[ids[at : at + n]]).sum(0) @ o + b
            total, at = total - x[label] + np.log(np.exp(x).sum()), at + n
        return total

    def slope(which):
        args, grad = [vectors.copy(), out.copy(), bias.copy()], np.zeros_like((vectors, out, bias)[which])
        for i in np.ndindex(grad.shape):
            for sign in (1, -1):
                args[which][i] += sign * 1e-5
                grad[i] += sign * loss(*args) / 2e-5
                args[which][i] -= sign * 1e-5
        return grad

    want = vectors - 0.3 * slope(0), out - 0.3 / 3 * slope(1), bias - 0.03 / 3 * slope(2)
    quality_model.step(vectors, out, bias, ids, shares, sizes, y, 0.3)
    assert all(np.allclose(a, b, atol=1e-7) for a, b in zip((vectors, out, bias), want))


def test_quality_sample_is_bounded(spark, monkeypatch):
    train = spark.createDataFrame([("%%% &&& $$$", 0)] * 8 + [("good words", 1)] * 8, "text string, label int")
    seen = []
    monkeypatch.setattr(quality_model, "MAX_PAIRS", 60)
    monkeypatch.setattr(quality_model, "trained", lambda t: seen.append(t) or (np.zeros(quality_model.BUCKETS), 0.0))
    quality_model.quality(train.select(F.lit(1).alias("doc_id"), "text"), train)
    assert 0 < sum(map(len, seen[0]["ids"].to_pylist())) <= 60


@pytest.fixture()
def small_vocabulary(monkeypatch):
    monkeypatch.setattr(brown_lm, "KNOWN", 1200)


def test_language_model(spark, sf, hard, none, small_vocabulary):
    rows = table(spark, sf, "documents").collect()
    train, ends = Counter(), 0
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            train.update((r.text or "").encode().lower().split())
            ends += 1
    n, types = sum(train.values()) + ends, len(train) + 1
    got = {r.doc_id: r for r in brown_lm.op3_brown_lm(spark, sf).collect()}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w) + 1, sum(x in train for x in w) + 1, n)
        assert g.base_score == pytest.approx(sum(math.log10((train.get(x, 0) + 1) / (n + types + 1)) for x in w) + math.log10((ends + 1) / (n + types + 1)))
    unseen = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in unseen) > sum(g.base_score for g in unseen) and all(g.score < 0 for g in unseen)
    assert brown_lm.scores(hard.select("doc_id", "text"), hard.select("text")).count() == len(HARD)
    assert brown_lm.scores(none.select("doc_id", "text"), none.select("text")).count() == 0
    assert brown_lm.scores(hard.select("doc_id", "text"), none.select("text")).filter("n_known > 0").count() == 0


def test_probabilities_add_up():
    """Over all next units, and over the words of a shape group with its unknown ones."""
    draw = np.random.default_rng(1)
    size = brown_lm.END + 1
    pairs = np.zeros((size, size))
    pairs[draw.integers(0, size, 4000), draw.integers(0, size, 4000)] = draw.integers(1, 9, 4000)
    group = np.full(brown_lm.SHAPES, 100.0)
    model = brown_lm.Model(pairs, brown_lm.exchanged(pairs, rounds=2), group, group / 5)
    for before in range(brown_lm.CLASSES + 1):
        assert (10 ** (model.moves[before, model.of] + model.emits)).sum() == pytest.approx(1)
    assert np.allclose(10**model.unknown + group * 10**model.known, 1)


def test_exchange_raises_mutual_information():
    draw = np.random.default_rng(2)
    n = 60
    pairs = np.zeros((n + 1, n + 1))
    for a in range(n):  # even words follow odd ones
        pairs[a, [b for b in range(n) if (a + b) % 2]] = draw.integers(5, 20, n // 2)
    of = brown_lm.exchanged(pairs, 2, 10)
    assert len({(w % 2, of[w]) for w in range(n)}) == 2


def test_words_beyond_the_clustered_find_classes(spark, monkeypatch):
    """Words of two roles, all with one ending and none among the clustered: a word keeps its role's company."""
    monkeypatch.setattr(brown_lm, "KNOWN", 1100)
    texts = [f"head{i:03d}x " * 40 for i in range(1000)]  # the clustered words
    texts += ["head001x head010x head002x " * 2000, "head003x head011x head004x " * 2000]
    one, two = ([f"{a}{i}zz" for i in range(100)] for a in "pq")
    texts += [f"head001x {w} head002x head003x {v} head004x" for w, v in zip(one, two) for _ in range(4)]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    tried = [(i, t) for i in range(100) for t in (f"head001x {one[i]} head002x", f"head001x {two[i]} head002x")]
    rows = brown_lm.scores(spark.createDataFrame([(2 * i + (t.split()[1] in two), t) for i, t in tried], "doc_id long, text string"), train).collect()
    got = {r.doc_id: r.score for r in rows}
    assert np.mean([got[2 * i] > got[2 * i + 1] + 0.1 for i in range(100)]) > 0.95


def test_best_class_raises_information_most():
    draw = np.random.default_rng(4)
    joint = draw.integers(50, 99, (5, 5)).astype(float)
    slot, n = np.array([0, 2, 6, 8]), np.array([9, 1, 2, 7])  # classes 0 and 2 after it, 1 and 3 before it

    def moved(to):
        table_ = joint.copy()
        for c, sign in ((1, -1), (to, 1)):
            for s, x in zip(slot, n):
                table_[(c, s) if s < 5 else (s - 5, c)] += sign * x
        return brown_lm.information(table_)

    assert brown_lm.best_classes(joint, np.array([1]), np.zeros(4, int), slot, n)[0] == max(range(4), key=moved)


def unigram_model(pieces):
    """The model file as a unigram model with these scores, for the library to read."""

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    def message(fields):
        return b"".join(varint(n << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(n << 3 | 5) + struct.pack("<f", v) if isinstance(v, float) else varint(n << 3) + varint(v) for n, v in fields)

    out, i = [], 0
    with open(sentence_pieces.MODEL, "rb") as f:
        for n, v in sentence_pieces.fields(f.read()):
            if n == 1:
                v, i = message(sorted((dict(sentence_pieces.fields(v)) | {2: float(pieces.scores[i])}).items())), i + 1
            elif n == 2:
                v = message([(a, 1 if a == 3 else b) for a, b in sentence_pieces.fields(v)])
            out.append((n, v))
    return sentencepiece.SentencePieceProcessor(model_proto=message(out))


def test_pieces_equal_the_library(spark, docs, hard, none):
    with open(sentence_pieces.MODEL, "rb") as f:
        pieces = sentence_pieces.Pieces(f.read())
    library, encoder = unigram_model(pieces), sentence_pieces.Encoder(pieces)
    texts = [r.text or "" for r in docs.limit(60).collect()] + [t or "" for _, t, *_ in HARD] + ["  two  blanks ", "日本語 😀", "é" * 9, "a\r\n\tb"]
    for word in {w for t in texts for w in t.split(" ")}:  # short, so that the library's float sums are exact
        assert encoder.encode(word) == library.encode(word), word
    for t in texts:
        assert pieces.decode(encoder.encode(t)) == t.replace("▁", " ")
        if len(t) < 400:
            assert encoder.encode(t) == library.encode(t)
    out = sentence_pieces.decoded(sentence_pieces.encoded(hard)).collect()
    assert sorted(((r.text or "").replace("▁", " ") for r in out)) == sorted(r.decoded for r in out) and len(out) == len(HARD)
    assert sentence_pieces.digested(none).count() == 0 and sentence_pieces.encoded(none).columns == [*none.columns, "piece_ids"]
    rows = {r.doc_id: r for r in sentence_pieces.digested(hard.filter("doc_id is not null")).collect()}
    assert rows[4].n_pieces == 0 and rows[4].round_trip and not rows[6].round_trip and rows[6].n_byte_pieces > 0


def test_words_in_step_equal_words_alone(docs, monkeypatch):
    """All texts at once against one word at a time; with words over the bound, and with a model without byte pieces."""
    with open(sentence_pieces.MODEL, "rb") as f:
        data = f.read()
    texts = [r.text for r in docs.limit(80).collect()] + [t for _, t, *_ in HARD] + ["", " ", "  a  b ", "日本語 😀é", "q\x00w", "x" * 300 + " y", "▁x ▁"]
    column = pa.array(texts, pa.string())
    for change in ("none", "short", "no bytes", "squeeze"):
        pieces = sentence_pieces.Pieces(data)
        if change == "short":
            monkeypatch.setattr(sentence_pieces, "LONG", 6)
        elif change == "no bytes":
            pieces.byte = {}
        elif change == "squeeze":
            pieces.squeeze = True
        encoder = sentence_pieces.Encoder(pieces)
        ids, ends = pieces.encode_all(column)
        want = [encoder.encode(t or "") for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
        back, bounds = pieces.decode_all(ids, ends)
        assert [back[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])] == [pieces.decode(w) for w in want]


def test_squeezed_spaces_against_the_library():
    """A file that squeezes spaces: the normalised text is what the library makes of it, alone and in a batch."""
    with open(sentence_pieces.MODEL, "rb") as f:
        data = f.read() + bytes([0x1A, 2, 0x20, 1])  # normaliser: remove extra white space
    library, pieces = sentencepiece.SentencePieceProcessor(model_proto=data), sentence_pieces.Pieces(data)
    texts = ["und ▁", "▁x ▁", "a ▁ b", " ▁a", "a▁▁b", "a  ▁b ", "▁", "  ", "▁ a", "", "  a   b  c ", " ▁ ▁ ", "x", "\t a \n"]
    assert pieces.squeeze and [pieces.marked(t) for t in texts] == [library.normalize(t) for t in texts]
    ids, ends = pieces.encode_all(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [pieces.best(pieces.marked(t)) if t.strip(" ▁") else [] for t in texts]


@pytest.mark.parametrize("more", [bytes([0x1A, 3, 0x12, 1, 65]), bytes([0x0A, 5, 0x0A, 1, 65, 0x18, 4])])
def test_files_that_need_more_are_refused(more):
    with open(sentence_pieces.MODEL, "rb") as f, pytest.raises(ValueError):
        sentence_pieces.Pieces(f.read() + more)


def test_own_columns_of_encoded_rows(spark):
    rows = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, piece_ids string, decoded string")
    out = sentence_pieces.decoded(sentence_pieces.encoded(rows))
    assert out.columns == ["doc_id", "text", "piece_ids", "decoded"] and out.first().decoded == "a b"


def test_trie():
    words = {b"a": 1, b"ab": 2, b"abc": 3, b"b": 4, b"\xff\x00": 5}
    trie = sentence_pieces.Trie(words)

    def find(word):
        s = 0
        for b in word:
            t = trie.base[s] + b + 1
            if trie.check[t] != s:
                return -1
            s = t
        return trie.value[s]

    assert {w: find(w) for w in words} == words and find(b"ac") == -1 and find(b"\xff") == -1


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.words, self.links, self.hidden = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title")
        self.links += [dict(attrs)["href"]] if tag == "a" and dict(attrs).get("href") else []

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title")

    def handle_data(self, data):
        self.words += [] if self.hidden else [data]


def test_warc(spark, sf, tmp_path):
    pages = table(spark, sf, "pages")
    rows = warc.derivatives(warc.responses(pages), ("page_id",)).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(rows) == 2 * len(html)
    for r in rows:
        page = html[r.page_id].encode()
        assert r.payload_digest == warc.digest(page) and r.block_digest == warc.digest(r.block.encode()) and r.n_bytes == len(r.block.encode())
        if r.type == "metadata":
            m = json.loads(r.block)
            assert m["Envelope"]["WARC-Header"]["WARC-Record-ID"] == r.refers_to and m["Envelope"]["HTTP-Response"]["Payload-Length"] == len(page)
            assert dict(m["Envelope"]["HTTP-Response"]["Headers"])["Content-Length"] == str(len(page))
            plain = Plain()
            plain.feed(html[r.page_id])
            assert [x["url"] for x in m["HTML"]["Links"] if x["path"] == "a/href"] == plain.links
        else:
            plain = Plain()
            plain.feed(html[r.page_id])
            assert "".join(r.block.split()) == "".join("".join(plain.words).split())
    assert len({r.record_id for r in rows}) == len(rows) and len({r.refers_to for r in rows}) == len(html)
    odd = spark.createDataFrame([(1, None, None), (2, "u", "<a href=x>t<p>a &lt; b<"), (2, "u", "<a href=x>t<p>a &lt; b<"), (None, "v", "")], "page_id long, url string, html string")
    out = warc.derivatives(warc.responses(odd), ("page_id",)).collect()
    assert len(out) == 8 and [r.block for r in out if r.type == "conversion"] == ["", "t\na < b<", "t\na < b<", ""]
    assert warc.derivatives(warc.responses(odd.limit(0))).count() == 0


@pytest.mark.parametrize("part", ["<a ", '<a b="c ', "<a '", "<!--", "<script>", "<a href='", "<title>", "&#9", "</"])
def test_a_megabyte_of_hostile_markup(part):
    """Each is read in a time in proportion to its length."""
    page = "<p>x</p>" + part * (1_000_000 // len(part))
    began = time.process_time()
    title, base, text, metas, links = warc.read_html(page)
    assert text.startswith("x") and not links and time.process_time() - began < 3


def records_of(path):
    """(headers, block) of each record; every gzip member must hold exactly one."""
    out = []
    for file in sorted(path.glob("part-*")):
        data = file.read_bytes()
        while data:
            member = zlib.decompressobj(31)
            record = member.decompress(data)
            assert member.eof
            data = member.unused_data
            if not record:
                continue
            head, _, rest = record.partition(b"\r\n\r\n")
            first, *lines = head.split(b"\r\n")
            headers = dict(x.split(b": ", 1) for x in lines)
            n = int(headers[b"Content-Length"])
            assert first == b"WARC/1.1" and len(headers) == len(lines) and rest[n:] == b"\r\n\r\n"
            out.append(({k.decode(): v.decode() for k, v in headers.items()}, rest[:n]))
    return out


def test_warc_files(spark, tmp_path):
    """A gzip member for each record, digests of the blocks, and no header that a URL brings in."""
    big = "".join(chr(97 + i % 23) for i in range(17_000_000))
    pages = spark.createDataFrame([(1, "http://a/b c\r\nX-Evil: 1", "<p>x"), (2, None, None), (3, "http://ü/", "<a href=y>é</a>"), (4, "http://long", big)], "page_id long, url string, html string")
    warc.write_warc(warc.derivatives(warc.responses(pages)).repartition(2), str(tmp_path / "w"))
    found = records_of(tmp_path / "w")
    assert len(found) == 8 and not any("X-Evil" in h for h, _ in found)
    for h, block in found:
        assert h["WARC-Payload-Digest"] == h["WARC-Block-Digest"] == warc.digest(block)
        if h["WARC-Type"] == "metadata":
            assert h["WARC-Refers-To-Payload-Digest"] == json.loads(block)["Envelope"]["WARC-Header"]["WARC-Payload-Digest"]
    sources = {}
    for h, _ in found:
        sources.setdefault(h["WARC-Refers-To"], set()).add(h["WARC-Refers-To-Payload-Digest"])
    assert len(sources) == 4 and all(len(x) == 1 for x in sources.values())
    uris = Counter(h.get("WARC-Target-URI") for h, _ in found)
    assert uris == {"http://a/b%20c%0D%0AX-Evil:%201": 2, None: 2, "http://ü/": 2, "http://long": 2}
    assert sorted(len(b) for h, b in found if h["WARC-Type"] == "conversion")[-1] == len(big)

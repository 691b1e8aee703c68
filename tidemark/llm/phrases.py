"""Phrase collocation mining by Rabin-Karp fingerprints.

Each task numbers the words of its texts and has prefix polynomials of the words' digests, so that the fingerprint of
any n-gram is one difference of two prefixes. Equal fingerprints of a chunk are counted together after the words
themselves were compared; a row with the count, a pointer to a document where it occurs and a check shuffles, added
up within the task first. The check is the count times DIGIT bits of a second digest, which is made from the words' bytes in
another way. Three passes, words, pairs and longer ones, take this course: an n-gram whose words or pairs are not all
frequent cannot be frequent, and a bitmap of fixed size, which may let more through but holds back nothing frequent,
keeps it from the shuffle.

Phrases are read for frequent fingerprints alone, in the documents that their pointers name. If count times digest of what
is read there isn't the check, then the fingerprint stands for different texts (or the pointer's for several documents, of which another fits),
and its phrases are counted by their texts.

Defined cases: a null text is empty, a null lang is the one in UNKNOWN; empty texts and empty tables have no phrases; repeated
rows count as often as they occur; equal ids are no matter, since a pointer goes by a hash of the whole row; very
long texts are cut into windows at word ends, with the next words after each; other columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, MAX_BROADCAST_ROWS, bounded, chunks, gathered, mix, packed, powers, table, texts, word_spans, written

LONGEST, MINIMUM, TOP, UNKNOWN = 5, 100, 2000, "und"
#: Bytes of text in one chunk, and in one window of a longer text.
CHUNK = 1 << 22
#: Bits of a bitmap of fingerprints: so many for each, within these bounds; it is broadcast, 32 MB at most.
BITS_EACH, LEAST_BITS, MOST_BITS = 128, 1 << 20, 1 << 28
#: Bits of the second digest in a check, and of a pointer.
DIGIT, POINTER = 16, 32
#: Rows that a task holds and adds up before it hands them on.
HELD = 1_500_000
#: Parts that a language's phrases are ranked in before the best of each are ranked together.
PARTS = 64

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_BETWEEN = _BREAK | _SPACE
_END = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
_WORD = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+")
_K = np.uint64(0x9E3779B97F4A7C15)


def seeds(langs: list[str]) -> np.ndarray:
    """A number for each language."""
    return np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs], np.uint64)


def digests(words: list[bytes]) -> np.ndarray:
    """Two numbers for each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def windows(data: np.ndarray, offsets: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Parts of a chunk: bytes, offsets, where they begin in their text, and before which byte n-grams of the part begin."""
    if len(offsets) > 2 or len(data) <= CHUNK:
        yield data, offsets, 0, len(data)
        return
    begin, whole = 0, memoryview(np.ascontiguousarray(data))
    while begin < len(data):
        cut = _END.search(whole, begin + CHUNK) if begin + CHUNK < len(data) else None
        end = cut.start() if cut else len(data)
        after = [m.end() for m in islice(_WORD.finditer(whole, end), longest - 1)]
        until = after[-1] if after else end
        yield data[begin:until], np.array([0, until - begin]), begin, end - begin
        begin = end


class Grams:
    """The n-grams of a part: numbered words, and prefix polynomials of their digests."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, languages: np.ndarray, own: int, bits: int = 64):
        low = _LOWER[data]
        self.starts, ends, bounds = word_spans(low, offsets, _BETWEEN)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        self.piece = np.cumsum(_BREAK[low])[self.starts] + self.text if len(low) else self.text
        sizes = np.zeros(len(ends) + 1, np.int64)
        np.cumsum(ends - self.starts, out=sizes[1:])
        self.words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(sizes), pa.py_buffer(low[~_BETWEEN[low]])]).dictionary_encode()
        self.codes = self.words.indices.to_numpy(zero_copy_only=False)
        first, self.second = digests(self.words.dictionary.to_pylist()).T
        self.total = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum(first[self.codes] * powers(len(self.codes)), out=self.total[1:])
        self.back, self.language, self.mask = powers(len(self.codes), True), languages[self.text], np.uint64((1 << bits) - 1)
        self.n = int(np.searchsorted(self.starts, own))  # words that n-grams of this part begin with

    def starting(self, k: int) -> np.ndarray:
        """The words that k-grams within a piece begin with."""
        last = np.arange(min(self.n, len(self.codes) - k + 1))
        return last[self.piece[last] == self.piece[last + k - 1]]

    def prints(self, k: int, at: np.ndarray) -> np.ndarray:
        """The fingerprint of the k-gram from each word on."""
        return mix((self.total[at + k] - self.total[at]) * self.back[at] + self.language[at] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) & self.mask

    def seconds(self, k: int, at: np.ndarray) -> np.ndarray:
        """The second digest of those."""
        out = self.language[at]
        for j in range(k):
            out = mix(out * _K + self.second[self.codes[at + j]])
        return out

    def counted(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, number of occurrences and first one of each k-gram among those from the words at."""
        prints = self.prints(k, at)
        order = np.argsort(prints, kind="stable")
        prints, at = prints[order], at[order]
        new = np.concatenate([[True], prints[1:] != prints[:-1]])[: len(at)]
        group = np.cumsum(new) - 1
        lead = at[new][group]
        odd = self.language[at] != self.language[lead]
        for j in range(k):
            odd |= self.codes[at + j] != self.codes[lead + j]
        # an occurrence that isn't what its fingerprint stands for in this chunk is a row of its own
        number = np.bincount(group[~odd], minlength=int(new.sum()))
        return np.concatenate([prints[new], prints[odd]]), np.concatenate([number, np.ones(int(odd.sum()), np.int64)]), np.concatenate([at[new], at[odd]])

    def sizes(self, languages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, number of words and first text of each language of the texts."""
        number = np.bincount(self.text[: self.n], minlength=len(languages))
        distinct, first, which = np.unique(languages, return_index=True, return_inverse=True)
        return mix(distinct + _K) & self.mask, np.bincount(which, number).astype(np.int64), first

    def phrases(self, k: int, at: np.ndarray) -> pa.Array:
        """The k-grams from the words at, joined by single spaces."""
        data, offsets = packed(self.words.dictionary)
        data, ends = gathered(data, offsets, np.array([self.codes[at + j] for j in range(k)]).T.ravel())
        data = np.insert(data, ends[1:-1], 32) if len(ends) > 1 else data  # one space after each word but the last
        ends = ends + np.concatenate([[0], np.minimum(np.arange(1, len(ends)), max(0, len(ends) - 2))])
        begin, end = ends[:-1][::k], ends[1:][k - 1 :: k] - (np.arange(1, len(at) + 1) < len(at))
        bounds = np.zeros(len(at) + 1, np.int64)
        np.cumsum(end - begin, out=bounds[1:])
        keep = np.ones(len(data), bool)
        keep[end[:-1]] = False  # the spaces between two phrases
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[keep]))]).cast(pa.large_string()).cast(pa.string())


class Bitmap:
    """Flags of fingerprints, by their lowest bits."""

    def __init__(self, size: int, parts: dict[int, bytes]):
        self.mask, self.data = np.uint64(size - 1), np.zeros(size // 8, np.uint8)
        for i, part in parts.items():
            self.data[i * 4096 : (i + 1) * 4096] = np.frombuffer(part, np.uint8)

    def holds(self, prints: np.ndarray) -> np.ndarray:
        place = (prints & self.mask).astype(np.int64)
        return (self.data[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def bitmap(rows: DataFrame):
    """The fingerprints of rows in a bitmap that all tasks share. Spark builds it in parts of 4096 bytes."""
    size = LEAST_BITS
    while size < min(MOST_BITS, rows.count() * BITS_EACH):
        size *= 2
    place = F.col("print").bitwiseAND(size - 1)
    parts = rows.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("bits")).collect()
    return rows.sparkSession.sparkContext.broadcast(Bitmap(size, {r.part: bytes(r.bits) for r in parts}))


def parted(batches, longest: int, bits: int):
    """The n-grams of each part of the batches, with the rows' doc, and where the part begins in its text."""
    for batch, data, offsets in chunks(batches, limit=CHUNK):
        names = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        known = {x: s for x, s in zip(dict.fromkeys(names), seeds([*dict.fromkeys(names)]))}
        languages, docs = np.array([known[x] for x in names], np.uint64), batch.column(batch.schema.get_field_index("doc")).to_numpy()
        for part, ends, begin, own in windows(data, offsets, longest):
            yield Grams(part, ends, languages, own, bits), languages, docs, ends, begin, names


def added_up(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of fingerprints, counts, checks and pointers with one row for each fingerprint: the sums, and the least pointer."""
    held, size = [], 0

    def whole():
        prints, *sums, docs = [np.concatenate(c) for c in zip(*held)]
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])[: len(order)])
        if not len(first):
            return prints, *sums, docs
        return prints[first], *[np.add.reduceat(c[order], first) for c in sums], np.minimum.reduceat(docs[order], first)

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > HELD:
            held = [whole()]
            size = len(held[0][0])
            if size > HELD // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield whole()


def pruned(grams: Grams, words, pairs) -> np.ndarray:
    """Flags of the words that are frequent or, with pairs, of those that begin a frequent pair of frequent words; words and pairs: bitmaps."""
    good = np.ones(len(grams.codes), bool)
    if words is not None:
        good = words.value.holds(grams.prints(1, np.arange(len(good))))
    if pairs is not None:
        at = np.arange(max(0, len(good) - 1))
        at = at[(grams.piece[at] == grams.piece[at + 1]) & good[:-1] & good[1:]]
        good = np.zeros(len(good), bool)
        good[at[pairs.value.holds(grams.prints(2, at))]] = True
    return good


def possible(grams: Grams, k: int, good: np.ndarray, of_pairs: bool) -> np.ndarray:
    """The words from which a k-gram can be frequent."""
    at = grams.starting(k)
    for j in range(k - of_pairs):
        at = at[good[at + j]]
    return at


def digits(seconds: np.ndarray) -> np.ndarray:
    """What checks hold of second digests."""
    return (seconds & np.uint64((1 << DIGIT) - 1)).astype(np.int64)


def frequent(docs: DataFrame, lengths: list[int], longest: int, bits: int, minimum: int, words=None, pairs=None) -> DataFrame:
    """The fingerprints of n-grams of these lengths that occur often enough, as far as fingerprints tell, with counts, checks and pointers; 0
    stands for all words of a language."""

    def found(batches):
        for grams, languages, docs, *_ in parted(batches, longest, bits):
            good = pruned(grams, words, pairs)
            for k in lengths:
                if not k:
                    prints, number, first = grams.sizes(languages)
                    yield prints.view(np.int64), number, number * digits(mix(languages[first])), docs[first]
                    continue
                prints, number, lead = grams.counted(k, possible(grams, k, good, pairs is not None))
                yield prints.view(np.int64), number, number * digits(grams.seconds(k, lead)), docs[grams.text[lead]]

    def run(batches):
        for columns in added_up(found(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["print", "n", "sum", "doc"])

    rows = docs.mapInArrow(run, "print long, n long, sum long, doc long").groupBy("print")
    return written(rows.agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("doc").alias("doc")).filter(F.col("n") >= minimum))


def read_out(docs: DataFrame, rows: DataFrame, longest: int, bits: int) -> DataFrame:
    """print, lang, k, phrase and f of fingerprints, from the documents that their pointers name, where their texts fit the check."""

    def fitting(prints, digit, wanted):
        """Which prints have that digit, and how often they occur."""
        place = np.minimum(np.searchsorted(wanted[0], prints), len(wanted[0]) - 1)
        fits = (wanted[0][place] == prints) & (wanted[1][place] * digit == wanted[2][place])
        return np.flatnonzero(fits), wanted[1][place]

    def run(batches):
        for batch in batches:
            found = batch.column(batch.schema.get_field_index("found")).flatten()
            listed = [found.field(i).to_numpy() for i in range(3)]
            order = np.argsort(listed[0].view(np.uint64), kind="stable")
            wanted = [listed[0].view(np.uint64)[order], listed[1][order], listed[2][order]]
            for grams, languages, _, _, _, names in parted([batch], longest, bits):
                for k in range(longest + 1):
                    if not k:
                        prints, _, first = grams.sizes(languages)
                        good, n = fitting(prints, digits(mix(languages[first])), wanted)
                        lang, phrases = [names[i] for i in first[good]], pa.array([""] * len(good), pa.string())
                    else:
                        at = grams.starting(k)
                        at = at[np.isin(grams.prints(k, at), wanted[0])]
                        prints, _, lead = grams.counted(k, at)
                        good, n = fitting(prints, digits(grams.seconds(k, lead)), wanted)
                        lang, phrases = [names[i] for i in grams.text[lead[good]]], grams.phrases(k, lead[good])
                    if len(good):
                        columns = [pa.array(prints[good].view(np.int64)), pa.array(lang, pa.string()), pa.array(np.full(len(good), k, np.int32)), phrases, pa.array(n[good])]
                        yield pa.RecordBatch.from_arrays(columns, names=["print", "lang", "k", "phrase", "f"])

    by_doc = written(rows.groupBy("doc").agg(F.collect_list(F.struct("print", "n", "sum")).alias("found")))
    some = docs.join(bounded(by_doc.select("doc"), by_doc.count()), "doc", "left_semi").dropDuplicates(["doc", "proof"])
    return written(some.join(by_doc, "doc").select("doc", "lang", "text", "found").mapInArrow(run, "print long, lang string, k int, phrase string, f long").distinct())


def by_text(docs: DataFrame, rows: DataFrame, longest: int, bits: int, minimum: int) -> DataFrame:
    """lang, k, phrase and f of the n-grams that have one of the rows' fingerprints, counted by their texts."""
    wanted = bitmap(rows)

    def run(batches):
        for grams, languages, _, _, _, names in parted(batches, longest, bits):
            for k in range(longest + 1):
                if not k:
                    prints, number, first = grams.sizes(languages)
                    found = pa.array([""] * len(first), pa.string())
                else:
                    at = grams.starting(k)
                    at = at[wanted.value.holds(grams.prints(k, at))]
                    if not len(at):
                        continue
                    prints, number, lead = grams.counted(k, at)
                    first, found = grams.text[lead], grams.phrases(k, lead)
                columns = [pa.array(prints.view(np.int64)), pa.array(number), pa.array(np.full(len(first), k, np.int32)), pa.array([names[i] for i in first], pa.string()), found]
                yield pa.RecordBatch.from_arrays(columns, names=["print", "n", "k", "lang", "phrase"])

    found = docs.mapInArrow(run, "print long, n long, k int, lang string, phrase string")
    found = found.join(bounded(rows.select("print"), rows.count()), "print", "left_semi")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= minimum)


def frequent_phrases(docs: DataFrame, minimum: int = MINIMUM, longest: int = LONGEST, bits: int = 64) -> DataFrame:
    """lang, k, phrase and f of all phrases of 1 to longest words (7 at most) that occur at least minimum times, and the number of a language's
    words as f of its phrase of no words. bits: of a fingerprint; fewer give more collisions, and the same result."""
    identity = F.xxhash64(F.col("doc_id").cast("string"), F.col("lang").cast("string"), texts(docs))
    docs = docs.select(identity.bitwiseAND((1 << POINTER) - 1).alias("doc"), identity.alias("proof"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), texts(docs).alias("text"))
    source = docs.select("doc", "lang", "text")
    one = frequent(source, [0, 1], longest, bits, minimum)
    words = bitmap(one)
    two = frequent(source, [2], longest, bits, minimum, words)
    more = frequent(source, [*range(3, longest + 1)], longest, bits, minimum, words, bitmap(two))
    found = one.unionByName(two).unionByName(more)
    out = read_out(docs, found, longest, bits)
    twofold = written(found.join(out.select("print"), "print", "left_anti"))
    out = out.drop("print")
    if twofold.count():
        out = out.unionByName(by_text(source, twofold, longest, bits, minimum))
    return written(out)


def scored(grams: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the phrases of two words or more that no longer one as frequent holds."""
    several = grams.filter("k > 1")
    held = grams.filter("k > 2").select("lang", "f", F.split("phrase", " ").alias("w"))
    held = held.select("lang", "f", F.explode(F.array(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"))).alias("w"))
    held = held.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("f").alias("longer"))
    several = several.join(held, ["lang", "phrase"], "left").filter("longer is null or longer < f").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = several.select("*", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.expr("slice(w, 1, cut)"), " ").alias("left"), F.array_join(F.expr("slice(w, cut + 1, size(w))"), " ").alias("right"))
    parts = grams.filter("k > 0")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    words = grams.filter("k = 0").select("lang", F.col("f").alias("n"))
    cuts = cuts.join(F.broadcast(words) if words.count() <= MAX_BROADCAST_ROWS else words, "lang")
    wide = "cast({} as decimal(19, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * ({wide.format('a')} * {wide.format('n')})) div ({wide.format('l')} * {wide.format('r')})")
    least = F.min(F.struct(score.alias("score"), "cut", "l", "r", "n")).alias("m")
    return cuts.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "m.l", "m.r", "m.n", "m.score")


def collocations(docs: DataFrame, minimum: int = MINIMUM, longest: int = LONGEST, top: int = TOP, bits: int = 64) -> DataFrame:
    """Each language's first phrases: by score, then by frequency, then by their bytes."""
    rows = scored(frequent_phrases(docs, minimum, longest, bits)).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places, (VALUES (1), (2), (3), (4), (5)) AS sizes(k) WHERE i + k - 1 <= len(w)
), f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
several AS (
  SELECT lang, k, phrase, f AS a FROM f AS c WHERE k > 1
  AND NOT EXISTS (SELECT 1 FROM f AS g WHERE g.lang = c.lang AND g.k > c.k AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * g.f >= 100 * c.f)
), cuts AS (
  SELECT s.lang, s.phrase, s.a, j.k AS cut, array_to_string(string_split(phrase, ' ')[1:j.k], ' ') AS part_l, array_to_string(string_split(phrase, ' ')[j.k + 1:], ' ') AS part_r
  FROM several AS s, (VALUES (1), (2), (3), (4)) AS j(k) WHERE j.k < s.k
), valued AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score, cut
  FROM cuts AS c JOIN f AS x ON x.lang = c.lang AND x.phrase = part_l JOIN f AS y ON y.lang = c.lang AND y.phrase = part_r JOIN totals AS t ON t.lang = c.lang
), best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

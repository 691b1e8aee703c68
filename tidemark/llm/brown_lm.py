"""Language-model scoring with Brown class-based n-grams.

Exchange clustering assigns the CLUSTERED most frequent words, and the shape groups that hold all other words, to
classes so that the mutual information of adjacent classes grows. That is the start: then every other word seen LEAST
times or more moves from its shape group's class to its best one, by the classes it has before and after it; they move
at once, and that is taken back if it does not raise the mutual information. Only words seen less often, and unknown
ones, stay with their shape group. A text's probability is the product of class transitions and word emissions.
Transitions are smoothed towards class frequencies; in a shape group, unknown words together have the Good-Turing mass
of words seen once, half of the group at most.

Counts of words, of words beside classes and of adjacent classes are taken over all training texts. The KNOWN most
frequent words' counts and classes are broadcast, a fixed number; those of a text's rarer words are joined. Texts are
encoded as ranks of words once, and written. Tokens are words of A-Z lower-cased, and one end per text.

Defined cases: a null text is empty and has the one token end; with no training text every token is unknown; a null
doc_id counts as an empty id where rows are split, and stays null; repeated rows are scored one by one; an empty
table gives an empty result; other columns of the input are ignored."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, packed, remainder, table, texts, word_codes, word_hashes, written

#: Words that are clustered, shape groups of the others, classes, rounds of exchange at most.
CLUSTERED, SHAPES, CLASSES, ROUNDS = 1000, 32, 64, 8
#: Most frequent words whose counts are broadcast, pseudo-count of class frequencies in a transition.
KNOWN, BACK_OFF = 200_000, 50.0
#: Occurrences from which a word has a class of its own.
LEAST = 2
#: Bytes of text that are split into words at once, texts and words that numpy works on at once, pairs kept before they are passed on.
CHUNK, TEXTS, WORDS, PAIRS = 1 << 23, 1000, 500, 1 << 21
END = CLUSTERED + SHAPES
#: Places of a word's neighbours: a class after it, then a class before it.
SLOTS = 2 * (CLASSES + 1)


def shape(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SHAPES


SHAPE_SQL = f"cast(pmod(crc32(substring(token, greatest(length(token) - 1, 1), 2)), {SHAPES}) as int)"


def counted(batches):
    """Counts of the words of each chunk, and of its texts under the empty word."""
    for batch, data, offsets in chunks(batches, limit=CHUNK):
        codes, words, _ = word_codes(data, offsets, lower=True)
        counts = np.bincount(codes, minlength=len(words))
        tokens = pa.concat_arrays([words.cast(pa.binary()), pa.array([b""], pa.binary())])
        yield pa.RecordBatch.from_arrays([tokens, pa.array(np.append(counts, batch.num_rows))], names=["token", "c"])


class Vocabulary:
    """The most frequent words in order of their rank, with counts; the first CLUSTERED have a unit of their own."""

    def __init__(self, tokens: list[bytes], counts: np.ndarray):
        self.tokens, self.counts = pa.array(tokens, pa.large_binary()), counts
        self.units = np.array([i if i < CLUSTERED else CLUSTERED + shape(t) for i, t in enumerate(tokens)] or [0], np.int64)

    def ranks(self, words: pa.Array) -> np.ndarray:
        """Of each word; -1 for those that are none of the vocabulary."""
        return pc.fill_null(pc.index_in(words.cast(pa.large_binary()), self.tokens), -1).to_numpy().astype(np.int64)


ENCODED = "ids array<int>, rare array<binary>, groups array<int>"


def encoded(shared):
    """Each text as ranks of its words, where below zero -1 less the place in rare; rare words with their shape groups.

    The columns in front of text are kept."""

    def encode(batches):
        vocabulary = shared.value
        for batch, data, offsets in chunks(batches, limit=CHUNK):
            codes, words, counts = word_codes(data, offsets, lower=True)
            ranks = vocabulary.ranks(words)
            ids, of = ranks[codes], np.repeat(np.arange(batch.num_rows), np.diff(counts))
            # the distinct rare words of each text
            low = np.flatnonzero(ids < 0)
            pairs, place = np.unique(of[low] * max(1, len(words)) + codes[low], return_inverse=True)
            ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * max(1, len(words)))
            ids[low] = -1 - (place - ends[of[low]])
            rare = pairs % max(1, len(words))
            missing = np.flatnonzero(ranks < 0)
            groups = np.zeros(max(1, len(words)), np.int32)
            groups[missing] = [shape(w) for w in words.take(pa.array(missing)).to_pylist()]
            lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            columns = [lists(counts, pa.array(ids, pa.int32())), lists(ends, words.take(pa.array(rare)).cast(pa.binary())), lists(ends, pa.array(groups[rare]))]
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *columns], names=[*keep, "ids", "rare", "groups"])

    return encode


def numbers(words: pa.Array) -> np.ndarray:
    """A number below zero for each word, by 55 bits of its hash; words of the vocabulary go by their ranks instead."""
    return -1 - (word_hashes(*packed(words))[0] >> np.uint64(9)).view(np.int64)


def numbered(shared):
    """token, c and word: its rank in the vocabulary, else its number."""

    def number(batches):
        for batch in batches:
            tokens = batch.column("token")
            ranks = shared.value.ranks(tokens)
            yield pa.RecordBatch.from_arrays([tokens, batch.column("c"), pa.array(np.where(ranks < 0, numbers(tokens), ranks))], names=["token", "c", "word"])

    return number


class Texts:
    """Encoded texts end to end: ranks, place of rare words (-1: none), and the text that each word is of.

    found, where it is there, has c and class of rare words (class -1: their shape group's); moved: whether classes count."""

    def __init__(self, batch: pa.RecordBatch, moved: bool = True):
        lists = {n: pc.fill_null(batch.column(n), []) for n in batch.schema.names if n in ("ids", "rare", "groups", "found")}
        flat = lambda n: lists[n].flatten()
        sizes = lambda n: pc.list_value_length(lists[n]).to_numpy().astype(np.int64)
        self.rows, self.sizes = batch.num_rows, sizes("ids")
        self.of, self.ranks = np.repeat(np.arange(self.rows), self.sizes), flat("ids").to_numpy().astype(np.int64)
        begin = np.cumsum(sizes("groups")) - sizes("groups")
        self.tokens, self.groups = flat("rare") if "rare" in lists else None, flat("groups").to_numpy().astype(np.int64)
        self.place = np.where(self.ranks < 0, begin[self.of] - 1 - self.ranks, -1)
        self.rare_counts, self.rare_classes = np.zeros(len(self.groups), np.int64), np.full(len(self.groups), -1)
        if "found" in lists:
            found = flat("found")
            at = np.repeat(begin, sizes("found")) + found.field("at").to_numpy()
            self.rare_counts[at] = found.field("c").to_numpy()
            if moved:
                self.rare_classes[at] = found.field("class").to_numpy()

    def units(self, vocabulary: Vocabulary) -> np.ndarray:
        units = vocabulary.units[np.maximum(self.ranks, 0)]
        rare = self.ranks < 0
        units[rare] = CLUSTERED + self.groups[self.place[rare]]
        return units

    def classes(self, classes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Of each word; classes: of ranks, of: of units."""
        out = classes[np.maximum(self.ranks, 0)]
        rare = self.ranks < 0
        out[rare] = np.where(self.rare_classes < 0, of[CLUSTERED + self.groups], self.rare_classes)[self.place[rare]]
        return out

    def ended(self, values: np.ndarray, end) -> np.ndarray:
        """values of the words, with the end's after each text."""
        return np.insert(values, np.cumsum(self.sizes), end)


def parts(batches, moved: bool = True):
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield Texts(batch.slice(at, TEXTS), moved), batch.slice(at, TEXTS)


def adjacent(shared, size: int):
    """Counts of adjacent codes below size, each text between two ends, which have the last code.

    shared: the vocabulary, and the classes of ranks and of units, or None where units themselves are counted."""

    def count(batches):
        vocabulary, classes, of = shared.value
        total = np.zeros(size * size, np.int64)
        for t, _ in parts(batches):
            ends = t.ended(t.units(vocabulary) if of is None else t.classes(classes, of), size - 1)
            total += np.bincount(np.concatenate([[size - 1], ends[:-1]]) * size + ends, minlength=size * size)
        pairs = np.flatnonzero(total)
        for at in range(0, len(pairs), 1 << 16):
            p = pairs[at : at + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"a": (p // size).astype(np.int32), "b": (p % size).astype(np.int32), "c": total[p]})

    return count


def adjacent_counts(learnt: DataFrame, state, size: int) -> np.ndarray:
    cells = learnt.mapInArrow(adjacent(state, size), "a int, b int, c long").groupBy("a", "b").agg(F.sum("c").alias("c")).toArrow()  # size ** 2 at most
    out = np.zeros((size, size))
    out[cells["a"].to_numpy(), cells["b"].to_numpy()] = cells["c"].to_numpy()
    return out


def neighbours(shared):
    """Counts of words beyond the clustered ones beside classes: code (256 * rank or number of the word + slot) and n."""

    def count(batches):
        vocabulary, classes, of = shared.value
        size, kept, n = CLASSES + 1, [], 0
        moving = vocabulary.counts >= LEAST
        moving[:CLUSTERED] = False
        ranks = np.arange(len(moving))

        def rows(words, codes):
            codes, counts = np.unique(codes, return_counts=True)
            for at in range(0, len(codes), 1 << 16):
                word, slot = np.divmod(codes[at : at + (1 << 16)], SLOTS)
                yield pa.RecordBatch.from_arrays([pa.array(words[word] * 256 + slot), pa.array(counts[at : at + (1 << 16)], pa.int32())], names=["code", "n"])

        for t, _ in parts(batches):
            ends = np.concatenate([[CLASSES], t.ended(t.classes(classes, of), CLASSES)])
            at, low = np.arange(len(t.of)) + t.of + 1, t.ranks < 0

            def codes(chosen, words):
                return np.concatenate([words * SLOTS + ends[at[chosen] + 1], words * SLOTS + size + ends[at[chosen] - 1]])

            known, rare = np.flatnonzero(~low & moving[np.maximum(t.ranks, 0)]), np.flatnonzero(low)
            kept.append(codes(known, t.ranks[known]))
            n += len(kept[-1])
            if len(rare):
                yield from rows(numbers(t.tokens), codes(rare, t.place[rare]))
            if n > PAIRS:
                yield from rows(ranks, np.concatenate(kept))
                kept, n = [], 0
        if n:
            yield from rows(ranks, np.concatenate(kept))

    return count


def xlx(x):
    return x * np.log(np.maximum(x, 1.0))


def information(joint: np.ndarray) -> float:
    """What exchange raises: the mutual information of adjacent classes, up to constants."""
    return float(xlx(joint).sum() - xlx(joint.sum(0)).sum() - xlx(joint.sum(1)).sum())


def best_classes(joint: np.ndarray, was: np.ndarray, word: np.ndarray, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class that each word alone raises information() most in; word (in order), slot and n: its neighbours."""
    classes, k, side = len(joint) - 1, slot % len(joint), slot // len(joint)
    gain, every = np.zeros((len(was), classes)), np.arange(len(was))
    for s, table_ in ((0, joint), (1, joint.T)):  # of each entry: the cell of a class and the neighbour's class
        here = side == s
        w, more = word[here], n[here].astype(float)
        cells = table_[:classes, k[here]].T
        own = was[w][:, None] == np.arange(classes)
        cells = np.maximum(cells - own * more[:, None], 0)
        change = xlx(cells + more[:, None]) - xlx(cells)
        if len(w):
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            gain[w[first]] += np.add.reduceat(change, first)
        whole = np.bincount(w, more, len(was))[:, None]
        sums = np.maximum(table_.sum(1)[:classes] - (was[:, None] == np.arange(classes)) * whole, 0)
        gain -= xlx(sums + whole) - xlx(sums)
    to = gain.argmax(1)
    return np.where(gain[every, to] > gain[every, was] + 1e-9, to, was)


def settled(joint: np.ndarray, of: np.ndarray):
    """token, c, word and class of each word, from what is counted beside it."""

    def settle(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, WORDS):
                batch = whole.slice(at, WORDS)
                was = np.array([of[CLUSTERED + shape(t)] for t in batch.column("token").to_pylist()], np.int64)
                beside = batch.column("beside")
                word, beside = np.repeat(np.arange(batch.num_rows), pc.list_value_length(beside).to_numpy()), beside.flatten()
                to = best_classes(joint, was, word, beside.field("slot").to_numpy().astype(np.int64), beside.field("n").to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("token", "c", "word")), pa.array(to.astype(np.int32))], names=["token", "c", "word", "class"])

    return settle


def exchanged(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each unit; the last unit, the end, has the last class to itself.

    Units are visited by frequency; each moves to the class that most raises the sum of n * log n over class pairs
    less that over classes."""
    n = len(pairs) - 1
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1))[:n], kind="stable")
    of = np.empty(n + 1, np.int64)
    of[order] = np.arange(n) % classes
    of[n] = classes
    pairs = pairs.astype(float)
    hot = np.eye(classes + 1)[of]
    right, left = pairs @ hot, pairs.T @ hot  # unit -> class after it, class before it
    table_ = hot.T @ right
    for _ in range(rounds):
        moved = 0
        for w in order.tolist():
            was, r, l, own = of[w], right[w].copy(), left[w].copy(), pairs[w, w]
            if not r.any() and not l.any():
                continue
            r[was] -= own
            l[was] -= own
            table_[was] -= r
            table_[:, was] -= l
            table_[was, was] -= own
            rows, columns = table_.sum(1)[:classes], table_.sum(0)[:classes]
            gain = (xlx(table_ + r) - xlx(table_)).sum(1)[:classes] + (xlx(table_ + l[:, None]) - xlx(table_)).sum(0)[:classes]
            d = np.diagonal(table_)[:classes]
            gain += xlx(d + r[:classes] + l[:classes] + own) - xlx(d + r[:classes]) - xlx(d + l[:classes]) + xlx(d)
            gain -= xlx(rows + r.sum() + own) - xlx(rows) + xlx(columns + l.sum() + own) - xlx(columns)
            to = int(np.argmax(gain))
            if gain[to] <= gain[was] + 1e-9:
                to = was
            table_[to] += r
            table_[:, to] += l
            table_[to, to] += own
            if to != was:
                moved += 1
                of[w] = to
                right[:, was] -= pairs[:, w]
                right[:, to] += pairs[:, w]
                left[:, was] -= pairs[w]
                left[:, to] += pairs[w]
        if not moved:
            break
    return of


class Model:
    """Log10 probabilities of class transitions, units within classes and, by shape group, of words.

    joint and units, the counts of adjacent classes and of units, are those of pairs unless other words have classes too."""

    def __init__(self, pairs: np.ndarray, of: np.ndarray, group_size: np.ndarray, group_once: np.ndarray, classes: int = CLASSES, joint: np.ndarray | None = None, units: np.ndarray | None = None):
        hot = np.eye(classes + 1)[of]
        joint = hot.T @ pairs @ hot if joint is None else joint
        units = (pairs.sum(0) if units is None else units) + 0.1  # each unit may occur
        by_class = joint.sum(0) + 0.1 * hot.sum(0)
        self.by_class = np.log10(np.maximum(by_class, 0.1))
        self.of, self.moves = of, np.log10((joint + BACK_OFF * by_class / by_class.sum()) / (joint.sum(1, keepdims=True) + BACK_OFF))
        self.emits = np.log10(units / by_class[of])
        unknown = np.clip((group_once + 0.5) / (group_size + 1.0), 1e-9, 0.5)
        self.unknown, self.known = np.log10(unknown), np.log10(1 - unknown) - np.log10(np.maximum(group_size, 1))


def scored(shared, words: int, types: int):
    """Per text: doc_id, n_tokens, n_known, base_score and score. shared: vocabulary, model, classes of ranks, whether words moved."""
    base_log = np.log10(float(words + types + 1))

    def score(batches):
        vocabulary, model, classes, moved = shared.value
        end_count = vocabulary.ends
        for t, batch in parts(batches, moved):
            units, c, rare = t.units(vocabulary), t.classes(classes, model.of), t.ranks < 0
            n = vocabulary.counts[np.maximum(t.ranks, 0)].astype(np.int64)
            n[rare] = t.rare_counts[t.place[rare]]
            log_n = np.log10(np.maximum(n, 1))
            group = np.maximum(units - CLUSTERED, 0)
            emits = np.where(units < CLUSTERED, model.emits[units], np.where(n >= LEAST, log_n - model.by_class[c], model.emits[units] + np.where(n > 0, log_n + model.known[group], model.unknown[group])))
            ends = t.ended(c, CLASSES)
            steps = model.moves[np.concatenate([[CLASSES], ends[:-1]]), ends] + t.ended(emits, model.emits[END])
            sums = lambda of, x: np.bincount(of, x, t.rows)
            base = sums(t.of, np.log10(n + 1.0)) + np.log10(end_count + 1.0) - base_log * (t.sizes + 1)
            known = sums(t.of, n > 0).astype(np.int64) + (end_count > 0)
            total = sums(np.repeat(np.arange(t.rows), t.sizes + 1), steps)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(t.sizes + 1), pa.array(known), pa.array(base), pa.array(total)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return score


def with_found(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Encoded texts with c and class of their rare words that are among words (token, c, class)."""
    found = rows.select("_row", F.posexplode("rare").alias("at", "token")).join(words, "token")
    found = found.groupBy("_row").agg(F.collect_list(F.struct("at", "c", "class")).alias("found"))
    return rows.drop("rare").join(found, "_row", "left")


def scores(docs: DataFrame, train: DataFrame | Column) -> DataFrame:
    """docs' doc_id with n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score, learning from train:
    texts of its own, or a condition on docs."""
    spark = docs.sparkSession
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}"
    if isinstance(train, Column):
        both = docs.select("doc_id", F.lit(True).alias("_asked"), train.alias("_train"), "text")
    else:
        own = train.select(F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), F.lit(False).alias("_asked"), F.lit(True).alias("_train"), "text")
        both = docs.select("doc_id", F.lit(True).alias("_asked"), F.lit(False).alias("_train"), "text").unionByName(own)
    counts = written(both.filter("_train").select("text").mapInArrow(counted, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")))
    ends = sum(r.c for r in counts.filter("length(token) = 0").collect())
    counts = counts.filter("length(token) > 0")
    totals = counts.agg(F.sum("c"), F.count("*")).first()
    n, types = (totals[0] or 0) + ends, totals[1] + (ends > 0)
    top = counts.orderBy(F.desc("c"), "token").limit(KNOWN).toArrow()
    tokens, top_counts = top["token"].to_pylist(), top["c"].to_numpy()
    vocabulary = Vocabulary(tokens, top_counts if len(tokens) else np.zeros(1))
    vocabulary.ends = ends
    shared = spark.sparkContext.broadcast(vocabulary)
    front = f"_row long, {kind}, _asked boolean, _train boolean"
    rows = both.select(F.monotonically_increasing_id().alias("_row"), "*").mapInArrow(encoded(shared), f"{front}, {ENCODED}")
    rows = written(rows.filter("_asked or _train"))
    learnt = rows.filter("_train")
    pairs = adjacent_counts(learnt, spark.sparkContext.broadcast((vocabulary, None, None)), END + 1)
    of = exchanged(pairs)
    hot = np.eye(CLASSES + 1)[of]
    start = hot.T @ pairs @ hot

    def after(place: int):
        """Whether a word comes after that many in the order of the vocabulary."""
        c, token = int(top_counts[place - 1]), tokens[place - 1]
        return (F.col("c") < c) | ((F.col("c") == c) & (F.col("token") > F.lit(token)))

    beyond = counts.filter(F.lit(False) if len(tokens) < CLUSTERED else after(CLUSTERED))
    classes = of[vocabulary.units]
    words = beyond.filter(F.col("c") >= LEAST).mapInArrow(numbered(shared), "token binary, c long, word long")
    beside = learnt.mapInArrow(neighbours(spark.sparkContext.broadcast((vocabulary, classes, of))), "code long, n int")
    word = F.shiftright("code", 8)
    beside = beside.repartition(word).groupBy(word.alias("word"), F.col("code").bitwiseAND(F.lit(255)).cast("int").alias("slot")).agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("beside"))
    words = written(beside.join(words, "word").select("token", "c", "word", "beside").mapInArrow(settled(start, of), "token binary, c long, word long, class int"))
    known = words.filter("word >= 0").select("word", "class").toArrow()  # KNOWN words at most
    moved = classes.copy()
    moved[known["word"].to_numpy()] = known["class"].to_numpy()
    if len(tokens) == KNOWN:  # there may be rarer words
        rare = counts.filter(after(KNOWN)).join(words.filter("word < 0").select("token", "class"), "token", "left").fillna(-1, "class")
        rows = written(with_found(rows, rare))
    joint = adjacent_counts(rows.filter("_train"), spark.sparkContext.broadcast((vocabulary, moved, of)), CLASSES + 1)
    better = information(joint) > information(start)
    once = np.zeros(SHAPES)
    for r in beyond.filter(F.col("c") < LEAST).groupBy(F.expr(SHAPE_SQL).alias("g")).agg(F.sum("c").alias("c")).collect():
        once[r.g] = r.c
    heads = np.zeros(CLUSTERED)
    heads[: len(tokens)] = top_counts[:CLUSTERED]
    model = Model(pairs, of, once, once, joint=joint if better else start, units=np.concatenate([heads, once, [ends]]))
    state = spark.sparkContext.broadcast((vocabulary, model, moved if better else classes, better))
    out = rows.filter("_asked").mapInArrow(scored(state, n, types), f"{kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", texts(table(spark, sf_dir, "documents")).alias("text"))
    out = scores(docs, remainder("doc_id", 7) != 2)
    return out.withColumn("held_out", remainder("doc_id", 7) == 2).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))

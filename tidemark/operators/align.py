"""Alignment of sentences with timed words, chapter by chapter: a sentence is sought from where the one before it ended.

Inputs: sentences (chapter, index, text) and words (chapter, pos, word, start, end). Outputs: chapter, index, start, end,
estimated. A sentence that isn't found starts where the one before it ends and lasts by the strategy's rule; a
strategy drops such sentences in front of the first found one, but 'fuzzy' gives them a second each from 0. A chapter is
one row, as its text is; sentences of equal index go by their texts, null texts and words are empty."""

from __future__ import annotations

import re
from collections.abc import Callable, Generator, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import rounded
from tidemark.functions.text import normalise, tokens
from tidemark.operators import windows

STRATEGIES = ("exact_prefix5", "exact_prefix4", "subsequence", "fuzzy")
#: Seconds of a sentence that isn't found, seconds a word, least share of equal letters, starts tried, words that end a sentence, words gone back.
GUESS, GUESS_PER_WORD, LEAST_RATIO, REACH, TAIL, BACK = 3.0, 0.15, 0.7, 100, 3, 5
#: What words are made of; words read at a time.
LETTERS, BLOCK = r"\p{L}\p{M}\p{N}_", 64
#: Chapters that a task aligns side by side.
BESIDE = 512


def bare(text: str) -> list[str]:
    return re.sub(r"[^\w\s]", "", text.lower()).split()


def bare_words(words: list[str]) -> list[str]:
    """Each word without what bare() leaves out."""
    lines = re.sub(r"[^\w\s]", "", "\n".join(words).lower()).split("\n")
    return ["".join(x.split()) for x in (lines if len(lines) == len(words) else map(" ".join, map(bare, words)))]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spread(rows: DataFrame, chapter: str | Column) -> DataFrame:
    """Rows by chapter, for small tables with much work: a fixed number of partitions, which adaptive execution doesn't merge."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), chapter)


def plain(word: Column) -> Column:
    """A word in lower case without anything but letters, marks, digits and underscores; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(word, F.lit(""))), f"[^{LETTERS}]", "")


def plain_words(text: Column) -> Column:
    """The plain words of a text, no empty ones."""
    return F.filter(F.transform(tokens(F.coalesce(text, F.lit(""))), plain), lambda w: w != "")


def placed(sentences: DataFrame, texts: DataFrame, prefix: int = 5, norm: Callable[[Column], Column] = normalise, chapter: str = "chapter_id") -> DataFrame:
    """chapter, index, first and last: the places (from 1) of each sentence's first and last character in its chapter's norm(text); null if not found.

    texts: chapter and text, a row each; chapters without one find nothing. A sentence stands where norm() of it does, within words as
    well, else where its first words do, from the cursor on; then it ends with its last TAIL words behind those, else it is as long as it
    is by itself. The cursor then moves behind it. Empty sentences are nowhere."""
    w = F.col("_w")
    tail = F.slice(w, F.greatest(F.size(w) - TAIL + 1, F.lit(1)), F.lit(TAIL))
    said = sentences.select(chapter, "index", norm(F.coalesce("text", F.lit(""))).alias("_whole"))
    said = said.withColumn("_w", F.regexp_extract_all("_whole", F.lit(f"[{LETTERS}]+"), F.lit(0)))
    said = said.select(chapter, F.struct("index", F.col("_whole").alias("whole"), F.array_join(F.slice(w, 1, prefix), " ").alias("begin"), F.array_join(tail, " ").alias("tail")).alias("_s"))
    rows = _spread(said, chapter).groupBy(chapter).agg(F.array_sort(F.collect_list("_s")).alias("_said"))
    rows = rows.join(texts.select(chapter, norm(F.coalesce("text", F.lit(""))).alias("_text")), chapter, "left").withColumn("_text", F.coalesce("_text", F.lit("")))
    text, one = F.col("_text"), "struct<index: int, first: int, last: int>"

    def seek(part, at):
        return F.when(part != "", F.call_function("locate", part, text, at)).otherwise(0)

    def span(r, first, last):
        return F.struct(r["index"].cast("int").alias("index"), first.alias("first"), last.alias("last")).cast(one)

    def by_first_words(r, hit):
        behind = hit + F.length(r["begin"])
        last = _let(seek(r["tail"], behind), lambda t: F.when(t > 0, t + F.length(r["tail"]) - 1).otherwise(F.least(F.length(text), hit + F.length(r["whole"]) - 1)))
        return F.when(hit > 0, span(r, hit, last)).otherwise(span(r, F.lit(None), F.lit(None)))

    def step(acc, r):
        exact = lambda hit: F.when(hit > 0, span(r, hit, hit + F.length(r["whole"]) - 1)).otherwise(_let(seek(r["begin"], acc["at"]), lambda h: by_first_words(r, h)))
        return _let(_let(seek(r["whole"], acc["at"]), exact), lambda x: _moved(acc, x, F.coalesce(x["last"] + 1, acc["at"])))

    return rows.select(chapter, F.inline(F.aggregate("_said", _start(), step, lambda acc: acc["out"])))


_STATE = "struct<at: int, out: array<struct<index: int, first: int, last: int>>>"


def _start() -> Column:
    return F.struct(F.lit(1).alias("at"), F.array().alias("out")).cast(_STATE)


def _moved(acc: Column, found: Column, at: Column) -> Column:
    return F.struct(at.alias("at"), F.concat(acc["out"], F.array(found)).alias("out")).cast(_STATE)


def in_order(sentences: DataFrame, words: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """chapter, index, first and last: which of the chapter's words (from 1, by pos) match a sentence's in order; null if none does.

    Words match that are equal or one the other's beginning; a match of one or two words that breaks off begins anew. A sentence is
    sought from BACK words before the end of the last one that was matched to its end. Words are read in blocks, so that what follows
    the last match costs a step a block."""
    said = sentences.select(chapter, F.struct("index", plain_words(F.col("text")).alias("w")).alias("_s"))
    heard = words.groupBy(chapter).agg(F.array_sort(F.collect_list(F.struct("pos", plain(F.col("word")).alias("word")))).alias("_heard"))
    rows = _spread(said, chapter).groupBy(chapter).agg(F.array_sort(F.collect_list("_s")).alias("_said")).join(heard, chapter, "left")
    rows = rows.withColumn("_words", F.coalesce(F.transform("_heard", lambda x: x["word"]), F.array().cast("array<string>"))).drop("_heard")
    n, kind = F.size("_words"), "struct<i: int, first: int, last: int>"

    def matched(w, m, j):
        word, wanted = F.get("_words", j - 1), F.get(w, m["i"])
        same = (word != "") & (F.startswith(word, wanted) | F.startswith(wanted, word))
        onward = F.struct((m["i"] + 1).alias("i"), F.coalesce(m["first"], j).alias("first"), j.alias("last")).cast(kind)
        anew = F.struct(F.lit(0).alias("i"), F.lit(None).alias("first"), F.lit(None).alias("last")).cast(kind)
        return F.when(m["i"] >= F.size(w), m).when(same, onward).when(m["i"].between(1, 2), anew).otherwise(m)

    def block(w, m, b):
        return F.when(m["i"] >= F.size(w), m).otherwise(F.aggregate(F.sequence(b, F.least(b + BLOCK - 1, n)), m, lambda a, j: matched(w, a, j)))

    def step(acc, r):
        low, none = F.greatest(acc["at"] - BACK, F.lit(1)), F.struct(F.lit(0).alias("i"), F.lit(None).alias("first"), F.lit(None).alias("last")).cast(kind)
        blocks = F.when(low <= n, F.sequence(low, n, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        over = F.aggregate(blocks, none, lambda m, b: block(r["w"], m, b))
        found = lambda m: F.struct(r["index"].cast("int").alias("index"), m["first"].alias("first"), F.when(m["first"].isNotNull(), m["last"]).alias("last"))
        return _let(over, lambda m: _moved(acc, found(m), F.when((m["i"] == F.size(r["w"])) & (m["i"] > 0), m["last"] + 1).otherwise(acc["at"])))

    return rows.select(chapter, F.inline(F.aggregate("_said", _start(), step, lambda acc: acc["out"])))


def likely(text: str, words: list[str], starts: int, sizes: range) -> list[tuple[float, int, int]]:
    """Windows (first word, words) by what their share of equal letters can be at most, over LEAST_RATIO; the best first."""
    first = range(min(starts, len(words) - sizes[0] + 1))
    return windows.likely([windows.Ask(text, windows.Heard(words), first, sizes, LEAST_RATIO)])[0] if first else []


def _spans(sentences: list[str], words: list[str]) -> Generator:
    """by_ratio's list for a chapter, as a generator that asks for likely windows."""
    heard, at, out = windows.Heard(words), 0, []
    for s in sentences:
        w, best, found = bare(s), LEAST_RATIO, None
        text, sizes = " ".join(w), range(max(1, len(w) - 2), len(w) + 5)
        starts = range(at, min(at + REACH + 2 * len(w), len(words) - sizes[0] + 1)) if w else range(0)
        if w and len(text) < windows.JUNK and at + len(w) <= len(words) and heard.window(at, len(w)) == text:
            best, found = 1.0, (at, len(w))
        letters = windows.places_of(text) if 2 * len(text) >= windows.JUNK else None
        # most stand at the cursor, and their ratio leaves little else to look at
        for part in (starts[:1], starts[1:]):
            for bound, i, n in (yield windows.Ask(text, heard, part, sizes, best)) if part and best < 1.0 else ():
                if bound < best:
                    break
                r = windows.ratio(text, heard.window(i, n), best, letters)  # the order counts
                if r > best or found and r == best and (i, n) < found:
                    best, found = r, (i, n)
        if found:
            found = (found[0], sum(found) - 1)
            at = found[1] + 1
        out.append(found)
    return out


def side_by_side(chapters: Iterable[tuple]) -> Iterator[tuple]:
    """Keys with by_ratio's lists, from keys with sentences and words. Chapters wait until most of those that run ask for texts as long as theirs."""
    chapters, waiting, asking, running = iter(chapters), {}, [], 0
    while True:
        for key, spans, answer in asking:
            try:
                ask = spans.send(answer)
                waiting.setdefault(ask.limbs(), []).append((key, spans, ask))
            except StopIteration as end:
                running -= 1
                yield key, end.value
        asking = [(key, _spans(*chapter), None) for key, *chapter in islice(chapters, BESIDE - running)]
        running += len(asking)
        if not asking:
            if not waiting:
                return
            chosen = waiting.pop(max(waiting, key=lambda limbs: len(waiting[limbs])))
            asking = [(key, spans, answer) for (key, spans, _), answer in zip(chosen, windows.likely([ask for *_, ask in chosen]))]


def by_ratio(sentences: list[str], words: list[str]) -> Iterator[tuple[int, int] | None]:
    """The window with the greatest share of equal letters, if over LEAST_RATIO; the earliest and shortest of equals."""
    for _, found in side_by_side([(None, sentences, words)]):
        yield from found


def imputed(found: DataFrame, strategy: str, chapter: str = "chapter_id") -> DataFrame:
    """Intervals of all sentences from those of the found ones (chapter, index, start, end, words; start is null where a sentence wasn't found).

    What is not found hangs on the last one found and on those in between alone. So each found sentence and those after it up to the
    next are folded by themselves; "subsequence" needs the number of sentences before as well, the mean being the last end over it."""
    kept, so_far = F.col("_run") > 0, Window.partitionBy(chapter).orderBy("index")
    rows = found.withColumn("_run", F.count("start").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows if strategy == "fuzzy" else rows.filter(kept)
    rows = rows.withColumn("_n", F.row_number().over(so_far) - 1)
    each = F.struct("index", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "words", "_n")
    runs = rows.groupBy(chapter, "_run").agg(F.array_sort(F.collect_list(each)).alias("_rows"))
    kind = "array<struct<index: int, start: double, end: double, estimated: boolean>>"

    def step(acc, r):
        last = F.element_at(acc, -1)["end"]
        length = F.lit(GUESS) if strategy.startswith("exact") else last / r["_n"] if strategy == "subsequence" else F.greatest(F.lit(1.0), GUESS_PER_WORD * r["words"])
        there, first = r["start"].isNotNull(), F.size(acc) == 1
        start = F.when(there, rounded(r["start"])).when(first, 0.0).otherwise(last)
        end = F.when(there, rounded(r["end"])).when(first, 1.0).otherwise(rounded(last + length))
        return F.concat(acc, F.array(F.struct(r["index"].cast("int").alias("index"), start.alias("start"), end.alias("end"), (~there).alias("estimated"))).cast(kind))

    # element_at of an empty array is an error, so the fold begins with a row that is dropped
    seed = F.array(F.struct(F.lit(-1).alias("index"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.lit(True).alias("estimated"))).cast(kind)
    folded = F.aggregate("_rows", seed, lambda acc, r: step(acc, r))
    return runs.select(chapter, F.inline(F.slice(folded, 2, F.size("_rows"))))


def words_of_characters(characters: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """Words with times from timed characters (chapter, pos, character, start, end).

    Characters keep their own times, so white space that a normalised text would lose shifts nothing."""
    blank = F.col("character").rlike(r"^\s*$")
    number = F.count_if(blank).over(Window.partitionBy(chapter).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    letters = characters.withColumn("pos_", number).filter(~blank)
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "character"))), lambda x: x["character"]), "")
    return letters.groupBy(chapter, F.col("pos_").alias("pos")).agg(spelled.alias("word"), F.min("start").alias("start"), F.max("end").alias("end"))


def _timed(spans: DataFrame, heard: DataFrame, chapter: str, text: Column | None = None) -> DataFrame:
    """chapter, index, start and end from spans of heard words, or of the characters of a text of these."""

    def number(c):
        before = F.substring(text, F.lit(1), F.col(c) - 1)
        return F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))

    first, last = (F.col(c) - 1 if text is None else number(c) for c in ("first", "last"))
    return spans.join(heard, chapter, "left").select(chapter, "index", F.get("_heard", first)["start"].alias("start"), F.get("_heard", last)["end"].alias("end"), F.lit(0).alias("words"))


def _fuzzy(sentences: DataFrame, words: DataFrame, chapter: str) -> DataFrame:
    """What _timed() gives for by_ratio's spans. A null chapter is one like others."""
    said = F.struct(F.col("index").cast("int").alias("index"), F.coalesce("text", F.lit("")).alias("text"))
    heard = F.struct("pos", F.coalesce("word", F.lit("")).alias("word"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    rows = sentences.groupBy(chapter).agg(F.array_sort(F.collect_list(said)).alias("_said"))
    rows = rows.unionByName(words.groupBy(chapter).agg(F.array_sort(F.collect_list(heard)).alias("_heard")), allowMissingColumns=True)
    rows = rows.groupBy(chapter).agg(F.first("_said", True).alias("_said"), F.first("_heard", True).alias("_heard")).filter("_said IS NOT NULL")

    def chapters(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                said, heard = batch.column(1)[k].values, batch.column(2)[k].values
                texts, plain = said.field("text").to_pylist(), [] if heard is None else bare_words(heard.field("word").to_pylist())
                yield (batch.column(0)[k], said, heard), texts, plain

    def run(batches):
        parts, columns = [], [chapter, "index", "start", "end", "words"]
        for (key, said, heard), found in side_by_side(chapters(batches)):
            starts, ends = ([], []) if heard is None else (heard.field("start").to_pylist(), heard.field("end").to_pylist())
            times = [pa.array([x and side[x[k]] for x in found], pa.float64(), from_pandas=True) for k, side in enumerate((starts, ends))]
            count = pa.array([len(bare(t)) for t in said.field("text").to_pylist()], pa.int32())
            parts.append(pa.RecordBatch.from_arrays([pa.repeat(key, len(said)), said.field("index"), *times, count], columns))
            if len(parts) == BESIDE:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                parts = []
        if parts:
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    # by a hash, as rows that lie by chapter already would stay in the few partitions that adaptive execution merged them into
    return _spread(rows, F.xxhash64(chapter)).mapInArrow(run, f"{chapter} {dict(sentences.dtypes)[chapter]}, index int, start double, end double, words int")


def aligned(sentences: DataFrame, words: DataFrame, strategy: str = "fuzzy", chapter: str = "chapter_id") -> DataFrame:
    if strategy == "fuzzy":
        return imputed(_fuzzy(sentences, words, chapter), strategy, chapter)
    words = words.withColumn("word", plain(F.col("word"))).filter("word <> ''")
    heard = words.groupBy(chapter).agg(F.array_sort(F.collect_list(F.struct("pos", "word", "start", "end"))).alias("_heard"))
    if strategy == "subsequence":
        return imputed(_timed(in_order(sentences, words, chapter), heard, chapter), strategy, chapter)
    text = F.array_join(F.transform("_heard", lambda x: x["word"]), " ")
    spans = placed(sentences, heard.select(chapter, text.alias("text")), int(strategy[-1]), lambda t: F.array_join(plain_words(t), " "), chapter)
    return imputed(_timed(spans, heard, chapter, text), strategy, chapter)


def match_report(intervals: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """Matched and all sentences of each chapter, and the mean length: last end over their number."""
    return intervals.groupBy(chapter).agg(F.count_if(~F.col("estimated")).alias("matched"), F.count("*").alias("total"), (F.max_by("end", "index") / F.count("*")).alias("mean_seconds"))

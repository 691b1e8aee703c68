"""Toxic passages by maximum-scoring segment search over token log-odds.

Tokens (words, and prefixes of longer words as a back-off for inflections) get log-odds between toxic and other
documents under an informative Dirichlet prior; those that are significantly toxic score their log-odds, every other
token a small negative drift. A linear-time scan (Ruzzo and Tompa) finds every maximal scoring segment; a segment of
score S in n tokens has the expected number K * n * exp(-lambda * S) by extreme-value theory, and is significant below
MAX_E. lambda and K are those under which the best segments of the training rows that aren't toxic are likeliest. A
logistic curve, fitted to the training rows, turns a document's best and summed evidence into a probability.

Labels are learned from at most MAX_LABELLED rows, in the order of a hash of their ids. Defined cases: null and
empty texts have no passages and get the probability of no evidence; rows with a null label or id teach nothing;
of several labels of one id the greatest counts; without labels every score is 0; an empty table gives an empty
result; other columns of the input are ignored."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table

#: Labelled rows learned from, fewest toxic documents with a feature, least z of a toxic feature, prior's share of all counts.
MAX_LABELLED, MIN_TOXIC, MIN_Z, PRIOR = 60_000, 3, 3.0, 0.05
#: Lengths of the prefixes that back off, score of other tokens, most expected chance segments of a significant one.
PREFIXES, DRIFT, MAX_E = (6, 5, 4), -0.25, 0.05
#: Distinct words whose scores a task remembers.
MEMO = 300_000

_TOKEN = re.compile(r"\w+")


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, text and label of at most limit labelled rows; the label side is bounded, so it is broadcast."""
    known = labels.filter(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def features(words) -> set[str]:
    """The distinct words of a text and, marked with a star, prefixes of longer ones."""
    words = set(words)
    return words | {f"{w[:n]}*" for n in PREFIXES for w in words if len(w) > n}


def feature_counts(batches):
    """Documents with each feature, toxic and not, and the number of both kinds of documents under the empty feature."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush():
        both = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"feature": pa.array(both, pa.string()), "toxic": pa.array([seen[1][x] for x in both], pa.int64()), "other": pa.array([seen[0][x] for x in both], pa.int64())})
        for c in seen.values():
            c.clear()

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            c = seen[int(label > 0)]
            c.update(features(_TOKEN.findall((text.as_py() or "").lower())))
            c[""] += 1
            if len(c) > MEMO:
                yield from flush()
    yield from flush()


def learned(train: DataFrame) -> dict[str, float]:
    """The significantly toxic features of the bounded training rows with their log-odds."""
    counts = train.select("text", "label").mapInArrow(feature_counts, "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = counts.filter(f"toxic >= {MIN_TOXIC} or feature = ''").cache()
    docs = counts.filter("feature = ''").collect()
    if not docs or not docs[0].toxic or not docs[0].other:
        counts.unpersist()
        return {}
    n1, n0 = float(docs[0].toxic), float(docs[0].other)
    prior = PRIOR * (n1 + n0)
    a = F.col("toxic") + F.col("other")
    a = F.lit(prior) * a / (n1 + n0)
    odds = F.log((F.col("toxic") + a) / (n1 + 2 * prior - F.col("toxic") - a)) - F.log((F.col("other") + a) / (n0 + 2 * prior - F.col("other") - a))
    z = odds / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("other") + a))
    best = counts.filter("feature <> ''").select("feature", odds.alias("odds"), z.alias("z")).filter(F.col("z") >= MIN_Z).collect()
    counts.unpersist()
    return {r.feature: r.odds for r in best}


def extreme_values(n: np.ndarray, best: np.ndarray, least: float) -> tuple[float, float]:
    """lambda and K under which the best scores of texts of n tokens are likeliest: P(best < x) = exp(-K n exp(-lambda x)).

    Texts without a segment have a best score below least, that of any positive token. For each lambda the likeliest K
    has a closed form; lambda is found by golden-section search. Without segments, one above the least score is as
    rare as one in all tokens."""
    some, n = best > 0, np.maximum(n, 1).astype(float)
    x = np.where(some, best, least)
    if not some.any():
        return 1.0, math.exp(least) / (1 + n.sum())

    def fit(rate: float) -> tuple[float, float]:
        k = some.sum() / (n * np.exp(-rate * (x - least))).sum()
        return some.sum() * (math.log(k * rate) + rate * least) - rate * x[some].sum(), k * math.exp(rate * least)

    low, high, golden = 1e-2, 5.0, (math.sqrt(5) - 1) / 2
    while high - low > 1e-4:
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (a, high) if fit(a)[0] < fit(b)[0] else (low, b)
    return low, fit(low)[1]


class Memo(dict):
    """Scores of words: its own weight, else that of its longest known prefix, else the drift."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > MEMO:
            self.clear()
        known = (f"{word[:n]}*" for n in PREFIXES if len(word) > n)
        self[word] = score = self.weights.get(word) or next((self.weights[p] for p in known if p in self.weights), DRIFT)
        return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time: only positive scores take a step."""
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # start, end, total before, total after, next lower one on the left
    for i in places.tolist():
        now = [i, i + 1, total[i], total[i + 1]]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= now[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= now[3]:
                stack.append([*now, j])
                break
            now = [stack[j][0], now[1], stack[j][2], now[3]]
            del stack[j:]
    return [(a, b, float(r - l)) for a, b, l, r, _ in stack]


def best_segment(text: str, memo: Memo) -> tuple[int, float]:
    """Number of tokens, and the score of the best segment."""
    words = _TOKEN.findall(text.lower())
    return len(words), max((s for _, _, s in segments(np.fromiter(map(memo.__getitem__, words), float, len(words)))), default=0.0)


def passages(text: str, memo: Memo, rate: float, k: float) -> tuple[int, list[tuple[int, int, float, float]]]:
    """Number of tokens, and the significant segments: first token, token after the last, score, expected number."""
    words = _TOKEN.findall(text.lower())
    scores = np.fromiter(map(memo.__getitem__, words), float, len(words))
    found = ((a, b, s, k * len(words) * math.exp(-rate * s)) for a, b, s in segments(scores))
    return len(words), [x for x in found if x[3] < MAX_E]


def evidence(found: list) -> tuple[float, float]:
    """Evidence of the best segment and of all, in nats beyond chance, on a log scale."""
    extra = [-math.log(max(x[3], 1e-300)) for x in found]
    return (math.log1p(max(extra)), math.log1p(sum(extra))) if extra else (0.0, 0.0)


def measured(weights: dict[str, float]):
    """label, number of tokens and best score of each text."""

    def measure(batches):
        memo = Memo(weights)
        for batch in batches:
            rows = [best_segment(t.as_py() or "", memo) for t in batch.column("text")]
            n, best = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "_n": pa.array(n, pa.int64()), "_best": pa.array(best, pa.float64())})

    return measure


def scanned(weights: dict[str, float], rate: float, k: float, curve: list[float] | None = None):
    def scan(batches):
        memo = Memo(weights)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                _, found = passages(text.as_py() or "", memo, rate, k)
                rows.append((*evidence(found), [dict(zip(("start", "end", "score", "expected"), f)) for f in found]))
            best, total, found = zip(*rows) if rows else ((), (), ())
            if curve is None:
                yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "_best": pa.array(best, pa.float64()), "_total": pa.array(total, pa.float64())})
                continue
            score = [1 / (1 + math.exp(-(curve[0] + curve[1] * b + curve[2] * t))) for b, t in zip(best, total)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score, pa.float64()), "passages": pa.array(found, kind)})

    return scan


def fitted(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression with a slight ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
    return w.tolist()


def toxic_passages(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, score and passages (token spans) of every text; train: text and label."""
    weights = learned(train)
    train = train.select("text", "label")
    met = train.filter("label <= 0").mapInArrow(measured(weights), "label int, _n long, _best double").toArrow()
    rate, k = extreme_values(met["_n"].to_numpy(), met["_best"].to_numpy(), min(weights.values(), default=1.0))
    sample = train.mapInArrow(scanned(weights, rate, k), "label int, _best double, _total double").toArrow()
    y = (pc.fill_null(sample["label"], 0).to_numpy() > 0).astype(float)
    curve = fitted(np.column_stack([sample["_best"].to_numpy(), sample["_total"].to_numpy()]), y) if 0 < y.sum() < len(y) else [-30.0, 0.0, 0.0]
    return docs.select("doc_id", "text").mapInArrow(scanned(weights, rate, k, curve), f"doc_id {dict(docs.dtypes)['doc_id']}, score double, passages array<struct<start: long, end: long, score: double, expected: double>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = labelled(docs, table(spark, sf_dir, "labels").filter(remainder("doc_id", 3) != 1), "toxic", MAX_LABELLED)
    found = toxic_passages(docs, train)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))

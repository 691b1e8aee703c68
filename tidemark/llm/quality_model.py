"""Quality classifier: supervised subword embeddings.

Each word, each character n-gram of it and each pair of neighbouring words hashes to one of BUCKETS learned vectors; a
document is the mean of its vectors, and a softmax over two classes follows. Numpy stochastic gradient descent learns
both. The softmax is linear in the mean, so a vector's part in the score is one number; scoring sums those numbers,
once for each distinct word of a chunk of texts.

Labels are learned from at most MAX_LABELLED rows, in the order of a hash of their ids, and no more of these than have
MAX_PAIRS distinct features in all. Defined cases: null and empty texts have the mean of no vectors and score by the
bias alone; rows with a null label or id teach nothing; of several labels of one id the greatest counts; without labels
every score is 0.5; an empty table gives an empty result; other columns of the input are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _BYTE, chunks, gathered, mix, packed, powers, remainder, sums, table, word_codes, written
from .toxicity import labelled

#: Labelled rows learned from, and their features with shares (12 bytes each) that go to the driver, at most.
MAX_LABELLED, MAX_PAIRS = 4000, 1 << 24
#: Hashed vectors, their length, lengths of character n-grams.
BUCKETS, DIM, GRAMS = 1 << 16, 16, (3, 4)
EPOCHS, BATCH, RATE, SEED = 6, 32, 8.0, 17
#: Bytes of text that are worked on at once.
CHUNK = 1 << 22
_MASK = np.uint64(BUCKETS - 1)


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each distinct word; the buckets of each word and its character n-grams end to end, and their n + 1 offsets."""
    data, offsets = packed(words)
    n, size = len(offsets) - 1, np.diff(offsets) + 2
    begin = offsets[:-1] + 2 * np.arange(n)
    text = np.full(len(data) + 2 * n, ord(">"), np.uint8)
    text[begin] = ord("<")
    text[np.arange(len(data)) + 2 * np.repeat(np.arange(n), size - 2) + 1] = data
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * powers(len(text)), out=total[1:])
    whole = mix((total[begin + size] - total[begin]) * powers(len(text), True)[begin] + size.astype(np.uint64))
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(1 + sum(np.maximum(0, size - g + 1) for g in GRAMS), out=ends[1:])
    out = np.zeros(ends[-1], np.int64)
    out[ends[:-1]] = (whole & _MASK).astype(np.int64)
    slot, left = ends[:-1] + 1, np.repeat(size, size) - (np.arange(len(text)) - np.repeat(begin, size))
    for g in GRAMS:
        at = np.flatnonzero(left >= g)
        key = np.full(len(at), g, np.uint64)
        for j in range(g):
            key = (key << np.uint64(8)) | text[at + j]
        of = np.repeat(np.arange(n), np.maximum(0, size - g + 1))
        out[slot[of] + at - begin[of]] = (mix(key) & _MASK).astype(np.int64)
        slot = slot + np.maximum(0, size - g + 1)
    return whole, out, ends


def pairs(whole: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each two neighbouring words of a text, and the n + 1 offsets of the texts' pairs.

    A pair goes by the difference of its words' hashes, so all pairs of a word with itself share a vector."""
    h = whole[codes]
    inside = np.ones(max(0, len(codes) - 1), bool)
    cuts = counts[1:-1]
    inside[cuts[(cuts > 0) & (cuts < len(codes))] - 1] = False
    number = np.concatenate([[0], np.cumsum(inside)])
    found = (mix(h[1:] - h[:-1]) & _MASK).astype(np.int64)[inside]
    return found, number[np.maximum(0, np.minimum(counts, len(number) - 1))]


def hashed(batches):
    """label, and the distinct buckets of each text with their shares."""
    for batch, data, offsets in chunks(batches, limit=CHUNK):
        codes, words, counts = word_codes(data, offsets)
        whole, buckets, ends = subwords(words)
        two, two_ends = pairs(whole, codes, counts)
        ids, shares = [], []
        for i in range(batch.num_rows):
            own, _ = gathered(buckets, ends, codes[counts[i] : counts[i + 1]])
            found, times = np.unique(np.concatenate([own, two[two_ends[i] : two_ends[i + 1]]]), return_counts=True)
            ids.append(found)
            shares.append(times / max(1, times.sum()))
        bounds = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
        flat = [pa.array(np.concatenate(x) if x else [], k) for x, k in ((ids, pa.int32()), (shares, pa.float32()))]
        label = pa.array([int(x > 0) for x in batch.column("label").to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([label, *(pa.ListArray.from_arrays(bounds, f) for f in flat), batch.column("_order")], names=["label", "ids", "shares", "_order"])


def step(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray, ids: np.ndarray, shares: np.ndarray, sizes: np.ndarray, y: np.ndarray, rate: float) -> None:
    """One step of gradient descent on a batch of documents with sizes[i] features each.

    Logits are sums of the vectors' own products with out. With two classes, what goes back to a document's mean is its
    error times one vector, so the gradient of a bucket's vector is that vector times one number, and the gradient of out
    is the sum of the vectors by those numbers."""
    of = np.repeat(np.arange(len(y)), sizes)
    p = np.stack([np.bincount(of, column[ids] * shares, len(y)) for column in (vectors @ out).T], 1) + bias
    p = np.exp(p - p.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    error, back = p[:, 1], out[:, 1] - out[:, 0]
    part = np.bincount(ids, shares * error[of], len(vectors)).astype(vectors.dtype)
    along = rate / len(y) * (vectors.T @ part)
    bias -= 0.1 * rate / len(y) * p.sum(0)
    vectors -= np.outer(part, rate * back)
    out[:, 0] += along
    out[:, 1] -= along


def trained(sample: pa.Table) -> tuple[np.ndarray, float]:
    """Each vector's part in the log-odds of quality, and the bias."""
    sample = sample.combine_chunks()
    if not sample.num_rows:
        return np.zeros(BUCKETS), 0.0
    column = lambda c: sample[c].combine_chunks()
    ids, shares, ends, y = column("ids").flatten().to_numpy(), column("shares").flatten().to_numpy(), column("ids").offsets.to_numpy().astype(np.int64), column("label").to_numpy()
    draw = np.random.default_rng(SEED)
    vectors, out, bias = draw.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2)
    steps, done = EPOCHS * -(-len(y) // BATCH), 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            f, bounds = gathered(ids, ends, rows)
            step(vectors, out, bias, f, gathered(shares, ends, rows)[0], np.diff(bounds), y[rows], RATE * (1 - done / steps))
            done += 1
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def scored(parts: np.ndarray, bias: float):
    def score(batches):
        for batch, data, offsets in chunks(batches, limit=CHUNK):
            codes, words, counts = word_codes(data, offsets)
            whole, buckets, ends = subwords(words)
            two, two_ends = pairs(whole, codes, counts)
            of_word, number = sums(parts[buckets], ends), np.diff(ends)
            total = sums(of_word[codes], counts) + sums(parts[two], two_ends)
            features = sums(number[codes].astype(float), counts) + np.diff(two_ends)
            x = np.clip(total / np.maximum(features, 1) + bias, -30, 30)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(1 / (1 + np.exp(-x)), pa.float64())})

    return score


def quality(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id and score of every text; train: text and label, few enough rows for one machine."""
    rows = train.select("text", "label", F.xxhash64("text", "label").alias("_order"))
    sample = written(rows.mapInArrow(hashed, "label int, ids array<int>, shares array<float>, _order long"))
    so_far = F.sum(F.size("ids")).over(Window.orderBy("_order").rowsBetween(Window.unboundedPreceding, 0))  # over the sample alone
    taken = sample.withColumn("_sum", so_far).filter(F.col("_sum") <= MAX_PAIRS).select("label", "ids", "shares")
    parts, bias = trained(taken.toArrow())
    return docs.select("doc_id", "text").mapInArrow(scored(parts, bias), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = labelled(docs, table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0), "quality", MAX_LABELLED)
    return quality(docs, train).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

"""What the operators share: tables, written intermediate results, and words of texts in numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_folder

#: What separates words, in a regular expression of Java, Python or RE2.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that numpy works on at once; a longer text is worked on alone.
CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written once as Parquet into the shared checkpoint folder and read back.

    Lost executors then cost no recomputation. The folder is spark.checkpoint.dir; only on a local master where that is
    unset (tests, local runs) a temporary folder is set for the session."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(docs: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """docs with every column but own under a name that clashes with nothing, and the columns that bring docs back."""
    names = {c: c if c in own else f"_own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


#: A key is heavy from this share of the rows that are joined; so there are few of them, and they are broadcast.
MAX_HEAVY, MIN_HEAVY = 1000, 64
#: Most rows of ids, tiles or keys that are broadcast after they were counted.
MAX_BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, n: int) -> DataFrame:
    """df, to be broadcast if its n rows are few enough."""
    return F.broadcast(df) if n <= MAX_BROADCAST_ROWS else df


def spread_join(rows: DataFrame, keys: DataFrame, on: str | list[str], count: str, total: int) -> DataFrame:
    """rows joined with keys, one row per key (of one column or several); count is the number of rows with that key, total that of all rows.

    At most MAX_HEAVY keys can hold 1 / MAX_HEAVY of the rows each. Those are broadcast, so no task gets all rows of
    one; the rows of all other keys shuffle."""
    limit = max(MIN_HEAVY, total // MAX_HEAVY)
    heavy = F.broadcast(keys.filter(F.col(count) > limit).withColumn("_heavy", F.lit(True)))
    marked = rows.join(heavy, on, "left")
    names = [*rows.columns, *[c for c in keys.columns if c not in ([on] if isinstance(on, str) else on)]]
    light = marked.filter("_heavy is null").select(*rows.columns).join(keys.filter(F.col(count) <= limit), on)
    return marked.filter("_heavy").select(*names).unionByName(light.select(*names))


def texts(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and the n + 1 offsets of its texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string() if not pa.types.is_binary(column.type) else pa.large_binary()), b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches cut to at most limit bytes of text each (one row at least), with the bytes and offsets of the texts."""
    for batch in batches:
        data, offsets = packed(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """64 bits well mixed (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_R = np.uint64(0x5851F42D4C957F2D)
_R_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inverse" if inverse else "forward"
    if len(_powers.get(key, ())) < n:
        x = np.full(max(n, CHUNK + 1), _R_INVERSE if inverse else _R, np.uint64)
        x[0] = 1
        _powers[key] = np.cumprod(x)
    return _powers[key][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of the texts, and the n + 1 offsets of the texts' words; between: flags of the bytes that separate words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = between[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z as a-z), and the n + 1 offsets of the texts' words."""
    starts, ends, counts = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * powers(len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(len(data), True)[starts] + (ends - starts).astype(np.uint64)), counts


def word_codes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The texts' words as places in an array of distinct words, that array, and the n + 1 offsets of the texts' words."""
    starts, ends, counts = word_spans(data, offsets)
    bytes_ = (_LOWER[data] if lower else data)[~_SPACE[data]]
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(bytes_)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, counts


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of values between each two of the ends."""
    return np.bincount(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), values, minlength=len(ends) - 1)


def gathered(parts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen stretches of parts (from ends[i] to ends[i + 1]) end to end, and the n + 1 offsets of these."""
    sizes = np.diff(ends)[which]
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    at = np.repeat(ends[:-1][which] - out[:-1], sizes)
    at += np.arange(out[-1])
    return parts[at], out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, and the n + 1 offsets of the texts' sets.

    A text of fewer words has its whole sequence as one shingle; one without words has none."""
    words, counts = word_hashes(data, offsets)
    sizes, out = np.diff(counts), []
    roll = np.zeros(len(words), np.uint64)
    for j in range(k):
        part = mix(words + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        m = max(0, len(words) - j)
        roll[:m] += part[j : j + m]
    for i, n in enumerate(sizes):
        at = counts[i]
        if n >= k:
            out.append(np.unique(roll[at : at + n - k + 1]))
        elif n:
            seed = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out.append(mix(mix(words[at : at + n] + seed).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    ends = np.zeros(len(offsets), np.int64)
    np.cumsum([len(x) for x in out], out=ends[1:])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), ends

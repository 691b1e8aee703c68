"""Suffix-array dedup: removes every byte that a string of LENGTH bytes covers which starts anywhere else, too.

Strings go where their equals are: each string's anchor is its rightmost gram of GRAM bytes with the least hash, and
neighbouring strings with one anchor form a run. Runs whose anchor occurs once hold nothing repeated and go no further.
The distinct runs of the other anchors, with the number of their occurrences, are dealt out by anchor; each task
builds suffix arrays over them in blocks by two-stage sorting: only suffixes smaller than their successors are
sorted directly, the rest is induced by scanning the buckets in order; then adjacent common prefixes are computed.
A string is repeated if its run occurs twice or its suffix shares LENGTH bytes with a neighbour. An anchor of over HOT
distinct runs, as a header has that goes on differently in each text, fits no suffix array of bounded size; its strings
are counted by two 64-bit hashes of all their bytes instead, which are added up before they shuffle.

Defined cases: a null text is empty; texts shorter than LENGTH keep all bytes; repeated rows repeat each other; rows
that share a doc_id are told apart by their texts; a null doc_id is a row like others; an empty table gives an empty
result; other columns of the input are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, bounded, chunks, mix, powers, spread_join, table, texts, written

LENGTH, GRAM = 200, 48
#: Bytes of runs in one suffix array, distinct runs of an anchor beyond which its strings are counted by their hashes.
BLOCK, HOT = 1 << 22, 8_000
#: Bytes of one long text that anchors are searched in at once.
WINDOW = 1 << 20
_C = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM = 32 + 16 bytes from each position on."""
    h, half, width = _BYTE[data], None, 1
    for c in _C[:5]:
        if width == 16:
            half = h
        h = h[:-width] * c + h[width:]
        width *= 2
    n = len(data) - GRAM + 1
    return mix(h[:n] * _C[5] + half[32 : 32 + n])


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First string and number of strings of each run in one text, and the hash of its anchor."""
    n = len(data) - LENGTH + 1
    grams = gram_hashes(data)
    place = np.arange(len(grams), dtype=np.uint64)
    low = (grams & ~np.uint64((1 << 24) - 1)) | (np.uint64((1 << 24) - 1) - place)  # the later of equals is less
    width, span = 1, LENGTH - GRAM + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    at = ((1 << 24) - 1 - (low & np.uint64((1 << 24) - 1)).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.diff(np.append(first, n)), grams[at[first]]


def text_runs(data: np.ndarray):
    """runs() of a text of any length, in windows that overlap; with the hash of each run's bytes."""
    for begin in range(0, max(1, len(data) - LENGTH + 1), WINDOW):
        part = data[begin : begin + WINDOW + LENGTH - 1]
        if len(part) < LENGTH:
            return
        first, number, anchor = runs(part)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * powers(len(part)), out=total[1:])
        ends = first + number + LENGTH - 1
        yield begin + first, number, anchor, mix((total[ends] - total[first]) * powers(len(part), True)[first] + ends.astype(np.uint64) - first.astype(np.uint64))


def anchored(batches):
    """A row for each run of each text."""
    for batch, data, offsets in chunks(batches):
        ids, keys, out = batch.column("_id").to_numpy(), batch.column("_key").to_numpy(), []
        for i in np.flatnonzero(np.diff(offsets) >= LENGTH).tolist():
            for first, number, anchor, content in text_runs(data[offsets[i] : offsets[i + 1]]):
                out.append((anchor.view(np.int64), content.view(np.int64), number.astype(np.int32), np.full(len(first), ids[i]), np.full(len(first), keys[i]), first.astype(np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor", "content", "strings", "_id", "_key", "start"])


RUN = ["anchor", "content", "strings"]
_RUN = [("anchor", pa.int64()), ("content", pa.int64()), ("strings", pa.int32()), ("copies", pa.int64())]


def listed_runs(batches):
    """The runs listed beside each text, with their bytes."""
    for batch, data, offsets in chunks(batches):
        for i, found in enumerate(batch.column("runs").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            for r in found:
                yield r, text[r["start"] : r["start"] + r["strings"] + LENGTH - 1]


def cut_out(batches):
    """The listed runs with their bytes."""
    kind, rows = pa.schema([*_RUN, ("data", pa.binary())]), []
    for r, part in listed_runs(batches):
        rows.append({n: r[n] for n, _ in _RUN} | {"data": part.tobytes()})
        if len(rows) >= 10_000:
            yield pa.RecordBatch.from_pylist(rows, kind)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, kind)


def string_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """The hash of the LENGTH = 128 + 64 + 8 bytes from each position on."""
    h, width, at = _BYTE[data] ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)), 1, {}
    while width < 128:
        h = mix(h[:-width] * _C[0] + h[width:])
        width *= 2
        at[width] = h
    n = len(data) - LENGTH + 1
    return mix(at[128][:n] * _C[1] + at[64][128 : 128 + n] * _C[2] + at[8][192 : 192 + n])


def strings_of(batches):
    """A row for each string of the listed runs: its place in the run and two hashes."""
    kind, rows, n = pa.schema([*_RUN, ("place", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]), [], 0
    for r, part in listed_runs(batches):
        each = [np.full(r["strings"], r[c]) for c, _ in _RUN]
        rows.append([*each, np.arange(r["strings"]), string_hashes(part, 1).view(np.int64), string_hashes(part, 2).view(np.int64)])
        n += r["strings"]
        if n >= 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k.type) for c, k in zip(zip(*rows), kind)], schema=kind)
            rows, n = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k.type) for c, k in zip(zip(*rows), kind)], schema=kind)


def stretches(places: np.ndarray) -> list[dict]:
    """Spans of places (sorted) that follow each other: first and last."""
    cut = np.flatnonzero(np.diff(places) > 1)
    return [{"low": low, "high": high} for low, high in zip(places[np.concatenate([[0], cut + 1])].tolist(), places[np.append(cut, len(places) - 1)].tolist())]


_SPANS = pa.schema([*_RUN, ("found", pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))])


def spanned(batches):
    """Runs with the spans of their listed places."""
    for batch in batches:
        found = [stretches(np.sort(np.array(p))) for p in batch.column("places").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n, _ in _RUN), pa.array(found, _SPANS.field("found").type)], schema=_SPANS)


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as big-endian numbers; the text ends with seven zeros at least."""
    n = len(text) - 7
    keys = text[:n].astype(np.uint64)
    for i in range(1, 8):
        keys <<= np.uint64(8)
        keys |= text[i : n + i]
    return keys


def next_of(places: np.ndarray, n: int) -> np.ndarray:
    """For each of n positions the first of the (sorted) places that isn't before it; at the end the last one."""
    places = places.astype(np.int32)
    number = np.diff(places, prepend=np.int32(-1))
    number[-1] += max(0, n - 1 - int(places[-1]))
    return np.repeat(places, number)[:n]


def sorted_directly(keys: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes at the positions in order, by as many bytes at least; equals stay in order."""
    key = keys[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    del order
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]), dtype=np.int32) if len(at) else np.zeros(0, np.int32)
    tied = np.arange(len(at), dtype=np.int32)
    for d in range(8, depth, 8):
        size = np.bincount(group)
        more = size[group] > 1
        tied, group = tied[more], group[more]
        if not len(tied):
            break
        here = at[tied]
        key = keys[np.minimum(here + d, len(keys) - 1)]
        order = np.lexsort((key, group))
        at[tied], key, group = here[order], key[order], group[order]
        group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]), dtype=np.int32)
    return at


def suffix_array(text: np.ndarray, wanted: np.ndarray, depth: int, keys: np.ndarray | None = None) -> np.ndarray:
    """The wanted positions (flags) in the order of their suffixes' first depth bytes, by two-stage sorting.

    text: bytes above 0 with a 0 after each string, and depth + 8 zeros at the end. Positions take four bytes each, and what
    isn't needed any more is freed, as the memory of a block is a multiple of its text."""
    n = int(np.flatnonzero(text)[-1]) + 2  # with the last separator
    t = text[: n + 1]
    change = np.flatnonzero(t[1:] != t[:-1])
    after = next_of(change, n)  # the last place of each run of one byte
    smaller = t[after] < t[1:][after]  # than its successor: sorted directly
    del change, after
    smaller[t[:n] == 0] = True
    # a suffix that isn't smaller is induced from its successor, so that is needed, up to the next smaller one
    follow = next_of(np.flatnonzero(smaller), n)  # the next smaller one from here on
    depths = np.zeros(n + 1, np.int32)
    depths[:n] = wanted[:n]
    np.subtract.at(depths, follow[wanted[:n]] + 1, 1)
    del follow
    needed = np.cumsum(depths, out=depths)[:n] > 0
    del depths
    direct = sorted_directly(eights(text) if keys is None else keys, np.flatnonzero(needed & smaller).astype(np.int32), depth)
    induced = needed & ~smaller
    del needed, smaller
    heads = t[direct]
    edges = np.searchsorted(heads, np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        own = np.concatenate(buckets[c]) if buckets[c] else np.zeros(0, np.int32)
        buckets[c].clear()
        waves = [own]
        while len(own):  # predecessors with the same byte follow within the bucket
            own = own[own > 0] - 1
            own = own[induced[own] & (t[own] == c)]
            waves.append(own)
        whole = np.concatenate([*waves, direct[edges[c] : edges[c + 1]]])
        if not len(whole):
            continue
        out.append(whole[wanted[whole]])
        before = whole[whole > 0] - 1
        before = before[induced[before] & (t[before] > c)]
        if len(before):
            head = t[before]
            order = np.argsort(head, kind="stable")
            before, head = before[order], head[order]
            cuts = np.flatnonzero(head[1:] != head[:-1]) + 1
            for part in np.split(before, cuts):
                buckets[t[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(keys: np.ndarray, array: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that each suffix shares with the next one in the array, in eights, limit at most."""
    shared = np.zeros(max(0, len(array) - 1), np.int32)
    left = np.arange(len(shared), dtype=np.int32)
    for d in range(0, limit, 8):
        left = left[keys[array[left] + d] == keys[array[left + 1] + d]]
        shared[left] += 8
        if not len(left):
            break
    return shared


def repeated_in_block(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
    """For each (bytes, starts, copies): those of the starts whose LENGTH bytes occur twice or more in the block."""
    sizes = np.array([len(r[0]) + 1 for r in rows])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    text = np.zeros(begin[-1] + LENGTH + 24, np.uint8)
    wanted = np.zeros(len(text), bool)
    for (data, starts, _), at in zip(rows, begin):
        text[at : at + len(data)] = data + 1  # no byte of UTF-8 is 255
        wanted[at + starts] = True
    keys = eights(text)
    array = suffix_array(text, wanted, LENGTH, keys)
    same = common_prefixes(keys, array, LENGTH) >= LENGTH
    again = np.zeros(len(text), bool)
    again[array[:-1][same]] = True
    again[array[1:][same]] = True
    copied = np.repeat(np.array([r[2] > 1 for r in rows]), sizes)
    again[array[copied[array]]] = True
    return [np.flatnonzero(again[at : at + size]) for at, size in zip(begin, sizes)]


def blocks(batches):
    """The rows of whole anchors, which come together, of BLOCK bytes at most; of one anchor alone if that has more (HOT runs at most)."""
    rows: list[dict] = []
    size, own = 0, 0  # bytes of all rows, first row of the last anchor
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r["anchor"] != rows[-1]["anchor"]:
                own = len(rows)
            rows.append(r)
            size += len(r["data"])
            if size > BLOCK and own:
                yield rows[:own]
                rows, own = rows[own:], 0
                size = sum(len(x["data"]) for x in rows)
    if rows:
        yield rows


def searched(batches):
    """Runs with the spans of their repeated strings; the rows of one anchor come together."""
    for rows in blocks(batches):
        found = repeated_in_block([(np.frombuffer(r["data"], np.uint8), np.arange(r["strings"]), r["copies"]) for r in rows])
        yield pa.RecordBatch.from_pylist([{n: r[n] for n, _ in _RUN} | {"found": stretches(f)} for r, f in zip(rows, found) if len(f)], _SPANS)


def cleaned(batches):
    """Bytes, removed bytes, removed runs and the digest of what is left, from texts and their spans."""
    for batch, data, offsets in chunks(batches):
        rows = []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            text, removed, runs_, kept, at = data[offsets[i] : offsets[i + 1]].tobytes(), 0, 0, [], 0
            for low, high in merged(spans):
                kept.append(text[at:low])
                removed, runs_, at = removed + high - low, runs_ + 1, high
            kept.append(text[at:])
            rows.append((len(text), removed, runs_, hashlib.sha256(b"".join(kept)).hexdigest()))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans of bytes in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans or []):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """docs with what tells their rows apart: _id and _key."""
    identity: Column = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))
    return docs.select("doc_id", texts(docs).alias("text"), identity.alias("_id"), F.xxhash64(texts(docs)).alias("_key"))


def of_rows(docs: DataFrame, rows: DataFrame, alike: bool = True) -> DataFrame:
    """docs joined with rows on their identity, where few enough by a broadcast of the keys first, so other texts don't move; alike: with all
    of the docs that share an identity, and else with one of them."""
    docs = docs.join(bounded(rows.select("_id", "_key"), rows.count()), ["_id", "_key"], "left_semi")
    return (docs if alike else docs.dropDuplicates(["_id", "_key"])).join(rows, ["_id", "_key"])


def hot_spans(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Spans of repeated strings in runs of anchors that have too many, by counts of the strings' hashes."""
    kind = "anchor long, content long, strings int, copies long"
    by_text = written(runs.groupBy("_id", "_key").agg(F.collect_list(F.struct(*RUN, "copies", "start")).alias("runs")))
    each = written(of_rows(docs, by_text, False).mapInArrow(strings_of, f"{kind}, place int, h1 long, h2 long"))
    twice = each.groupBy("h1", "h2").agg(F.sum("copies").alias("_all"), F.count("*").alias("_n")).filter("_all > 1")
    found = spread_join(each, twice, ["h1", "h2"], "_n", each.count()).groupBy(*RUN, "copies").agg(F.collect_list("place").alias("places"))
    return found.mapInArrow(spanned, f"{kind}, found array<struct<low: int, high: int>>")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """_id, _key and spans (low and high byte) of all texts of keyed() that have repeated strings; spans may touch."""
    found = written(docs.mapInArrow(anchored, "anchor long, content long, strings int, _id long, _key long, start long"))
    twice = found.groupBy("anchor").agg(F.count("*").alias("_n")).filter("_n > 1")
    places = written(spread_join(found, twice, "anchor", "_n", found.count()).drop("_n"))
    distinct = places.groupBy(*RUN).agg(F.count("*").alias("copies"), F.min(F.struct("_id", "_key", "start")).alias("at"))
    distinct = written(distinct.select(*RUN, "copies", "at.*"))
    hot = written(distinct.groupBy("anchor").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT))
    n_hot = hot.count()
    usual = distinct.join(bounded(hot.select("anchor"), n_hot), "anchor", "left_anti") if n_hot else distinct
    by_text = written(usual.groupBy("_id", "_key").agg(F.collect_list(F.struct(*RUN, "copies", "start")).alias("runs")))
    kind = "anchor long, content long, strings int, copies long"
    data = of_rows(docs.drop("doc_id"), by_text, False).mapInArrow(cut_out, f"{kind}, data binary")
    spans = data.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(searched, f"{kind}, found array<struct<low: int, high: int>>")
    if n_hot:
        spans = spans.unionByName(hot_spans(docs.drop("doc_id"), distinct.join(bounded(hot.select("anchor"), n_hot), "anchor", "left_semi")))
    back = spread_join(places, written(spans), RUN, "copies", places.count()).select("_id", "_key", "start", F.inline("found"))
    span = F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high") + LENGTH).alias("high"))
    return back.groupBy("_id", "_key").agg(F.collect_set(span).alias("spans"))


def removed(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    docs = keyed(docs)
    spans = written(repeated_spans(docs))
    columns = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    touched = of_rows(docs, spans).select("doc_id", "text", "spans").mapInArrow(cleaned, columns)
    rest = docs.join(bounded(spans.select("_id", "_key"), spans.count()), ["_id", "_key"], "left_anti")
    size = F.octet_length("text").cast("long")
    whole = rest.select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return touched.unionByName(whole)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))

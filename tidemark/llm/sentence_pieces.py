"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The pieces come from a public model file, whose path is a parameter. A unigram file's log scores are used as they
are; a BPE file holds merge ranks instead of probabilities, which Zipf's law turns into log scores: -ln(rank + 2), rounded to 1/1024 so that
sums are exact and equal paths tie.
Characters without a piece fall back to byte pieces. A space is the piece character U+2581, and a text gets one in
front, as the file's normaliser says. No piece of such files runs across the start of a word, so each distinct word of
a chunk of texts is encoded once, all of them in step: the Viterbi recursion moves on by one byte for all words
together, in arrays. For a file where a piece does run across, whole texts are encoded one by one.

Decoding joins the pieces' bytes, turns markers into spaces and drops the one in front: the text comes back as it
was, but for characters U+2581 in it, which become spaces.

Defined cases: null and empty texts have no pieces and decode to an empty text; a null id passes through; an empty
table gives an empty result; other columns of the input pass through encoded() and decoded(), whose own column takes
the place of one of the same name."""

from __future__ import annotations

import hashlib
import math
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, gathered, packed, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are encoded at once, distinct words that a task remembers where texts are encoded one by one, and
#: bytes of a word up to which words move in step.
CHUNK, MEMO, LONG = 1 << 22, 250_000, 96
MARK = "▁"
#: Kinds of pieces in a model file (fixed values): normal, unknown, control, user-defined, unused, byte.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: How far an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0


def fields(data: bytes):
    """The (number, value) pairs of a protocol-buffer message; length-delimited values are bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0], at + n
        yield key >> 3, value


class Trie:
    """A double-array trie over bytes: the child of state s by byte b is t = base[s] + b + 1 if check[t] is s."""

    def __init__(self, pieces: dict[bytes, int]):
        keys = sorted(pieces)
        size = 8 * sum(map(len, keys)) + 4096
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        used = bytearray(size)
        used[0] = 1
        single = several = 1  # where the search for free places begins
        tasks = [(0, 0, len(keys), 0)]  # state, range of keys, depth
        last = 0
        while tasks:
            state, lo, hi, depth = tasks.pop()
            if lo < hi and len(keys[lo]) == depth:
                self.value[state] = pieces[keys[lo]]
                lo += 1
            if lo >= hi:
                continue
            edges, at = [], lo
            while at < hi:
                b, begin = keys[at][depth], at
                while at < hi and keys[at][depth] == b:
                    at += 1
                edges.append((b + 1, begin, at))
            low = edges[0][0]
            place = used.find(0, max(low, single if len(edges) == 1 else several))
            tries = 0
            while any(used[place - low + e] for e, _, _ in edges):
                place, tries = used.find(0, place + 1), tries + 1
            if len(edges) == 1:
                single = place if place > low else single
            elif tries > 32:
                several = place
            self.base[state] = place - low
            for e, begin, end in edges:
                t = place - low + e
                used[t], self.check[t] = 1, state
                last = max(last, t)
                tasks.append((t, begin, end, depth + 1))
        for x in (self.base, self.check, self.value):
            del x[last + 260 :]


class Pieces:
    """What a model file holds, ready to encode and decode."""

    def __init__(self, model: bytes):
        pieces, kind, self.prefix, self.squeeze = [], 1, True, True
        for number, value in fields(model):
            if number == 1:
                p = {1: b"", 2: 0.0, 3: NORMAL} | dict(fields(value))
                pieces.append((p[1], p[2], p[3]))
            elif number == 2:
                kind = dict(fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(fields(value))
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2) or not spec.get(5, 1):
                    raise ValueError("this model file maps characters before it encodes, or keeps spaces as they are; only files that do neither are read")
        if any(p[2] == USER for p in pieces):
            raise ValueError("this model file has user-defined pieces, which go before all others; only files without them are read")
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        matched = [i for i, p in enumerate(pieces) if p[2] == NORMAL]
        self.scores = [p[1] for p in pieces]
        if kind != 1:
            best = max((pieces[i][1] for i in matched), default=0.0)
            for i in matched:
                self.scores[i] = round(-math.log(best - pieces[i][1] + 2) * 1024) / 1024
        self.floor = min((self.scores[i] for i in matched), default=0.0) - UNKNOWN_PENALTY
        self.byte = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == BYTE}
        mark = MARK.encode()
        self.trie = Trie({pieces[i][0]: i for i in matched})
        self.across = any(mark in pieces[i][0].replace(mark, b" ").lstrip(b" ").replace(b" ", mark) for i in matched)
        shown = {i: bytes([b]) for b, i in self.byte.items()}
        self.shown = [b"" if p[2] in (CONTROL, UNKNOWN) else shown.get(i, p[0]) for i, p in enumerate(pieces)]
        # the same as arrays
        self.arrays = [np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value)] + [np.array(self.scores)]
        self.byte_ids = np.array([self.byte.get(b, self.unknown) for b in range(256)], np.int32)
        spaced = [x.replace(mark, b" ") for x in self.shown]
        self.spaced, self.spaced_ends = np.frombuffer(b"".join(spaced), np.uint8), np.cumsum([0, *map(len, spaced)])

    def best(self, word: str) -> list[int]:
        """Pieces of the best segmentation of a marked word (Viterbi); the earliest found wins among equals."""
        data = word.encode()
        n = len(data)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        total, came, by = [None] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        total[0] = 0.0
        at = 0
        while at < n:
            here, state, b = total[at], 0, data[at]
            step = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            single = False
            for i in range(at, n):
                t = base[state] + data[i] + 1
                if check[t] != state:
                    break
                state = t
                p = value[t]
                if p >= 0:
                    end, s = i + 1, here + scores[p]
                    if total[end] is None or s > total[end]:
                        total[end], came[end], by[end] = s, at, p
                    if end - at == step:
                        single = True
            if not single:
                end, s = at + step, here + self.floor
                if total[end] is None or s > total[end]:
                    total[end], came[end], by[end] = s, at, -1
            at += step
        out = []
        while n > 0:
            if by[n] >= 0:
                out.append(by[n])
            elif self.byte:
                out += [self.byte[x] for x in data[came[n] : n][::-1]]
            else:
                out.append(self.unknown)
            n = came[n]
        return out[::-1]

    def best_of_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """best() of marked words (bytes), LONG bytes each at most: pieces end to end, and the n + 1 offsets of the words' pieces.

        Words lie in one array with an end after each. At step c the c-th byte of every word is the start of the pieces
        that the trie finds there; so starts are met in order, as in best()."""
        base, check, value, scores = self.arrays
        data, offsets = packed(words)
        n, sizes = len(offsets) - 1, np.diff(offsets)
        begin = offsets[:-1] + np.arange(n)
        text = np.full(len(data) + n + 1, 256, np.int32)
        text[np.arange(len(data)) + np.repeat(np.arange(n), sizes)] = data
        starts = (text & 0xC0) != 0x80  # of characters, and ends
        starts[begin] = True
        after = np.flatnonzero(starts)
        step = np.ones(len(text), np.int64)  # bytes of the character
        step[after[:-1]] = np.diff(after)
        total, came, by = np.full(len(text), -np.inf), np.zeros(len(text), np.int64), np.zeros(len(text), np.int32)
        total[begin] = 0.0
        order = np.argsort(-sizes, kind="stable")
        firsts, falling = begin[order], -sizes[order]

        def reach(ends, score, origin, piece):
            better = score > total[ends]
            ends = ends[better]
            total[ends], came[ends], by[ends] = score[better], origin[better], piece[better]

        for c in range(int(sizes.max(initial=0))):
            at = firsts[: np.searchsorted(falling, -c)] + c
            at = at[starts[at]]
            alone, left, state, d = np.ones(len(at), bool), np.arange(len(at)), np.zeros(len(at), np.int32), 0
            while len(left):
                here = at[left]
                to = base[state] + text[here + d] + 1
                ok = check[to] == state
                left, state, here, d = left[ok], to[ok], here[ok], d + 1
                found = value[state]
                hit = found >= 0
                if hit.any():
                    origin, piece = here[hit], found[hit]
                    reach(origin + d, total[origin] + scores[piece], origin, piece)
                    alone[left[hit][step[origin] == d]] = False
            lone = at[alone]
            reach(lone + step[lone], total[lone] + self.floor, lone, np.full(len(lone), -1, np.int32))
        out = np.full(len(text), -1, np.int32)
        low, at = begin, begin + sizes
        while True:  # back from the ends
            on = at > low
            low, at = low[on], at[on]
            if not len(at):
                break
            origin, piece = came[at], by[at]
            out[origin[piece >= 0]] = piece[piece >= 0]
            lost, until = origin[piece < 0], at[piece < 0]
            if self.byte:
                while len(lost):
                    out[lost] = self.byte_ids[text[lost]]
                    lost, until = lost[lost + 1 < until] + 1, until[lost + 1 < until]
            else:
                out[lost] = self.unknown
            at = origin
        number = np.concatenate([[0], np.cumsum(out >= 0)])
        return out[out >= 0], np.append(number[begin], number[-1])

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts of a column end to end, and the n + 1 offsets of the texts' pieces."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if self.squeeze:
            column = pc.utf8_rtrim(pc.utf8_ltrim(pc.replace_substring_regex(column, " +", " "), " "), " " + MARK)
        data, offsets = packed(pc.replace_substring(column, MARK, " "))
        if self.prefix:  # a space in front of each text that isn't empty
            some = np.diff(offsets) > 0
            data = np.insert(data, offsets[:-1][some], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(some)])
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        bounds = np.append(np.flatnonzero(begins), len(data))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = pc.replace_substring(words.dictionary, b" ", MARK.encode())
        usual = pc.less_equal(pc.binary_length(distinct), LONG)
        pieces, ends = self.best_of_all(distinct.filter(usual))
        usual = usual.to_numpy(zero_copy_only=False)
        if not usual.all():
            rare = [self.best(w.decode(errors="replace")) for w in distinct.filter(pa.array(~usual)).to_pylist()]
            sizes = np.zeros(len(usual), np.int64)
            sizes[usual], sizes[~usual] = np.diff(ends), [len(r) for r in rare]
            mixed, own = np.zeros(sizes.sum(), np.int32), np.repeat(usual, sizes)
            mixed[own], mixed[~own] = pieces, np.concatenate(rare)
            pieces, ends = mixed, np.concatenate([[0], np.cumsum(sizes)])
        ids, bounds_of_ids = gathered(pieces, ends, words.indices.to_numpy(zero_copy_only=False))
        return ids, bounds_of_ids[np.searchsorted(bounds[:-1], offsets)]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """decode() of many texts: bytes end to end, and the n + 1 offsets of the texts."""
        data, bounds = gathered(self.spaced, self.spaced_ends, ids)
        ends = bounds[ends]
        if self.prefix:
            front = ends[:-1][np.diff(ends) > 0]
            front = front[data[front] == 32]
            data = np.delete(data, front)
            ends = ends - np.searchsorted(front, ends)
        return data, ends

    def marked(self, text: str) -> str:
        if self.squeeze:  # markers of the text itself stay, but for those at its end
            text = re.sub(" +", " ", text).lstrip(" ").rstrip(" " + MARK)
        text = text.replace(" ", MARK)
        return MARK + text if self.prefix and text else text

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.shown.__getitem__, ids)).decode(errors="replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Encoder(dict):
    """Pieces of words, remembered."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, word: str) -> list[int]:
        if len(self) > MEMO:
            self.clear()
        found = self.pieces.best(word)
        if len(word) < 64:
            self[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        text = self.pieces.marked(text)
        if self.pieces.across:
            return self.pieces.best(text) if text else []
        return [p for w in map(self.__getitem__, _WORD.findall(text)) for p in w]


def loaded(spark: SparkSession, model: str = MODEL):
    """The model file, read by Spark from a path that it knows (a bare path is the driver's own), shared with all tasks."""
    if "://" in model:
        data = bytes(spark.read.format("binaryFile").load(model).select("content").first().content)
    else:
        with open(model, "rb") as f:
            data = f.read()
    return spark.sparkContext.broadcast(Pieces(data))


def encoded_chunks(pieces: Pieces, batches):
    """Each batch in chunks, with the pieces of its texts end to end and their offsets."""
    encoder = Encoder(pieces)
    for batch, _, _ in chunks(batches, limit=CHUNK):
        column = batch.column(batch.schema.get_field_index("text"))
        if pieces.across:
            each = [encoder.encode(t or "") for t in column.to_pylist()]
            yield batch, np.array([p for e in each for p in e], np.int32), np.cumsum([0, *map(len, each)])
        else:
            yield batch, *pieces.encode_all(column)


def with_column(df: DataFrame, shared, name: str, kind: str, run):
    """df with one more column, or another in the place of one of that name, from a function of batches."""
    rest = [c for c in df.columns if c != name]

    def each(batches):
        for batch, column in run(shared.value, batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), column], names=[*rest, name])

    return df.mapInArrow(each, df.select(*[f"`{c}`" for c in rest], F.lit(None).cast(kind).alias(name)).schema)


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with piece_ids."""

    def run(pieces, batches):
        for batch, ids, ends in encoded_chunks(pieces, batches):
            yield batch, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    return with_column(docs, loaded(docs.sparkSession, model), "piece_ids", "array<int>", run)


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows, which have piece_ids, with decoded: the text of those pieces."""

    def run(pieces, batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield part, pa.array([pieces.decode(x or []) for x in part.column(part.schema.get_field_index("piece_ids")).to_pylist()], pa.string())

    return with_column(rows, loaded(rows.sparkSession, model), "decoded", "string", run)


def digested(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per text: n_pieces, n_byte_pieces, ids_sha256 (little-endian int32), decoded_sha256 and round_trip, in one pass."""
    shared = loaded(docs.sparkSession, model)

    def run(batches):
        pieces = shared.value
        is_byte = np.zeros(len(pieces.scores), bool)
        is_byte[list(pieces.byte.values())] = True
        for batch, ids, ends in encoded_chunks(pieces, batches):
            back, back_ends = pieces.decode_all(ids, ends)
            data, offsets = packed(batch.column(batch.schema.get_field_index("text")))
            ids, numbers, rows = ids.astype("<i4"), np.concatenate([[0], np.cumsum(is_byte[ids])]), []
            for i in range(batch.num_rows):
                text = back[back_ends[i] : back_ends[i + 1]].tobytes()
                rows.append((hashlib.sha256(ids[ends[i] : ends[i + 1]]).hexdigest(), hashlib.sha256(text).hexdigest(), text == data[offsets[i] : offsets[i + 1]].tobytes()))
            ids_sha, text_sha, same = zip(*rows)
            columns = [pa.array(np.diff(ends)), pa.array(np.diff(numbers[ends])), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"))

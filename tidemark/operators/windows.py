"""Windows of words by their share of equal letters with a text: difflib's ratio by a matrix of bits, and bounds above it."""

from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple

import numpy as np

#: Length from which difflib takes frequent letters as junk; bytes of states kept at a time; words of bits read side by side.
JUNK, KEPT, LANES = 200, 1 << 22, 1 << 15
#: Classes of letters; asks that are too few to be read side by side; stretches as long as a window.
CLASSES, FEW, STRETCH = 101, 8, 4
#: Classes of pairs and triples of letters; ratios above which few windows share enough of them.
GRAMS, HIGH = 1 << 12, 0.75
#: Letters to a word of 64 bits, all of them, and where their carry goes.
BITS, LIMB, CARRY = 63, np.uint64((1 << 63) - 1), np.uint64(63)


def ratio(a: str, b: str, least: float = 0.0, letters: dict[str, list[int]] | None = None) -> float:
    """SequenceMatcher(None, a, b).ratio(), or 0.0 as soon as that is known to be below least. Letters are places_of(a), if known."""
    if len(b) >= JUNK:
        return _ratio_with_junk(a, b, least, letters or places_of(a))
    if not a or not b:
        return float(a == b)
    size = len(b) // 8 + 1
    width, places, one = 8 * size, {}, 1
    for c in b:
        places[c] = places.get(c, 0) | one
        one <<= 1
    none, rows = bytes(size), {c: p.to_bytes(size, "little") for c, p in places.items()}
    # a row of bits for each letter of a, so equal runs stand one row and one bit apart; the last bit of a row is never set
    equal = int.from_bytes(b"".join([rows.get(c, none) for c in a]), "little")
    met, room, total, todo = 0, min(len(a), len(b)), len(a) + len(b), [(0, len(a), 0, len(b))]
    while todo and 2.0 * (met + room) / total >= least:
        low, high, left, right = todo.pop()
        part = equal >> (low * width + left) & int.from_bytes(((1 << right - left) - 1).to_bytes(size, "little") * (high - low), "little")
        room -= min(high - low, right - left)
        if not part:
            continue
        runs, k = [part], 1
        while more := part & part >> k * (width + 1):  # runs twice as long
            runs.append(more)
            part, k = more, 2 * k
        step = k
        while step > 1:
            step //= 2
            if more := part & runs[step.bit_length() - 1] >> k * (width + 1):
                part, k = more, k + step
        i, j = divmod((part & -part).bit_length() - 1, width)  # the first in a, then in b
        i, j, met = i + low, j + left, met + k
        for x, y, z, w in ((low, i, left, j), (i + k, high, j + k, right)):
            if y - x == 1 and z < w:
                met += a[x] in b[z:w]
            elif w - z == 1 and x < y:
                met += b[z] in a[x:y]
            elif x < y and z < w:
                todo.append((x, y, z, w))
                room += min(y - x, w - z)
    return 0.0 if todo else 2.0 * met / total


def _ratio_with_junk(a: str, b: str, least: float, letters: dict[str, list[int]]) -> float:
    """The same for a long b: runs begin with letters that are rare in b, then go on over all equal letters."""
    points = [(i, j) for c, ends in places_of(b).items() if len(ends) <= len(b) // 100 + 1 for i in letters.get(c, ()) for j in ends]
    points.sort()
    met, room, total, todo = 0, min(len(a), len(b)), len(a) + len(b), [(0, len(a), 0, len(b), points)]
    while todo and 2.0 * (met + room) / total >= least:
        low, high, left, right, points = todo.pop()
        room -= min(high - low, right - left)
        i, j, k, runs = low, left, 0, {}
        for x, y in points:
            runs[x, y] = n = runs.get((x - 1, y - 1), 0) + 1
            if n > k:
                i, j, k = x - n + 1, y - n + 1, n
        while i > low and j > left and a[i - 1] == b[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k < high and j + k < right and a[i + k] == b[j + k]:
            k += 1
        met += k
        before, behind = [p for p in points if p[0] < i and p[1] < j], [p for p in points if p[0] >= i + k and p[1] >= j + k]
        for rest in ((low, i, left, j, before), (i + k, high, j + k, right, behind)):
            if rest[0] < rest[1] and rest[2] < rest[3] and (rest[4] or a[rest[0]] == b[rest[2]]):  # else nothing is equal that counts
                todo.append(rest)
                room += min(rest[1] - rest[0], rest[3] - rest[2])
    return 0.0 if todo else 2.0 * met / total


def places_of(text: str) -> dict[str, list[int]]:
    """Where each letter stands."""
    out: dict[str, list[int]] = {}
    for at, c in enumerate(text):
        if c in out:
            out[c].append(at)
        else:
            out[c] = [at]
    return out


def _repeated(bits: int, size: int, times: int) -> int:
    return int.from_bytes(bits.to_bytes(size, "little") * times, "little") if times > 1 else bits


def free_letters(text: str, words: list[str], starts: int, lanes: int) -> np.ndarray:
    """By last word and lane: how many letters of the text are not in its longest common subsequence with the lane's window.

    At each of the first words, as many as starts, a window begins, in the next lane. A bit for each letter of the text says that it is
    free (Hyyrö), and one more takes the carry. The words are read once: windows that a letter lies in take it together."""
    size, full = len(text) // 8 + 1, (1 << len(text)) - 1
    letters: dict[str, int] = {}
    one = 1
    for c in text:
        letters[c] = letters.get(c, 0) | one
        one <<= 1
    letters = {c: _repeated(bits, size, lanes) for c, bits in letters.items()}
    get, space, inside, free = letters.get, letters.get(" "), _repeated(full, size, lanes), 0
    kept, parts = [], []
    for at, word in enumerate(words):
        if space:
            met = free & space
            free = ((free + met) | (free - met)) & inside
        if at < starts:
            free |= full << 8 * size * (at % lanes)  # behind the space
        for c in word:
            if same := get(c):
                met = free & same
                free = ((free + met) | (free - met)) & inside
        kept.append(free.to_bytes(size * lanes, "little"))
        if len(kept) * size * lanes > KEPT or at + 1 == len(words):
            bits = np.bitwise_count(np.frombuffer(b"".join(kept), dtype=np.uint8)).reshape(len(kept), lanes, size)
            parts.append(bits.sum(axis=2, dtype=np.int32))
            kept = []
    return np.concatenate(parts)


class Heard:
    """Words that texts are sought in: with a space between them, where each begins, and the classes of letters with a space behind each."""

    def __init__(self, words: list[str]):
        self.words, self.text = words, " ".join(words)
        self.starts = [0, *accumulate(len(w) + 1 for w in words)]
        self.edges, self.letters = np.array(self.starts), classes(self.text + " " if words else "")

    def window(self, first: int, n: int) -> str:
        return self.text[self.starts[first] : self.starts[first + n] - 1]


class Ask(NamedTuple):
    """A text and the windows it is compared with: from these starts on, of these sizes, as far as their ratio can be above over."""

    text: str
    heard: Heard
    starts: range
    sizes: range
    over: float

    def limbs(self) -> int:
        """Words of 63 bits for the text's letters, with one for the carry; an even number but for the shortest."""
        n = -(-len(self.text) // BITS)
        return n + n % 2 if n > 2 else n


def likely(asks: list[Ask]) -> list[list[tuple[float, int, int]]]:
    """For asks of equal limbs, the windows (first word, words) by what their ratio can be at most, if above over; the best first.

    Matching blocks are a common subsequence, so none is above the longest one's share."""
    return [_likely(a) for a in asks] if len(asks) < FEW else _likely_of_many(asks)


def _likely(a: Ask) -> list[tuple[float, int, int]]:
    said, edges, found = classes(a.text), a.heard.edges, []
    for starts in _ranges(a, said) if a.over > HIGH else [a.starts]:
        low, lanes = starts[0], min(len(starts), a.sizes[-1])
        free = free_letters(a.text, a.heard.words[low : starts[-1] + a.sizes[-1]], len(starts), lanes)
        first, n = np.arange(len(starts))[:, None], np.array(a.sizes)
        last = np.minimum(first + n, len(free))
        bounds = 2.0 * (len(said) - free[last - 1, first % lanes]) / (len(said) + edges[low + last] - 1 - edges[low + first])
        rows, columns = np.nonzero((bounds > a.over) & (last == first + n))
        found += zip(bounds[rows, columns].tolist(), (rows + low).tolist(), (columns + a.sizes[0]).tolist())
    return sorted(found, key=lambda x: (-x[0], x[1:]))


def _ranges(a: Ask, said: np.ndarray) -> list[range]:
    """Ranges of starts that hold all windows whose ratio can be above over by the letters they share; those near one another are one."""
    edges = a.heard.edges[a.starts[0] : a.starts[-1] + a.sizes[-1] + 1]
    first, heard, none = np.arange(len(a.starts))[:, None], a.heard.letters[edges[0] : edges[-1]], np.zeros((1, 1), dtype=np.intp)
    edges, last = edges - edges[0], np.minimum(first + np.array(a.sizes), len(edges) - 1)
    bounds = _bounds(said, np.array([len(said)]), heard, np.array([len(heard)]), none, edges[first], edges[last] - 1, 2 if a.limbs() == 1 else 3)
    near = np.flatnonzero((bounds > a.over).any(axis=1)) + a.starts[0]
    parts = np.split(near, np.flatnonzero(np.diff(near) >= a.sizes[-1]) + 1)
    return [range(int(part[0]), int(part[-1]) + 1) for part in parts if len(part)]


def classes(text: str) -> np.ndarray:
    """The class of each letter. ASCII's letters, digits and the space have one each."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.intp) % CLASSES


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of as many items as are counted: whose each is, and its number there."""
    whose = np.repeat(np.arange(len(counts)), counts)
    return whose, np.arange(len(whose)) - (np.cumsum(counts) - counts)[whose]


def _likely_of_many(asks: list[Ask]) -> list[list[tuple[float, int, int]]]:
    """The same, read side by side. Letters of one class count as equal, which only adds to bounds.

    Long texts are compared with stretches of starts as a whole first; their windows have no more in common with a text than they have."""
    limbs = asks[0].limbs()
    table = np.zeros((limbs, len(asks) * CLASSES), dtype=np.uint64)  # a bit for each letter of a text, by its class
    length, over, number, least, most = (np.array(x) for x in zip(*((len(a.text), a.over, len(a.starts), a.sizes[0], a.sizes[-1]) for a in asks)))
    said, (whose, place) = classes("".join([a.text for a in asks])), _counted(length)
    np.bitwise_or.at(table.reshape(-1), (place // BITS * len(asks) + whose) * CLASSES + said, np.uint64(1) << (place % BITS).astype(np.uint64))
    parts = [a.heard.edges[a.starts[0] : a.starts[-1] + a.sizes[-1] + 1] for a in asks]
    heard = np.concatenate([a.heard.letters[e[0] : e[-1]] for a, e in zip(asks, parts)])
    spans, words = np.array([e[-1] - e[0] for e in parts]), np.array([len(e) - 1 for e in parts])
    edges = np.concatenate(parts) + np.repeat(np.cumsum(spans) - spans - [e[0] for e in parts], words + 1)
    base = np.cumsum(words + 1) - words - 1
    ask, start = _counted(number)
    some = np.flatnonzero(over[ask] > HIGH)
    if len(some):
        first, last = start[some][:, None], start[some][:, None] + least[ask[some]][:, None] + np.arange(int((most - least).max()) + 1)
        ends = edges[base[ask[some]][:, None] + np.minimum(last, words[ask[some]][:, None])] - 1
        near = np.ones(len(ask), dtype=bool)
        near[some] = (_bounds(said, length, heard, spans, ask[some][:, None], edges[base[ask[some]][:, None] + first], ends, 2 if limbs == 1 else 3) > over[ask[some]][:, None]).any(axis=1)
        ask, start = ask[near], start[near]
    heard += np.repeat(np.arange(len(asks)) * CLASSES, spans)
    if limbs > 1:
        cell = start // np.maximum(1, most // STRETCH)[ask]
        begin = np.ones(len(ask), dtype=bool)
        begin[1:] = (cell[1:] != cell[:-1]) | (ask[1:] != ask[:-1])
        heads = np.flatnonzero(begin)
        whose, first, last = ask[heads], start[heads], start[np.append(heads[1:], len(ask)) - 1] if len(ask) else heads
        begins = edges[base[whose] + first]
        met = _read(table, heard, begins, (edges[base[whose] + np.minimum(last + most[whose], words[whose])] - 1 - begins)[:, None])[:, 0]
        shortest = edges[base[ask] + start + least[ask]] - 1 - edges[base[ask] + start]
        shortest = np.minimum.reduceat(shortest, heads) if len(ask) else shortest
        near = (2.0 * met / (length[whose] + shortest) > over[whose])[np.cumsum(begin) - 1]
        ask, start = ask[near], start[near]
    begins, last = edges[base[ask] + start], (start + least[ask])[:, None] + np.arange(int((most - least).max()) + 1)
    there = last <= np.minimum(words[ask], start + most[ask])[:, None]
    sizes = np.where(there, edges[base[ask][:, None] + np.minimum(last, words[ask][:, None])] - 1 - begins[:, None], 0)
    bounds = 2.0 * _read(table, heard, begins, sizes) / (length[ask][:, None] + sizes)
    row, column = np.nonzero(bounds > over[ask][:, None])
    bounds, ask, start = bounds[row, column], ask[row], start[row]
    column += least[ask]
    order = np.lexsort((column, start, -bounds, ask))
    out: list[list[tuple[float, int, int]]] = [[] for _ in asks]
    for k, bound, first, n in zip(*(x[order].tolist() for x in (ask, bounds, start, column))):
        out[k].append((bound, asks[k].starts[first], n))
    return out


def _bounds(said: np.ndarray, length: np.ndarray, heard: np.ndarray, spans: np.ndarray, ask: np.ndarray, first: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """What the ratios of windows can be at most by the pairs or triples of letters, as k says, that their texts have too.

    Blocks that hold M letters of the L in text and window are L - 2M + 1 at most, as there are other letters between them. A block
    has as many pairs as letters but for one, and as many triples but for two."""
    text, region = np.repeat(np.arange(len(length)), length), np.repeat(np.arange(len(length)) * GRAMS, spans)
    said_grams, heard_grams = said, heard
    for n in range(1, k):
        said_grams, heard_grams = (said_grams[:-1] * 37 + said[n:]) % GRAMS, (heard_grams[:-1] * 37 + heard[n:]) % GRAMS
    table = np.zeros(len(length) * GRAMS, dtype=bool)
    table[(text[: len(said_grams)] * GRAMS + said_grams)[text[k - 1 :] == text[: len(said_grams)]]] = True
    shared = np.concatenate([[0], np.cumsum(table[region[: len(heard_grams)] + heard_grams]), [0] * k])
    total = length[ask] + end - first
    return 2.0 * ((k - 1) * (total + 1) + shared[np.maximum(end - k + 1, first)] - shared[first]) / ((2 * k - 1) * total)


def _read(table: np.ndarray, heard: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Letters of the longest common subsequence, at least, of texts and what was heard: from where a row begins, of each of its lengths."""
    out, longest, done = np.zeros(lengths.shape, dtype=np.int64), lengths.max(axis=1, initial=0), 0
    while done < len(out):
        rows = np.arange(done, min(len(out), done + LANES // len(table)))
        rows = rows[np.argsort(-longest[rows], kind="stable")]
        out[rows] = _met(table, heard, begins[rows], longest[rows])[lengths[rows], np.arange(len(rows))[:, None]]
        done += len(rows)
    return out


def _met(table: np.ndarray, heard: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Letters of texts that are met after each letter that is read, as in free_letters; a column each, the longest first."""
    (limbs, _), steps, lanes = table.shape, int(lengths[0]), len(at)
    free, met = np.full((limbs, lanes), LIMB), np.zeros((steps + 1, lanes), dtype=np.uint8 if BITS * limbs < 256 else np.int32)
    letters, useds, nows, counts, at = np.empty(lanes, np.intp), np.empty((limbs, lanes), np.uint64), np.empty((limbs, lanes), np.uint64), np.empty((limbs, lanes), np.uint8), at - 1
    rows, reading = list(table), np.searchsorted(-lengths, -np.arange(steps), side="left")
    for step, n in enumerate(reading.tolist(), 1):
        at += 1
        letter, was, used, now, count = letters[:n], free[:, :n], useds[:, :n], nows[:, :n], counts[:, :n]
        heard.take(at[:n], out=letter, mode="clip")
        for limb in range(limbs):
            rows[limb].take(letter, out=used[limb], mode="clip")
        np.bitwise_and(used, was, out=used)
        np.add(was, used, out=now)
        for limb in range(1, limbs):
            now[limb] += now[limb - 1] >> CARRY
        np.subtract(was, used, out=used)
        np.bitwise_or(now, used, out=now)
        np.bitwise_and(now, LIMB, out=was)
        np.bitwise_count(was, out=count)
        np.subtract(BITS * limbs, count[0] if limbs == 1 else count.sum(axis=0, dtype=met.dtype), out=met[step, :n], casting="unsafe")
    return met

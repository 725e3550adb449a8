"""SentencePiece encoding and decoding by a max-plus parallel scan (operator 5).

The best segmentation of a text into scored pieces is a longest path, and longest paths compose: a stretch of text is a max-plus
matrix from the place of its first token boundary to the place of the first one behind it (a piece may straddle the cut, so
there are as many states as a piece has characters). A text longer than a chunk is split into rows; each row yields its matrix,
a document's matrices are combined, and every row is traced back on its own between the boundary states it is given. A shorter text is one
stretch. Inside a stretch, paths meet wherever no piece can straddle (before a space that follows another character), so equal words are solved
once, many at a time. Scores are integers, so the result does not depend on where texts are cut. Ties: the longest last piece.

That is how a unigram model reads (``encode``). The shipped model is one of merges (BPE): in each word the adjacent pair of the best rank is merged until
none is a piece. ``encode_merges`` gives its ids by the same scan. Merges never cross the border of two final pieces, so a sequence of pieces is what the
merges make of a text exactly if each two neighbours are what the merges make of those two alone: of all segmentations one has only
such neighbours. With weight 0 for such a step and minus infinity for any other, the ids are the longest path, and what a path needs to know of its past is its last
piece. The states at a cut are the pieces that may lie across it or end at it; a chunk is the matrix between the states at its two cuts, wherever they fall, also
inside a word. Matrices are multiplied in a tree of bounded groups, the states are handed down the same tree, and each chunk is traced back on its own.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfall.llm.common import pieces as row_pieces
from outfall.llm.common import ship, stored
from outfall.llm.words import mix, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters in a stretch; a longer text is split.
CHUNK = 32_768
SPACE = 0x2581
NONE = -(1 << 60)
#: Fixed value: how much worse than the worst piece an unknown character is.
UNKNOWN_PENALTY = 10
_SCALE = 1000
_CELLS = 100_000
#: Characters of a word from which merges are taken from a heap.
LONG_WORD = 64
#: Adjacent matrices that are multiplied in one task.
FAN = 64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class Vocabulary:
    """Pieces in an open-addressing table by hash; scores in thousandths; the bytes of every id for decoding."""

    longest: int
    keys: np.ndarray
    score: np.ndarray
    id: np.ndarray
    unknown: int
    byte: np.ndarray
    flat: np.ndarray
    flat_at: np.ndarray
    splits: bool  # no piece has a space behind another character

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        size = len(self.keys)
        slot = (h >> np.uint64(40)).astype(np.int64) & (size - 1)
        key = self.keys[slot]
        out = np.where(key == h, slot, -1)
        todo = np.flatnonzero((key != h) & (key != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (size - 1)
            key = self.keys[slot[todo]]
            hit = key == h[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (key != 0)]
        return out

    @cached_property
    def whole(self) -> np.ndarray:
        """Of each slot: whether the merges make this piece from its characters."""
        slots = np.flatnonzero(self.keys)
        names = [points(self.flat[a:b].tobytes().decode()) for a, b in zip(self.flat_at[self.id[slots]], self.flat_at[self.id[slots] + 1], strict=True)]
        size = np.array([len(name) for name in names])
        part = np.zeros((len(slots), self.longest), np.uint32)
        part[np.arange(self.longest)[None, :] < size[:, None]] = np.concatenate(names)
        out = np.zeros(len(self.keys), bool)
        for at in range(0, len(slots), _CELLS // LONG_WORD):
            some = slice(at, at + _CELLS // LONG_WORD)
            out[slots[some]] = np.bincount(merges(_Spans(self, part[some]), size[some])[0]) == 1
        return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=2)
def vocabulary(raw: bytes) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
    bytes_of, byte = [], np.zeros(256, np.int32)
    for i, name in enumerate(names):
        if model.is_byte(i):
            value = int(name[3:5], 16)
            byte[value] = i
            bytes_of.append(bytes([value]))
        else:
            bytes_of.append(b"" if special[i] else name.encode())
    normal = [i for i in range(n) if not special[i] and not model.is_byte(i)]
    size = 1 << (8 * len(normal) - 1).bit_length()
    keys, score, ids = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int32)
    for i in normal:
        v = mix(points(names[i]) + np.uint32(1))
        h = int(mix(np.array([(v * powers(len(v))[: len(v)]).sum(dtype=np.uint64)]))[0]) or 1
        slot = (h >> 40) & (size - 1)
        while keys[slot]:
            slot = (slot + 1) & (size - 1)
        keys[slot], score[slot], ids[slot] = h, round(model.get_score(i) * _SCALE), i
    unknown = round((min(model.get_score(i) for i in normal) - UNKNOWN_PENALTY) * _SCALE)
    at = np.concatenate(([0], np.cumsum([len(b) for b in bytes_of])))
    return Vocabulary(max(len(names[i]) for i in normal), keys, score, ids, unknown, byte, np.frombuffer(b"".join(bytes_of), np.uint8), at,
                      not any("▁" in names[i].lstrip("▁") for i in normal))


def longest_paths(v: Vocabulary, cp: np.ndarray, start: np.ndarray, sizes: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best scores at all places of the rows of ``cp``, the length of the last piece (0: the start), and what each (place, length) is.

    start: score to begin at a place, NONE if not. sizes: characters of a row. limit: pieces begin before it.
    """
    n, width = cp.shape
    values = mix(cp + np.uint32(1))
    h = np.zeros((n, width), np.uint64)
    slots = []
    power = powers(v.longest + 1)
    for length in range(1, min(v.longest, width) + 1):
        h = h[:, : width - length + 1] + values[:, length - 1:] * power[length - 1]
        found = mix(h)
        found[found == 0] = 1
        slot = v.find(found.ravel()).reshape(found.shape)
        place = np.arange(width - length + 1)
        slot[(place[None, :] + length > sizes[:, None]) | (place[None, :] >= limit[:, None])] = -1
        slots.append(slot)
    best, back = start.copy(), np.zeros((n, width + 1), np.int16)
    for end in range(1, width + 1):
        now, last = best[:, end].copy(), back[:, end]
        for length in range(min(len(slots), end), 0, -1):
            slot = slots[length - 1][:, end - length]
            gain = np.where(slot >= 0, v.score[slot], NONE)
            if length == 1:
                gain = np.where((slot < 0) & (end <= sizes) & (end - 1 < limit), v.unknown, gain)
            total = np.maximum(best[:, end - length] + gain, NONE)
            better = total > now
            now[better] = total[better]
            last[better] = length
        best[:, end] = now
    return best, back, np.stack([np.pad(s, ((0, 0), (0, width - s.shape[1])), constant_values=-1) for s in slots]) if slots else np.zeros((0, n, width), np.int64)


def trace(v: Vocabulary, cp: np.ndarray, back: np.ndarray, slots: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each row's best path up to ``end``, flat with bounds, and the place where the path began. Unknown characters become bytes."""
    n, width = cp.shape
    token = np.full((n, width), -1, np.int64)
    at = end.copy()
    rows = np.arange(n)
    while True:
        length = back[rows, at].astype(np.int64)
        live = np.flatnonzero((at > 0) & (length > 0))
        if not len(live):
            break
        begin = at[live] - length[live]
        slot = slots[length[live] - 1, live, begin]
        token[live, begin] = np.where(slot >= 0, v.id[slot], cp[live, begin].astype(np.int64) + (1 << 32))
        at[live] = begin
    row, place = np.nonzero(token >= 0)
    return *spelled(v, row, token[row, place], n), at


def spelled(v: Vocabulary, row: np.ndarray, flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of n rows, flat with bounds; an unknown character (its code + 2**32) becomes bytes."""
    unknown = np.flatnonzero(flat >> 32)
    size = np.ones(len(flat), np.int64)
    code = flat[unknown] & 0xFFFFFFFF
    size[unknown] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    bound = np.concatenate(([0], np.cumsum(np.bincount(row, size, n)))).astype(np.int64)
    out = np.repeat(flat, size)
    if len(unknown):
        spread = b"".join(chr(c).encode("utf-8", "surrogatepass") for c in code.tolist())
        out[np.repeat(flat >> 32 > 0, size)] = v.byte[np.frombuffer(spread, np.uint8)]
    return out.astype(np.int32), bound


def solve_words(v: Vocabulary, cp: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the words cp[cuts[i]:cuts[i+1]], flat with bounds, and each word's score. Equal words are solved once."""
    size = np.diff(cuts)
    if not len(size):
        return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)
    within = np.arange(cuts[-1] - cuts[0]) - np.repeat(cuts[:-1] - cuts[0], size)
    h = mix(np.add.reduceat(mix(cp[cuts[0]:cuts[-1]] + np.uint32(1)) * powers(int(size.max()))[within], cuts[:-1] - cuts[0]) + size.astype(np.uint64))
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    order = np.argsort(size[first], kind="stable")
    tokens, counts, score = [], np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and size[first[order[min(len(order), to + 255) - 1]]] * (to + 255 - at) <= _CELLS:
            to = min(len(order), to + 255)
        some = order[at:to]
        n, width = size[first[some]], int(size[first[some]].max())
        place = cuts[first[some]][:, None] + np.arange(width)[None, :]
        part = np.where(np.arange(width)[None, :] < n[:, None], cp[np.minimum(place, len(cp) - 1)], 0)
        start = np.full((len(some), width + 1), NONE)
        start[:, 0] = 0
        best, back, slots = longest_paths(v, part, start, n, n)
        flat, bound, _ = trace(v, part, back, slots, n.copy())
        tokens.append(flat)
        counts[some] = np.diff(bound)
        score[some] = best[np.arange(len(some)), n]
        at = to
    flat = np.concatenate(tokens)
    begin = np.zeros(len(first), np.int64)
    begin[order] = np.cumsum(counts[order]) - counts[order]
    many = counts[inverse]
    bound = np.concatenate(([0], np.cumsum(many)))
    return flat[np.arange(bound[-1]) - np.repeat(bound[:-1], many) + np.repeat(begin[inverse], many)], bound, score[inverse]


def word_cuts(v: Vocabulary, cp: np.ndarray) -> np.ndarray:
    """Places inside cp that no piece straddles."""
    return np.flatnonzero((cp[1:] == SPACE) & (cp[:-1] != SPACE)) + 1 if v.splits else np.zeros(0, np.int64)


def encode_texts(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of texts of one stretch each, flat with bounds. An empty text has none."""
    cp = points("".join(f"▁{t}" if t else "" for t in texts).replace(" ", "▁"))
    bound = np.concatenate(([0], np.cumsum([len(t) + 1 if t else 0 for t in texts]))).astype(np.int64)
    cuts = np.unique(np.concatenate((bound, word_cuts(v, cp))))
    flat, at, _ = solve_words(v, cp, cuts)
    return flat, at[np.searchsorted(cuts, bound)]


class _Spans:
    """Hashes of any spans of the rows of ``cp``, from sums up to each place."""

    def __init__(self, v: Vocabulary, cp: np.ndarray):
        width = cp.shape[1]
        self.v, self.sums = v, np.zeros((len(cp), width + 1), np.uint64)
        np.cumsum(mix(cp + np.uint32(1)) * powers(width + 1)[:width], axis=1, out=self.sums[:, 1:])
        self.back = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(width, _INVERSE))))

    def slots(self, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = mix((self.sums[row, b] - self.sums[row, a]) * self.back[a])
        h[h == 0] = 1
        return self.v.find(h)

    def score(self, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = self.slots(row, a, b)
        return np.where(slot >= 0, self.v.score[slot], NONE)


def merges(spans: _Spans, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of each piece of rows of n characters: the pair of the best score is merged first, of equal ones the left."""
    width = spans.sums.shape[1] - 1
    place = np.arange(width)
    alive = place[None, :] < n[:, None]
    end, before = np.repeat(place[None, :] + 1, len(n), axis=0), np.repeat(place[None, :] - 1, len(n), axis=0)
    gain = np.full((len(n), width), NONE)
    row, a = np.nonzero(place[None, :] + 1 < n[:, None])
    gain[row, a] = spans.score(row, a, a + 2)
    live = np.arange(len(n))
    while len(live):
        at = gain[live].argmax(axis=1)
        more = gain[live, at] > NONE
        live, at = live[more], at[more]
        middle = end[live, at]
        stop = end[live, middle]
        end[live, at], alive[live, middle], gain[live, middle], gain[live, at] = stop, False, NONE, NONE
        right = np.flatnonzero(stop < n[live])
        row, a, b = live[right], at[right], stop[right]
        before[row, b] = a
        gain[row, a] = spans.score(row, a, end[row, b])
        left = np.flatnonzero(at > 0)
        row = live[left]
        a = before[row, at[left]]
        gain[row, a] = spans.score(row, a, stop[left])
    row, a = np.nonzero(alive)
    return row, a, end[row, a]


def merges_of_long_word(v: Vocabulary, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each piece, as ``merges`` has them, from a heap of pairs."""
    spans, n = _Spans(v, word[None]), len(word)
    table = [spans.score(np.zeros(n - k + 1, np.int64), np.arange(n - k + 1), np.arange(k, n + 1)).tolist() for k in range(2, min(v.longest, n) + 1)]
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(a: int, b: int) -> None:
        if b - a <= v.longest and (score := table[b - a - 2][a]) > NONE:
            heapq.heappush(heap, (-score, a, b))

    for a in range(n - 1):
        push(a, a + 2)
    while heap:
        _, a, b = heapq.heappop(heap)
        middle = end[a]
        if not alive[a] or middle >= b or end[middle] != b:
            continue
        end[a], alive[middle] = b, False
        if b < n:
            before[b] = a
            push(a, end[b])
        if a:
            push(before[a], b)
    begin = np.flatnonzero(alive)
    return begin, np.array(end)[begin]


def merge_words(v: Vocabulary, cp: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model's tokens of the words cp[cuts[i]:cuts[i+1]], flat with bounds. Equal words are merged once."""
    size = np.diff(cuts)
    if not len(size):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    within = np.arange(cuts[-1] - cuts[0]) - np.repeat(cuts[:-1] - cuts[0], size)
    h = mix(np.add.reduceat(mix(cp[cuts[0]:cuts[-1]] + np.uint32(1)) * powers(int(size.max()))[within], cuts[:-1] - cuts[0]) + size.astype(np.uint64))
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    order = np.argsort(size[first], kind="stable")
    tokens, counts = [], np.zeros(len(first), np.int64)
    at = 0
    while at < len(order):
        to, width = at + 1, int(size[first[order[at]]])
        if width < LONG_WORD:
            to = at + int(np.searchsorted(size[first[order[at:at + _CELLS // LONG_WORD]]], width + 2, "right"))
        some = order[at:to]
        n, width = size[first[some]], int(size[first[some]].max())
        place = cuts[first[some]][:, None] + np.arange(width)[None, :]
        part = np.where(np.arange(width)[None, :] < n[:, None], cp[np.minimum(place, len(cp) - 1)], 0).astype(np.uint32)
        if width < LONG_WORD + 2:
            spans = _Spans(v, part)
            row, a, b = merges(spans, n)
            slot = spans.slots(row, a, b)
        else:
            a, b = merges_of_long_word(v, part[0])
            row = np.zeros(len(a), np.int64)
            slot = _Spans(v, part).slots(row, a, b)
        flat, bound = spelled(v, row, np.where(slot >= 0, v.id[slot].astype(np.int64), part[row, a].astype(np.int64) + (1 << 32)), len(some))
        tokens.append(flat)
        counts[some] = np.diff(bound)
        at = to
    flat = np.concatenate(tokens)
    begin = np.zeros(len(first), np.int64)
    begin[order] = np.cumsum(counts[order]) - counts[order]
    many = counts[inverse]
    bound = np.concatenate(([0], np.cumsum(many)))
    return flat[np.arange(bound[-1]) - np.repeat(bound[:-1], many) + np.repeat(begin[inverse], many)], bound


def merge_texts(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The model's tokens of texts that begin with ``▁`` and have no spaces, or are empty; flat with bounds."""
    cp = points("".join(texts))
    bound = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    cuts = np.unique(np.concatenate((bound, word_cuts(v, cp))))
    flat, at = merge_words(v, cp, cuts)
    return flat, at[np.searchsorted(cuts, bound)]


def marked(text: str | None) -> str:
    return f"▁{text}".replace(" ", "▁") if text else ""


def decode_texts(v: Vocabulary, flat: np.ndarray, bound: np.ndarray) -> list[str]:
    """The texts of token lists: bytes of all pieces, spaces restored, the one in front dropped."""
    size = np.diff(v.flat_at)[flat]
    ends = np.concatenate(([0], np.cumsum(size)))
    data = v.flat[np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(v.flat_at[flat], size)].tobytes()
    return [data[a:b].decode("utf-8", "replace").replace("▁", " ")[1:] for a, b in zip(ends[bound[:-1]].tolist(), ends[bound[1:]].tolist(), strict=True)]


@dataclass
class Stretch:
    """One chunk: its characters with the ones that a straddling piece may take from the next, and the places where paths meet."""

    cp: np.ndarray
    size: int
    cuts: np.ndarray

    @staticmethod
    def of(v: Vocabulary, text: str, size: int) -> Stretch:
        cp = points(text)
        cuts = word_cuts(v, cp)
        return Stretch(cp, size, cuts[cuts < size])


def _run(v: Vocabulary, s: Stretch, a: int, b: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longest paths over cp[a:b] from several starts; pieces begin inside the chunk."""
    n = len(start)
    cp = np.repeat(s.cp[None, a:b], n, axis=0)
    full = np.full((n, b - a + 1), NONE)
    w = min(start.shape[1], full.shape[1])
    full[:, :w] = start[:, :w]
    return cp, *longest_paths(v, cp, full, np.full(n, b - a), np.full(n, s.size - a))


def _exits(v: Vocabulary, best: np.ndarray, at: int) -> np.ndarray:
    out = np.full((len(best), v.longest), NONE)
    tail = best[:, at:at + v.longest]
    out[:, : tail.shape[1]] = tail
    return out


def transfer(v: Vocabulary, s: Stretch) -> np.ndarray:
    """Max-plus matrix from the place of the first boundary in the chunk to that of the first one behind it."""
    every = np.where(np.eye(v.longest, dtype=bool), 0, NONE)
    if not len(s.cuts):
        _, best, _, _ = _run(v, s, 0, len(s.cp), every)
        return _exits(v, best, s.size)
    first, last = int(s.cuts[0]), int(s.cuts[-1])
    _, head, _, _ = _run(v, s, 0, first, every)
    _, tail, _, _ = _run(v, s, last, len(s.cp), every[:1])
    middle = int(solve_words(v, s.cp, s.cuts)[2].sum())
    return np.maximum(head[:, first][:, None] + middle + _exits(v, tail, s.size - last), NONE)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NONE)


def paths(v: Vocabulary, s: Stretch, into: np.ndarray, exits: list[int]) -> list[tuple[int, int, np.ndarray]]:
    """For each exit state: the entry state and the tokens of the best path, given the scores to enter."""
    if not len(s.cuts):
        cp, _, back, slots = _run(v, s, 0, len(s.cp), into[None])
        found = [trace(v, cp, back, slots, np.array([s.size + j])) for j in exits]
        return [(j, int(at[0]), flat) for j, (flat, _, at) in zip(exits, found, strict=True)]
    first, last = int(s.cuts[0]), int(s.cuts[-1])
    cp, _, back, slots = _run(v, s, 0, first, into[None])
    head, _, entry = trace(v, cp, back, slots, np.array([first]))
    middle = solve_words(v, s.cp, s.cuts)[0]
    cp, _, back, slots = _run(v, s, last, len(s.cp), np.zeros((1, 1), np.int64))
    return [(j, int(entry[0]), np.concatenate((head, middle, trace(v, cp, back, slots, np.array([s.size - last + j]))[0]))) for j in exits]


def _split(chunk: int, over: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            whole = f"▁{text}".replace(" ", "▁")
            many = -(-len(whole) // chunk)
            for a in range(0, many, 16):
                ks = list(range(a, min(many, a + 16)))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(ks), pa.int64()), pa.array(ks, pa.int32()), pa.array([many] * len(ks), pa.int32()),
                                                  pa.array([min(chunk, len(whole) - k * chunk) for k in ks], pa.int32()), pa.array([whole[k * chunk:(k + 1) * chunk + over] for k in ks], pa.string())],
                                                 names=["row", "k", "many", "size", "part"])


def _matrices(raw: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = vocabulary(raw)
    for batch in batches:
        out = [transfer(v, Stretch.of(v, t, n)).tobytes() for t, n in zip(batch.column("part").to_pylist(), batch.column("size").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(out, pa.binary())], names=["row", "k", "matrix"])


def _combine(longest: int):
    def of_row(frame):
        """Scores to enter each chunk from the left, and the exit states that lie on a best path."""
        import pandas as pd

        frame = frame.sort_values("k")
        chain = [np.frombuffer(m, np.int64).reshape(longest, longest) for m in frame["matrix"]]
        origin = np.full((1, longest), NONE)
        origin[0, 0] = 0
        left, right = [origin], [origin.T]
        for m in chain:
            left.append(times(left[-1], m))
        for m in reversed(chain):
            right.append(times(m, right[-1]))
        right.reverse()
        total = left[-1][0, 0]
        exits = [np.flatnonzero(a[0] + b[:, 0] == total).tolist() for a, b in zip(left[1:], right[1:], strict=True)]
        exits[-1] = [0]
        return pd.DataFrame({"row": frame["row"].to_numpy(), "k": frame["k"].to_numpy(), "entering": [a[0].tobytes() for a in left[:-1]], "exits": exits})
    return of_row


def _traced(raw: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = vocabulary(raw)
    for batch in batches:
        for row, k, part, size, entering, exits in zip(*(batch.column(c).to_pylist() for c in ("row", "k", "part", "size", "entering", "exits")), strict=True):
            found = paths(v, Stretch.of(v, part, size), np.frombuffer(entering, np.int64), exits)
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array([k] * len(found), pa.int32()), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()),
                                              pa.array([f[2] for f in found], pa.list_(pa.int32()))], names=["row", "k", "leave", "enter", "ids"])


def _chained(frame):
    """The path from the end of a document to its start through its chunks' states."""
    import pandas as pd

    of = {(k, leave): (enter, ids) for k, leave, enter, ids in zip(frame["k"], frame["leave"], frame["enter"], frame["ids"], strict=True)}
    state, parts = 0, []
    for k in range(int(frame["k"].max()), -1, -1):
        state, ids = of[k, state]
        parts.append(ids)
    return pd.DataFrame({"row": [frame["row"].iloc[0]], "ids": [np.concatenate(parts[::-1])]})


def _encoded(raw: bytes, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = vocabulary(raw)
    for batch in row_pieces(batches, "text"):
        flat, bound = encode_texts(v, batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(flat, pa.int32()))], names=[*keep, "ids"])


def encode(docs: DataFrame, keep: list[str], model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """Columns ``keep`` of every document and its token ids.

    Null or empty text: no tokens. Repeated rows are encoded alike. A text of any length is encoded whole. ``keep`` may not hold ``ids``;
    other columns are left out. A ``▁`` in a text stands for a space, as in the library. No documents: no rows.
    """
    spark = docs.sparkSession
    raw = ship(spark, model)
    longest = vocabulary(raw).longest
    shared = spark.sparkContext.broadcast(raw)  # of a size that ship() has checked
    clean = docs.withColumn("text", F.coalesce("text", F.lit("")))
    kept = clean.select(*keep) if keep else clean.select()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    short = clean.where(F.length("text") < chunk).select(*dict.fromkeys([*keep, "text"]))
    done = short.mapInArrow(lambda batches: _encoded(shared.value, keep, batches), f"{kinds}{', ' if kinds else ''}ids array<int>")
    # Rows get a number where the long ones are stored, so that repeated rows stay apart.
    long = stored(clean.where(F.length("text") >= chunk).withColumn("__row", F.monotonically_increasing_id()).select(F.struct(*keep).alias("kept") if keep else F.lit(1).alias("kept"), "text", F.col("__row").alias("row")), "long")
    parts = stored(long.select("row", "text").mapInArrow(lambda batches: _split(chunk, longest - 1, batches), "row long, k int, many int, size int, part string").repartition("row", "k"), "parts")
    matrices = parts.mapInArrow(lambda batches: _matrices(shared.value, batches), "row long, k int, matrix binary")
    entering = matrices.groupBy("row").applyInPandas(_combine(longest), "row long, k int, entering binary, exits array<int>")
    traced = parts.join(entering, ["row", "k"]).select("row", "k", "part", "size", "entering", "exits").mapInArrow(
        lambda batches: _traced(shared.value, batches), "row long, k int, leave int, enter int, ids array<int>")
    whole = traced.groupBy("row").applyInPandas(_chained, "row long, ids array<int>")
    return done.union(long.select("row", "kept").join(whole, "row").select(*([f"kept.`{c}`" for c in keep]), "ids"))


def _merged(raw: bytes, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = vocabulary(raw)
    for batch in row_pieces(batches, "text"):
        flat, bound = merge_texts(v, [marked(t) for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(flat, pa.int32()))], names=[*keep, "ids"])


def compatible(v: Vocabulary, cp: np.ndarray, at: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Whether the merges of the ``before`` and ``behind`` characters around each place, alone, end in these two pieces."""
    out = np.zeros(len(at), bool)
    n = before + behind
    order = np.argsort(n, kind="stable")
    for some in np.split(order, np.arange(_CELLS // LONG_WORD, len(order), _CELLS // LONG_WORD)) if len(order) else []:
        place = np.arange(int(n[some].max()))[None, :]
        part = np.where(place < n[some][:, None], cp[np.minimum((at - before)[some][:, None] + place, len(cp) - 1)], 0).astype(np.uint32)
        row, begin, _ = merges(_Spans(v, part), n[some])
        out[some] = (np.bincount(row) == 2) & (np.bincount(row, begin) == before[some])
    return out


def steps(v: Vocabulary, cp: np.ndarray, limit: int) -> np.ndarray:
    """[s, p, l]: whether a piece of l characters may follow one of p at place s; p = longest + 1: nothing is before it. Pieces begin before ``limit``."""
    n, top = len(cp), v.longest
    spans, zero = _Spans(v, cp[None]), np.zeros(n + 1, np.int64)
    kind, before = np.full((n + 1, top + 1), -1), np.full((n + 1, top + 1), -1)
    for size in range(1, min(n, top) + 1):
        a = np.arange(n - size + 1)
        slot = spans.slots(zero[a], a, a + size)
        now = np.where((slot >= 0) & v.whole[slot], slot, -1)
        if size == 1:
            now = np.where(now < 0, len(v.keys) + cp.astype(np.int64), now)
        kind[a, size] = before[a + size, size] = now
    kind[max(0, limit):] = -1
    s, p, l = np.nonzero((before[:, :, None] >= 0) & (kind[:, None, :] >= 0))
    _, first, inverse = np.unique(before[s, p] * (len(v.keys) + 0x110000) + kind[s, l], return_index=True, return_inverse=True)
    out = np.zeros((n + 1, top + 2, top + 1), bool)
    out[s, p, l] = compatible(v, cp, s[first], p[first], l[first])[inverse]
    out[:, top + 1, :] = kind >= 0
    return out


def walk(v: Vocabulary, cp: np.ndarray, starts: list[tuple[int, int]], limit: int) -> np.ndarray:
    """[i, e]: characters of the last piece of the one path from start i to place e, 0 if there is none. A start: the place, and the length of the piece that ends there."""
    allowed = steps(v, cp, limit)
    some = allowed.any(axis=1)
    last = np.zeros((len(starts), len(cp) + 1), np.int64)
    for i, (place, size) in enumerate(starts):
        last[i, place] = size
    sizes = np.arange(1, v.longest + 1)
    for end in range(min(place for place, _ in starts) + 1, len(cp) + 1):
        size = sizes[:end]
        size = size[some[end - size, size]]
        if len(size):
            into = (allowed[end - size, last[:, end - size], size] * size).max(axis=1)
            last[:, end] = np.where(into > 0, into, last[:, end])
    return last


def states(v: Vocabulary, cp: np.ndarray, cut: int) -> np.ndarray:
    """Pieces that begin before a cut and end at or behind it: characters before it << 16 | characters behind it. At the start of a text: 0."""
    if not cut:
        return np.zeros(1, np.int64)
    d, f = np.meshgrid(np.arange(1, min(v.longest, cut) + 1), np.arange(0, min(v.longest - 1, len(cp) - cut) + 1), indexing="ij")
    d, f = d[d + f <= v.longest], f[d + f <= v.longest]
    slot = _Spans(v, cp[None]).slots(np.zeros(len(d), np.int64), cut - d, cut + f)
    valid = ((slot >= 0) & v.whole[slot]) | (d + f == 1)
    return d[valid] << 16 | f[valid]


@dataclass
class Part:
    """One chunk of a text to be merged: ``left`` characters in front of it, ``size`` of its own, and what a piece may take from the next."""

    cp: np.ndarray
    left: int
    size: int
    cuts: np.ndarray

    @staticmethod
    def of(v: Vocabulary, text: str, left: int, size: int) -> Part:
        cp = points(text)
        cuts = word_cuts(v, cp)
        return Part(cp, left, size, cuts[(cuts >= left) & (cuts < left + size)])

    @property
    def end(self) -> int:
        return self.left + self.size

    def start(self, v: Vocabulary, state: int) -> tuple[int, int]:
        return (self.left + (state & 0xFFFF), (state >> 16) + (state & 0xFFFF)) if state else (0, v.longest + 1)


def transfer_merges(v: Vocabulary, s: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States at the chunk's two cuts and the max-plus matrix between them: 0 where a path of allowed steps leads from one to the other."""
    into, out = states(v, s.cp, s.left), states(v, s.cp[: s.end + v.longest - 1], s.end)
    ahead, size = out & 0xFFFF, (out >> 16) + (out & 0xFFFF)
    starts = [s.start(v, x) for x in into.tolist()]
    if not len(s.cuts):
        linked = walk(v, s.cp, starts, s.end)[:, s.end + ahead] == size
    else:
        first, last = int(s.cuts[0]), int(s.cuts[-1])
        head = walk(v, s.cp[:first], starts, first)[:, first] > 0
        tail = walk(v, s.cp[last:], [(0, v.longest + 1)], s.end - last)[0]
        linked = head[:, None] & (tail[s.end - last + ahead] == size)[None, :]
    return into, out, np.where(linked, 0, NONE)


def _back(last: np.ndarray, start: int, end: int) -> list[tuple[int, int]]:
    found = []
    while end > start:
        found.append((end - int(last[end]), end))
        end = found[-1][0]
    return found[::-1]


def _ids(v: Vocabulary, cp: np.ndarray, found: list[tuple[int, int]]) -> np.ndarray:
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    zero = np.zeros(len(a), np.int64)
    slot = _Spans(v, cp[None]).slots(zero, a, b)
    return spelled(v, zero, np.where(slot >= 0, v.id[slot].astype(np.int64), cp[a].astype(np.int64) + (1 << 32)), 1)[0]


def trace_merges(v: Vocabulary, s: Part, enter: int, leave: int) -> np.ndarray:
    """Ids of the pieces behind the entering one, up to the leaving one."""
    start = s.start(v, enter)
    behind = leave & 0xFFFF
    if not len(s.cuts):
        return _ids(v, s.cp, _back(walk(v, s.cp, [start], s.end)[0], start[0], s.end + behind))
    first, last = int(s.cuts[0]), int(s.cuts[-1])
    head = _back(walk(v, s.cp[:first], [start], first)[0], start[0], first)
    tail = _back(walk(v, s.cp[last:], [(0, v.longest + 1)], s.end - last)[0], 0, s.end - last + behind)
    return np.concatenate((_ids(v, s.cp, head), merge_words(v, s.cp, s.cuts)[0], _ids(v, s.cp[last:], tail)))


def _parts(chunk: int, longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            whole = marked(text)
            many = -(-len(whole) // chunk)
            for k in range(many):
                a, b = k * chunk, min((k + 1) * chunk, len(whole))
                left = min(a, longest)
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), *(pa.array([x], pa.int32()) for x in (k, many, left, b - a)), pa.array([whole[a - left:b + longest - 1]])],
                                                 names=["row", "k", "many", "left", "size", "part"])


_MATRIX = "row long, k int, into array<int>, out array<int>, cells binary"


def _merge_matrices(raw: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = vocabulary(raw)
    for batch in batches:
        made = [transfer_merges(v, Part.of(v, *x)) for x in zip(*(batch.column(c).to_pylist() for c in ("part", "left", "size")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), *(pa.array([m[i] for m in made], pa.list_(pa.int32())) for i in (0, 1)),
                                          pa.array([m[2].tobytes() for m in made], pa.binary())], names=["row", "k", "into", "out", "cells"])


def _chain(frame) -> list[np.ndarray]:
    return [np.frombuffer(c, np.int64).reshape(len(a), len(b)) for a, b, c in zip(frame["into"], frame["out"], frame["cells"], strict=True)]


def _product(key, frame):
    """Adjacent chunks as one, of number key[1]: the product of their matrices."""
    import pandas as pd

    frame = frame.sort_values("k")
    made, *more = _chain(frame)
    for m in more:
        made = times(made, m)
    return pd.DataFrame({"row": [frame["row"].iloc[0]], "k": [key[1]], "into": [frame["into"].iloc[0]], "out": [frame["out"].iloc[-1]], "cells": [made.tobytes()]})


def _handed_down(frame):
    """Entering and leaving state of each of adjacent chunks, from those of the whole: the one state at each cut that a path comes to and leads on from."""
    import pandas as pd

    frame = frame.sort_values("k")
    chain = _chain(frame)
    right = [np.where(np.asarray(frame["out"].iloc[-1]) == frame["leave"].iloc[0], 0, NONE)[:, None]]
    for m in reversed(chain):
        right.append(times(m, right[-1]))
    right.reverse()
    left = np.where(np.asarray(frame["into"].iloc[0]) == frame["enter"].iloc[0], 0, NONE)[None, :]
    at = [int(frame["enter"].iloc[0])]
    for m, out, after in zip(chain, frame["out"], right[1:], strict=True):
        left = times(left, m)
        at.append(int(out[int((left[0] + after[:, 0]).argmax())]))
    return pd.DataFrame({"row": frame["row"].to_numpy(), "k": frame["k"].to_numpy(), "enter": at[:-1], "leave": at[1:]})


def _scanned(matrices: DataFrame, many: int) -> DataFrame:
    """(row, k, enter, leave): the states at the cuts of each chunk, by products up a tree of FAN matrices to a node and states handed down."""
    levels = [matrices]
    while many > 1:
        levels.append(stored(levels[-1].groupBy("row", F.expr(f"cast(k div {FAN} as int)")).applyInPandas(_product, _MATRIX), "products"))
        many = -(-many // FAN)
    # A whole text begins at state 0; of the pieces that end it, one is reached.
    reached = F.udf(lambda out, cells: out[int(np.frombuffer(cells, np.int64).argmax())], "int")
    known = levels[-1].select("row", "k", F.lit(0).alias("enter"), reached("out", "cells").alias("leave"))
    for level in reversed(levels[:-1]):
        above = known.select("row", F.col("k").alias("above"), "enter", "leave")
        known = stored(level.withColumn("above", F.expr(f"cast(k div {FAN} as int)")).join(above, ["row", "above"]).groupBy("row", "above").applyInPandas(_handed_down, "row long, k int, enter int, leave int"), "states")
    return known


def _merged_parts(raw: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = vocabulary(raw)
    for batch in batches:
        for row, k, *part, enter, leave in zip(*(batch.column(c).to_pylist() for c in ("row", "k", "part", "left", "size", "enter", "leave")), strict=True):
            ids = trace_merges(v, Part.of(v, *part), enter, leave)
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([ids], pa.list_(pa.int32()))], names=["row", "k", "ids"])


def _in_order(frame):
    import pandas as pd

    return pd.DataFrame({"row": [frame["row"].iloc[0]], "ids": [np.concatenate(frame.sort_values("k")["ids"].tolist())]})


def encode_merges(docs: DataFrame, keep: list[str], model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """Columns ``keep`` of every document and the ids that the library gives it with this model of merges. Otherwise as ``encode``."""
    spark = docs.sparkSession
    raw = ship(spark, model)
    longest = vocabulary(raw).longest
    if not vocabulary(raw).splits:
        raise ValueError("a piece has a space behind another character")
    shared = spark.sparkContext.broadcast(raw)  # of a size that ship() has checked
    clean = docs.withColumn("text", F.coalesce("text", F.lit("")))
    kept = clean.select(*keep) if keep else clean.select()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    short = clean.where(F.length("text") < chunk).select(*dict.fromkeys([*keep, "text"]))
    done = short.mapInArrow(lambda batches: _merged(shared.value, keep, batches), f"{kinds}{', ' if kinds else ''}ids array<int>")
    # Rows get a number where the long ones are stored, so that repeated rows stay apart.
    others = [c for c in keep if c != "text"]
    long = stored(clean.where(F.length("text") >= chunk).select(*others, "text").withColumn("__row", F.monotonically_increasing_id()), "long")
    parts = stored(long.select(F.col("__row").alias("row"), "text").mapInArrow(lambda batches: _parts(chunk, longest, batches), "row long, k int, many int, left int, size int, part string").repartition("row", "k"), "parts")
    many = parts.agg(F.max("many").alias("many")).first()["many"]
    if many is None:
        return done
    matrices = stored(parts.mapInArrow(lambda batches: _merge_matrices(shared.value, batches), _MATRIX), "matrices")
    traced = parts.join(_scanned(matrices, many), ["row", "k"]).select("row", "k", "part", "left", "size", "enter", "leave").mapInArrow(
        lambda batches: _merged_parts(shared.value, batches), "row long, k int, ids array<int>")
    whole = traced.groupBy("row").applyInPandas(_in_order, "row long, ids array<int>")
    return done.union(long.join(whole, F.col("__row") == F.col("row")).select(*keep, "ids"))


def _digested(raw: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = vocabulary(raw)
    is_byte = np.zeros(len(v.flat_at) - 1, bool)
    is_byte[v.byte] = True
    for batch in row_pieces(batches, "text"):
        column = batch.column("ids")
        bound, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
        flat, bound = flat[bound[0]:bound[-1]], bound - bound[0]
        texts = decode_texts(v, flat, bound)
        n_bytes = np.concatenate(([0], np.cumsum(is_byte[flat])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bound)), pa.array(n_bytes[bound[1:]] - n_bytes[bound[:-1]]),
                                          pa.array([hashlib.sha256(flat[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]),
                                          pa.array([d == (t or "").replace("▁", " ") for d, t in zip(texts, batch.column("text").to_pylist(), strict=True)])],
                                         names=["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "restored"])


def token_digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Of every document: the numbers of tokens and of byte tokens, a digest of the ids, and whether they decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(ship(docs.sparkSession, model))
    return encode_merges(docs.select("doc_id", "text"), ["doc_id", "text"], model).mapInArrow(
        lambda batches: _digested(shared.value, batches), "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, restored boolean")

"""Language-model scoring with sharded Elias-Fano n-gram tries over all words.

Tokens are lower-cased (A-Z) words and one end per text. Every word, pair and triple of
the training texts is counted, whatever its words' frequency; nothing is pruned:

1. texts become batches of token hashes, written once to the shared folder; a longer text
   is cut into pieces that repeat the two tokens before them, and its scores are added up;
2. each batch sends, by the hash of the context, an Elias-Fano trie of its pairs and of
   the triples below them to ``shards``, whose number grows with the corpus; a shard merges
   these to one trie (``ShardTrie``: Elias-Fano levels of pairs and triples, Elias-Fano
   pointers between them, counts quantised without loss), maps it from a file, and answers
   what the batch asks for by search in its levels. This runs in ``ROUNDS`` rounds over
   disjoint shards, which bounds the disk that is held at once;
3. words meet their counts and numbers of distinct successors in tries of one level;
4. each batch meets its answers and is scored, in ``ROUNDS`` rounds as well.

A pair is keyed by a 62-bit hash; a triple by the place of its first two words among the
pairs of its shard and a 40-bit hash of its third word (context-relative). Probabilities
are interpolated absolute discounting with exact counts: ``P(w|h) = max(c(hw) - D, 0) /
c(h) + D T(h) / c(h) P(w|h')`` where ``T(h)`` is the number of distinct successors, so every
context sums to 1; an unseen context leaves ``P(w|h')``; the lowest order is add-one over
all words, which is the base. Discounts are known once all shards are, so shards keep
counts and batches smooth them. ``Trie`` is the form for one machine, with quantised terms.

Defined results: null texts are empty and consist of their end; an empty training set
gives N = 0, V = 0 and base log10(1 / 1) = 0 per token; rows of one id are scored one by
one, and equal texts alike; rows with a null id are training rows; ids that are no numbers
count as null; columns beyond id, text and ``held`` are not read; empty tables give empty
results.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import WIDE_ROWS, held_out, materialise, small_arrow_batches
from .wordcols import Words, keep_freed_memory_low, lean, mix, release, slices, text_buffer

END = np.uint64(0x5BD1E9955BD1E995)
#: Tokens of a batch (whole texts, or a piece of a longer one) and of a shard, about.
BATCH, SHARD = 500_000, 600_000
#: A power of two. Words have fewer shards than pairs, for a shard of pairs sends counts to all of them.
ROUNDS, PAIRS_A_WORD = 8, 4
_QUANTA = 255
#: Freed bytes that a Python worker keeps within a partition or group.
ROOM = 32 << 20


# --- Elias-Fano --------------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits, one after another, in 64-bit words (one spare word)."""
    out = np.zeros(len(values) * width // 64 + 2, dtype=np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, values << shift)
        over = np.flatnonzero(shift.astype(np.int64) + width > 64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def _unpack(words: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), dtype=np.uint64)
    at = index.astype(np.int64) * width
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with sampled ranks for select."""

    SAMPLE = 64
    #: Values that are searched at once, and number of searches from which bucket ends are decoded first.
    CHUNK, MANY = 1 << 16, 1 << 10

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones, self.zeros = n, width, low, high, ones, zeros
        self._ends: np.ndarray | None = None
        self._edge: int | None = None

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        width, low, high, place = cls.code(values, universe)
        zeros = np.flatnonzero(np.unpackbits(high.view(np.uint8), bitorder="little")[:-64] == 0)[:: cls.SAMPLE]
        return cls(len(values), width, low, high, place[:: cls.SAMPLE].astype(np.int64), zeros.astype(np.int64))

    @classmethod
    def code(cls, values: np.ndarray, universe: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Width of the low bits, low bits, high bits, and the positions of the one bits in these."""
        n = len(values)
        width = max(0, int(np.floor(np.log2(max(1, universe) / max(1, n))))) if n else 0
        values = values.astype(np.uint64)
        top = (values >> np.uint64(width)).astype(np.int64)
        buckets = (int(universe) >> width) + 1
        size = n + buckets + 1
        bits = np.zeros(-(-size // 64) * 64 + 64, dtype=np.uint8)
        place = top + np.arange(n)
        bits[place] = 1
        bits[size:-64] = 1
        return width, _pack(values & np.uint64((1 << width) - 1), width), np.packbits(bits, bitorder="little").view(np.uint64), place

    def _select(self, rank: np.ndarray, one: bool) -> np.ndarray:
        """Bit positions of the one or zero bits of these ranks."""
        sample = self.ones if one else self.zeros
        flip = np.uint64(0) if one else ~np.uint64(0)
        position = sample[rank // self.SAMPLE]
        left = (rank % self.SAMPLE).astype(np.int64)
        word = position >> 6
        bits = (self.high[word] ^ flip) & (~np.uint64(0) << (position & 63).astype(np.uint64))
        count = np.bitwise_count(bits).astype(np.int64)
        todo = np.flatnonzero(left >= count)
        while len(todo):
            left[todo] -= count[todo]
            word[todo] += 1
            bits[todo] = self.high[word[todo]] ^ flip
            count[todo] = np.bitwise_count(bits[todo])
            todo = todo[left[todo] >= count[todo]]
        base = np.zeros(len(rank), dtype=np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= below
            left -= np.where(up, below, 0)
            base += np.where(up, half, 0)
            bits = np.where(up, bits >> np.uint64(half), bits)
        return word * 64 + base

    def get(self, index: np.ndarray) -> np.ndarray:
        if not len(index):
            return np.zeros(0, dtype=np.int64)
        top = self._select(index, True) - index
        return ((top.astype(np.uint64) << np.uint64(self.width)) | _unpack(self.low, index, self.width)).astype(np.int64)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Index of each value by successor search, or -1 where it is absent."""
        if not self.n or not len(value):
            return np.full(len(value), -1, dtype=np.int64)
        if self._ends is None and len(value) >= self.MANY:
            self._ends = self._bucket_ends()
        if len(value) > self.CHUNK:
            return np.concatenate([self.find(value[at : at + self.CHUNK]) for at in range(0, len(value), self.CHUNK)])
        out = np.full(len(value), -1, dtype=np.int64)
        if self._edge is None:  # the last bucket, which is empty: values beyond the universe have no zero bit of their own
            self._edge = 64 * (len(self.high) - 1) - int(np.bitwise_count(self.high[:-1]).sum()) - 1
        top = np.minimum((value.astype(np.uint64) >> np.uint64(self.width)).astype(np.int64), self._edge)
        low = value.astype(np.uint64) & np.uint64((1 << self.width) - 1)
        if self._ends is None:
            first = np.where(top > 0, self._select(np.maximum(top - 1, 0), False) + 1, 0) - top
            last = self._select(top, False) - top
        else:
            first = self._ends[np.minimum(top, len(self._ends) - 1)].astype(np.int64)
            last = self._ends[np.minimum(top + 1, len(self._ends) - 1)].astype(np.int64)
        lo, hi = first.copy(), last.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = _unpack(self.low, mid, self.width) < low[active]
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
            active = active[lo[active] < hi[active]]
        inside = np.flatnonzero(lo < last)
        hit = inside[_unpack(self.low, lo[inside], self.width) == low[inside]]
        out[hit] = lo[hit]
        return out

    def _bucket_ends(self) -> np.ndarray:
        """Where the values below each high part end: what selecting every zero bit gives, 0 before the first."""
        zeros = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little") == 0)
        zeros -= np.arange(len(zeros))
        return np.concatenate([[0], np.minimum(zeros, self.n)]).astype(np.int32 if self.n < 1 << 31 else np.int64)

    def values(self) -> np.ndarray:
        """The whole sequence."""
        bits = np.unpackbits(self.high.view(np.uint8), bitorder="little")
        index = np.arange(self.n)
        top = np.flatnonzero(bits)[: self.n] - index
        return ((top.astype(np.uint64) << np.uint64(self.width)) | _unpack(self.low, index, self.width)).astype(np.int64)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], dtype=np.int64), self.low, self.high, self.ones, self.zeros]

    @classmethod
    def load(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:5])


def quantise(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes on an even log10 scale, and the scale (lowest, step)."""
    low, high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
    step = max(1e-12, (high - low) / _QUANTA)
    return np.rint((logs - low) / step).astype(np.uint8), np.array([low, step])


# --- the trie ----------------------------------------------------------------------

_DTYPES = {"u8": np.uint64, "i8": np.int64, "f8": np.float64, "u1": np.uint8, "u2": np.uint16, "u4": np.uint32}


def _file_of(arrays: list[np.ndarray]) -> bytes:
    head, body, at = [], [], 0
    for a in arrays:
        code = next(k for k, t in _DTYPES.items() if t == a.dtype)
        raw = np.ascontiguousarray(a).tobytes()
        raw += b"\0" * (-len(raw) % 8)
        head.append(f"{code}:{len(a)}:{at}")
        body.append(raw)
        at += len(raw)
    text = ",".join(head).encode()
    return len(text).to_bytes(8, "little") + text + b"\0" * (-len(text) % 8) + b"".join(body)


def _mapped(raw: bytes) -> list[np.ndarray]:
    """The arrays of ``_file_of``, mapped from an unlinked temporary file, so that their pages can be dropped and re-read."""
    with tempfile.TemporaryFile() as f:
        f.write(raw)
        f.flush()
        view = np.asarray(np.memmap(f, dtype=np.uint8, mode="r"))
    size = int.from_bytes(view[:8].tobytes(), "little")
    base = 8 + size + (-size % 8)
    arrays = []
    for item in view[8 : 8 + size].tobytes().decode().split(","):
        code, n, at = item.split(":")
        kind = np.dtype(_DTYPES[code])
        arrays.append(view[base + int(at) : base + int(at) + int(n) * kind.itemsize].view(kind))
    return arrays


class ShardTrie:
    """Levels of a shard: Elias-Fano sequences, and columns of counts quantised without loss.

    A count is a code of one byte (more where a shard has more than 256 distinct counts) into
    the column's table of its distinct counts. Everything is searched where it is mapped.
    """

    def __init__(self, arrays: list[np.ndarray]):
        n = int(arrays[0][0])
        self.levels = [EliasFano.load(arrays[1 + 5 * i : 6 + 5 * i]) for i in range(n)]
        self.tables, self.codes = arrays[1 + 5 * n :: 2], arrays[2 + 5 * n :: 2]

    @classmethod
    def of(cls, levels: list[EliasFano], columns: list[np.ndarray]) -> ShardTrie:
        arrays = [np.array([len(levels)], dtype=np.int64), *(a for x in levels for a in x.parts())]
        for counts in columns:
            if len(counts) and int(counts.max()) < 1 << 20:
                seen = np.zeros(int(counts.max()) + 1, dtype=bool)
                seen[counts] = True
                table, code = np.flatnonzero(seen), (np.cumsum(seen) - 1)[counts]
            else:
                table, code = np.unique(counts, return_inverse=True)
            arrays += [table.astype(np.int64), code.astype(np.uint8 if len(table) <= 1 << 8 else np.uint16 if len(table) <= 1 << 16 else np.uint32)]
        return cls(_mapped(_file_of(arrays)))

    @classmethod
    def of_words(cls, keys: np.ndarray, counts: np.ndarray, successors: np.ndarray) -> ShardTrie:
        """One level: words with their counts and numbers of distinct successors, added up over all occurrences."""
        words, total, _ = _added(keys, counts)
        level = _level(words)
        after = np.flatnonzero(successors)
        return cls.of([level], [total, np.bincount(level.find(keys[after]), successors[after], minlength=len(words)).astype(np.int64)])

    @classmethod
    def of_pairs(cls, keys: np.ndarray, counts: np.ndarray, lead: np.ndarray, last: np.ndarray, times: np.ndarray) -> tuple[ShardTrie, np.ndarray, np.ndarray]:
        """Pairs, pointers from each to its triples, and triples; ``lead`` is the occurrence in ``keys`` of a triple's pair.

        Also gives the place that the search finds for each of ``keys`` (-1: absent), and an occurrence of each pair of the trie.
        """
        pairs, total, where = _added(keys, counts)
        level = _level(pairs)
        place, some = level.find(keys), np.flatnonzero(times)
        triples, below, _ = _added((place[lead[some]] << _LAST) | last[some], times[some])
        begins = np.searchsorted(triples, np.arange(len(pairs) + 1) << _LAST)
        return cls.of([level, EliasFano.of(begins, len(triples)), _level(triples)], [total, below]), place, where

    def column(self, which: int, place: np.ndarray) -> np.ndarray:
        """Counts at these places of a level, 0 at -1."""
        out = np.zeros(len(place), dtype=np.int64)
        hit = np.flatnonzero(place >= 0)
        out[hit] = self.tables[which][self.codes[which][place[hit]]]
        return out

    def triples_at(self, place: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Place of each triple by that of its pair, -1 where either is absent."""
        out = np.full(len(place), -1, dtype=np.int64)
        hit = np.flatnonzero(place >= 0)
        out[hit] = self.levels[2].find((place[hit] << _LAST) | last[hit])
        return out

    def successors(self, place: np.ndarray) -> np.ndarray:
        """Distinct successors of pairs, by their pointers."""
        return np.append(np.diff(self.levels[1].values()), 0)[place]


def _level(keys: np.ndarray) -> EliasFano:
    return EliasFano.of(keys, int(keys[-1]) + 1 if len(keys) else 1)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys that have a count, ascending, with their counts added up and an occurrence of each."""
    some = np.flatnonzero(counts)
    some = some[np.argsort(keys[some])]
    found = keys[some]
    begin = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
    return found[begin], np.add.reduceat(counts[some], begin) if len(begin) else np.zeros(0, dtype=np.int64), some[begin]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, an occurrence of each, and the place of every key among them."""
    order = np.argsort(keys)
    found = keys[order]
    fresh = np.append(True, found[1:] != found[:-1])[: len(found)]
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(fresh) - 1
    return found[fresh], order[fresh], place


class Trie:
    """Head words with exact counts, and two Elias-Fano levels with quantised terms and back-off masses."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays
        (self.hashes, self.counts, self.ids, self.scale, self.back1, self.term2, self.back2, self.term3) = arrays[:8]
        self.level2 = EliasFano.load(arrays[8:13])
        self.begins = EliasFano.load(arrays[13:18])
        self.offsets = EliasFano.load(arrays[18:23])
        self.level3 = EliasFano.load(arrays[23:28])

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, triples: np.ndarray, triple_counts: np.ndarray, core: int) -> Trie:
        """``pairs`` and ``triples`` are sorted keys over ids by descending count (``id * core + id`` ...)."""
        order = np.argsort(hashes)
        by_count = np.lexsort((hashes, -counts))
        ids = np.empty(len(hashes), dtype=np.int64)
        ids[by_count] = np.arange(len(hashes))
        of_id = counts[by_count].astype(np.float64)
        n_core = min(core, len(hashes))

        def discount(c: np.ndarray) -> float:
            low = int(c.min()) if len(c) else 1
            n1, n2 = int((c == low).sum()), int((c == low + 1).sum())
            return n1 / (n1 + 2 * n2) if n1 + n2 else 0.5

        first, second = pairs // core, pairs % core
        d2, d3 = discount(pair_counts), discount(triple_counts)
        term2 = (pair_counts - d2) / of_id[first] if len(pairs) else np.zeros(0)
        back1 = 1 - np.bincount(first, term2, minlength=n_core)[:n_core] if len(pairs) else np.ones(n_core)
        begins = np.searchsorted(first, np.arange(core + 1))
        level2 = EliasFano.of(pairs, core * core)
        # A triple needs both its pairs; its third word is known by its place after its second.
        lead, tail = triples // core, (triples // core % core) * core + triples % core
        at12, at23 = level2.find(lead), level2.find(tail)
        ok = (at12 >= 0) & (at23 >= 0)
        at12, at23, triple_counts = at12[ok], at23[ok], triple_counts[ok]
        successors = np.diff(begins)[second] if len(pairs) else np.zeros(0, dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(successors)]).astype(np.int64)
        keys = offsets[at12] + at23 - begins[second[at12]] if len(at12) else np.zeros(0, dtype=np.int64)
        sort = np.argsort(keys)
        keys, at12, triple_counts = keys[sort], at12[sort], triple_counts[sort]
        term3 = (triple_counts - d3) / pair_counts[at12] if len(keys) else np.zeros(0)
        back2 = 1 - np.bincount(at12, term3, minlength=len(pairs))[: len(pairs)] if len(keys) else np.ones(len(pairs))
        scales, codes = [], []
        for x in (back1, term2, back2, term3):
            code, scale = quantise(np.log10(np.maximum(x, 1e-9)))
            codes.append(code)
            scales.append(scale)
        levels = [level2, EliasFano.of(begins, len(pairs)), EliasFano.of(offsets, int(offsets[-1])), EliasFano.of(keys, int(offsets[-1]))]
        arrays = [hashes[order], counts[order].astype(np.int64), ids[order], np.concatenate(scales), *codes]
        return cls(arrays + [a for x in levels for a in x.parts()])

    def to_bytes(self) -> bytes:
        return _file_of(self.arrays)

    @classmethod
    def map_bytes(cls, raw: bytes) -> Trie:
        return cls(_mapped(raw))

    def _value(self, codes: np.ndarray, index: np.ndarray, which: int) -> np.ndarray:
        low, step = self.scale[2 * which : 2 * which + 2]
        return 10.0 ** (low + step * codes[index])

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frequency rank (-1 outside the head) and count (0) of each word."""
        if not len(self.hashes):
            return np.full(len(hashes), -1), np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        return np.where(hit, self.ids[at], -1), np.where(hit, self.counts[at], 0)

    def pair_at(self, a: np.ndarray, b: np.ndarray, core: int) -> np.ndarray:
        out = np.full(len(a), -1, dtype=np.int64)
        ok = np.flatnonzero((a >= 0) & (a < core) & (b >= 0) & (b < core))
        keys, back = np.unique(a[ok] * core + b[ok], return_inverse=True)
        out[ok] = self.level2.find(keys)[back]
        return out

    def probability(self, ids: np.ndarray, at12: np.ndarray, at23: np.ndarray, before: np.ndarray, base: np.ndarray, core: int) -> tuple[np.ndarray, np.ndarray]:
        """Interpolated P = extra + mass * base as (extra, mass): pairs (prev, cur) ``at23``, (prev2, prev) ``at12``."""
        extra, mass = np.zeros(len(ids)), np.ones(len(ids))
        context = np.flatnonzero((before >= 0) & (before < min(core, len(self.back1))))
        mass[context] = self._value(self.back1, before[context], 0)
        pair = np.flatnonzero(at23 >= 0)
        extra[pair] = self._value(self.term2, at23[pair], 1)
        wide = np.flatnonzero(at12 >= 0)
        if len(wide):
            back = self._value(self.back2, at12[wide], 2)
            extra[wide] *= back
            mass[wide] *= back
            both = wide[at23[wide] >= 0]
            begin = self.begins.get(before[both])
            keys, inverse = np.unique(self.offsets.get(at12[both]) + at23[both] - begin, return_inverse=True)
            found = self.level3.find(keys)[inverse]
            hit = np.flatnonzero(found >= 0)
            extra[both[hit]] += self._value(self.term3, found[hit], 3)
        return extra, mass


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KEY, _LAST = 62, 40
_WIRE = "shard long, batch long, asked boolean, keys binary, counts binary, firsts binary, first binary, below binary, below_counts binary"
_SETTLED = "kind string, place long, shard long, first binary, second binary, third binary, n1 long, n2 long, m1 long, m2 long"
_BATCHES = "batch long, asked boolean, tokens long, texts binary, words binary, ids binary"
_SCORES = "doc_id long, held_out boolean, whole long, n_tokens long, n_known long, base_score double, score double"
#: What is kept of a text: ``whole`` names the text that a piece is of, ``before`` tokens are context.
_TEXTS = ["doc_id", "held_out", "train", "asked", "whole", "before", "n_tokens"]


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, and the offsets of each text's tokens."""
    words = Words(data, offsets)
    counts = np.diff(words.first)
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(bounds[-1], END, dtype=np.uint64)
    out[np.arange(len(words.start)) + words.doc] = words.hash
    return out, bounds


def _bytes(numbers: np.ndarray) -> bytes:
    """Non-negative numbers in the narrowest width that holds them, after one byte for it."""
    top = int(numbers.max()) if len(numbers) else 0
    width = next(w for w in (1, 2, 3, 4, 8) if top < 1 << (8 * w))
    if width == 3:
        return bytes([width]) + np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    if raw[0] == 3:
        out = np.zeros(((len(raw) - 1) // 3, 4), dtype=np.uint8)
        out[:, :3] = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(-1, 3)
        return out.view("<u4").ravel().astype(np.int64)
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


def _coded(keys: np.ndarray) -> bytes:
    """Elias-Fano code of a monotone sequence."""
    width, low, high, _ = EliasFano.code(keys, int(keys[-1]) + 1 if len(keys) else 1)
    return np.array([len(keys), width, len(low)], dtype=np.int64).tobytes() + low.tobytes() + high.tobytes()


def _decoded(raw: bytes) -> np.ndarray:
    n, width, low = np.frombuffer(raw, dtype=np.int64, count=3).tolist()
    words = np.frombuffer(raw, dtype=np.uint64, offset=24)
    nothing = np.zeros(0, dtype=np.int64)
    return EliasFano(n, width, words[:low], words[low:], nothing, nothing).values()


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _as_table(schema: str, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(schema, rows)])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (doc_id, held_out, train, asked, text) as batches of token hashes."""
    from pyspark import TaskContext

    serial = TaskContext.get().partitionId() << 32

    def packed(tokens: list[np.ndarray], texts: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal serial
        serial += 1
        flat = np.concatenate(tokens)
        words, ids = np.unique(flat, return_inverse=True)
        about = pa.Table.from_batches(texts).combine_chunks().to_batches()[0]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, about.schema) as out:
            out.write_batch(about)
        asked = bool(np.any(about.column(3).to_numpy(zero_copy_only=False)))
        return _rows(_BATCHES, [(serial, asked, len(flat), sink.getvalue().to_pybytes(), words.tobytes(), _bytes(ids))])

    def about(part: pa.RecordBatch, whole: int | None, before: int, lengths: np.ndarray) -> pa.RecordBatch:
        n = part.num_rows
        return pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([whole] * n, pa.int64()), pa.array([before] * n, pa.int64()), pa.array(lengths)], names=_TEXTS)

    tokens: list[np.ndarray] = []
    texts: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        for part in slices(batch, "text"):
            found, bounds = _tokens(*text_buffer(part.column(4)))
            if part.num_rows == 1 and len(found) > BATCH:
                whole = serial + 1
                for at in range(0, len(found), BATCH):
                    before = min(2, at)
                    piece = found[at - before : at + BATCH]
                    yield packed([piece], [about(part, whole, before, np.array([len(piece)]))])
                continue
            if held and held + len(found) > BATCH:
                yield packed(tokens, texts)
                tokens, texts, held = [], [], 0
            tokens.append(found)
            texts.append(about(part, None, 0, np.diff(bounds)))
            held += len(found)
    if held:
        yield packed(tokens, texts)


@dataclass(frozen=True)
class Plan:
    """Number of shards of pairs, in how many rounds (a power of two) they are worked on, and number of shards of words."""

    shards: int
    rounds: int

    @property
    def homes(self) -> int:
        return max(1, self.shards // PAIRS_A_WORD)

    @property
    def _shift(self) -> int:
        return _KEY - (self.rounds.bit_length() - 1)

    def turn(self, pairs: np.ndarray) -> np.ndarray:
        """Round of a pair: its first bits."""
        return pairs >> self._shift

    @property
    def room(self) -> int:
        """Numbers that tell the pairs of one shard apart."""
        return (1 << self._shift) // (self.shards // self.rounds) + 1

    def key(self, pairs: np.ndarray) -> np.ndarray:
        """Shard of a pair times ``room``, plus what tells it apart there."""
        own = self.shards // self.rounds
        within, shard = np.divmod(pairs & ((1 << self._shift) - 1), own)
        return (self.turn(pairs) * own + shard) * self.room + within


class _Batch:
    """A batch with its pairs and triples: distinct keys in order of shard, and each occurrence's place among them."""

    def __init__(self, row: dict, plan: Plan, turn: int | None = None):
        self.texts = pa.ipc.open_stream(row["texts"]).read_all()
        self.words = np.frombuffer(row["words"], dtype=np.uint64)
        self.ids = _numbers(row["ids"])
        self.length = self.texts.column("n_tokens").to_numpy()
        self.ends = np.cumsum(self.length)
        #: Tokens that are the batch's own, and those of them that are learnt from.
        self.own = np.ones(len(self.ids), dtype=bool)
        before = self.texts.column("before").to_numpy()
        for i in np.flatnonzero(before).tolist():
            begin = self.ends[i] - self.length[i]
            self.own[begin : begin + before[i]] = False
        self.train = np.repeat(self.texts.column("train").to_numpy().astype(bool), self.length) & self.own
        self.word_keys = (self.words >> np.uint64(64 - _KEY)).astype(np.int64)
        self.plan, self.turn = plan, turn

    def ngrams(self) -> None:
        same = np.ones(max(0, len(self.ids) - 1), dtype=bool)
        same[self.ends[:-1] - 1] = False
        keys = (self.words * _A)[self.ids[:-1]]
        keys += self.words[self.ids[1:]]
        keys = (mix(keys) >> np.uint64(64 - _KEY)).view(np.int64)
        #: Pairs by the position of their second word; distinct ones in order of shard.
        at = np.flatnonzero(same if self.turn is None else same & (self.plan.turn(keys) == self.turn))
        self.pair_at = at + 1
        self.pairs, first, self.pair = _distinct(self.plan.key(keys[at]))
        self.firsts = self.word_keys[self.ids[at[first]]]
        #: Triples by the place of their first two words and a hash of the third; ``lead`` is the pair of each.
        more = np.flatnonzero(self.pair_at + 1 < len(self.ids))
        more = more[same[self.pair_at[more]]]
        self.triple_at, self.lead = self.pair_at[more] + 1, self.pair[more]
        last = (mix(self.words[self.ids[self.triple_at]] * _B) >> np.uint64(64 - _LAST)).view(np.int64)
        self.triples, _, self.triple = _distinct((self.lead << _LAST) | last)
        self.pair_cuts = np.searchsorted(self.pairs, np.arange(self.plan.shards + 1) * self.plan.room)
        self.triple_cuts = np.searchsorted(self.triples, self.pair_cuts << _LAST)


def _sender(plan: Plan, turn: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for i in range(many.num_rows):
                row = many.slice(i, 1).to_pylist()[0]
                b = _Batch(row, plan, turn)
                b.ngrams()
                pairs = np.bincount(b.pair, b.train[b.pair_at], minlength=len(b.pairs)).astype(np.int64)
                triples = np.bincount(b.triple, b.train[b.triple_at], minlength=len(b.triples)).astype(np.int64)
                out = []
                for s in np.flatnonzero(np.diff(b.pair_cuts)).tolist():
                    p, q = b.pair_cuts[s : s + 2]
                    t, u = b.triple_cuts[s : s + 2]
                    firsts, first = np.unique(b.firsts[p:q], return_inverse=True)
                    out.append((s, row["batch"], row["asked"], _coded(b.pairs[p:q] - s * plan.room), _bytes(pairs[p:q]), _coded(firsts), _bytes(first), _coded(b.triples[t:u] - (int(p) << _LAST)), _bytes(triples[t:u])))
                yield _rows(_WIRE, out)

    return send


def _joined(rows: list[dict], name: str) -> np.ndarray:
    return np.concatenate([_numbers(r[name]) for r in rows])


def _settle(plan: Plan) -> Callable:
    """Merges the tries of a shard to one; answers each asking batch from it; sends the numbers of successors of words on."""

    def settle(shard: pa.Table) -> pa.Table:
        rows = sorted(shard.to_pylist(), key=lambda r: not r["asked"])
        keys, below = [_decoded(r["keys"]) for r in rows], [_decoded(r["below"]) for r in rows]
        bounds, cuts = (np.cumsum([0, *map(len, x)]) for x in (keys, below))
        lead = np.concatenate([(t >> _LAST) + at for t, at in zip(below, bounds.tolist(), strict=False)])
        keys, last = np.concatenate(keys), np.concatenate(below) & ((1 << _LAST) - 1)
        trie, place, where = ShardTrie.of_pairs(keys, _joined(rows, "counts"), lead, last, _joined(rows, "below_counts"))
        out, number, asking = [], rows[0]["shard"], sum(r["asked"] for r in rows)
        place, lower = place[: bounds[asking]], cuts[asking]
        answers = trie.column(0, place), trie.successors(place), trie.column(1, trie.triples_at(place[lead[:lower]], last[:lower]))
        for i, r in enumerate(rows[:asking]):
            own, under = slice(*bounds[i : i + 2]), slice(*cuts[i : i + 2])
            out.append(("answer", r["batch"], number, _bytes(answers[0][own]), _bytes(answers[1][own]), _bytes(answers[2][under]), 0, 0, 0, 0))
        firsts = np.concatenate([_decoded(r["firsts"])[_numbers(r["first"])] for r in rows])
        words, n = np.unique(firsts[where], return_counts=True)
        homes = plan.homes
        order, cuts = _by_shard(words, homes)
        words, n = words[order], n[order]
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            out.append(("words", s, number, _coded(words[cuts[s] : cuts[s + 1]] // homes), _bytes(n[cuts[s] : cuts[s + 1]]), None, 0, 0, 0, 0))
        whole = [table[code] for table, code in zip(trie.tables, trie.codes, strict=True)]
        out.append(("sums", 0, number, None, None, None, *[int((x == c).sum()) for x in whole for c in (1, 2)]))
        return _as_table(_SETTLED, out)

    return settle


_WORDS = "shard long, batch long, asked boolean, keys binary, counts binary, successors binary"


def _word_sender(plan: Plan) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for i in range(many.num_rows):
                row = many.slice(i, 1).to_pylist()[0]
                b = _Batch(row, plan)
                counts = np.bincount(b.ids, b.train, minlength=len(b.words)).astype(np.int64)
                homes = plan.homes
                order, cuts = _by_shard(b.word_keys, homes)
                out = []
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    own = order[cuts[s] : cuts[s + 1]]
                    out.append((s, row["batch"], row["asked"], _coded(b.word_keys[own] // homes), _bytes(counts[own]), None))
                yield _rows(_WORDS, out)

    return send


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    shard = (keys % shards).astype(np.uint16 if shards <= 1 << 16 else np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _settle_words(shard: pa.Table) -> pa.Table:
    rows = sorted(shard.to_pylist(), key=lambda r: not r["asked"])
    keys, nothing = [_decoded(r["keys"]) for r in rows], np.zeros(0, dtype=np.int64)
    bounds = np.cumsum([0, *map(len, keys)])
    of = lambda name: np.concatenate([_numbers(r[name]) if r[name] is not None else np.zeros(len(k), dtype=np.int64) for r, k in zip(rows, keys, strict=True)])
    trie = ShardTrie.of_words(np.concatenate(keys), of("counts"), of("successors"))
    out, number, asking = [], rows[0]["shard"], sum(r["asked"] for r in rows)
    place = trie.levels[0].find(np.concatenate([nothing, *keys[:asking]]))
    answers = trie.column(0, place), trie.column(1, place)
    for i in range(asking):
        own = slice(*bounds[i : i + 2])
        out.append(("word", rows[i]["batch"], number, _bytes(answers[0][own]), _bytes(answers[1][own]), None, 0, 0, 0, 0))
    counts = trie.tables[0][trie.codes[0]]
    out.append(("total", 0, number, None, None, None, int(counts.sum()), len(counts), 0, 0))
    return _as_table(_SETTLED, out)


def _finish(plan: Plan, tokens: int, words: int, d2: float, d3: float) -> Callable:
    def finish(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        row = next(r for r in rows if r["texts"] is not None)
        answers = sorted((r for r in rows if r["kind"] == "answer"), key=lambda r: r["shard"])
        known = sorted((r for r in rows if r["kind"] == "word"), key=lambda r: r["shard"])
        b = _Batch(row, plan)
        b.ngrams()
        whole = lambda of, name: np.concatenate([_numbers(r[name]) for r in of] or [np.zeros(0, dtype=np.int64)])
        order, _ = _by_shard(b.word_keys, plan.homes)
        c1, t1 = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
        c1[order], t1[order] = whole(known, "first"), whole(known, "second")
        c2, t2, c3 = whole(answers, "first"), whole(answers, "second"), whole(answers, "third")
        base = (c1 + 1.0) / (tokens + words + 1)
        p = base[b.ids]
        seen = np.flatnonzero(c1[b.ids[b.pair_at - 1]] > 0)
        at, before = b.pair_at[seen], b.ids[b.pair_at[seen] - 1]
        p[at] = (np.maximum(c2[b.pair[seen]] - d2, 0) + d2 * t1[before] * p[at]) / c1[before]
        seen = np.flatnonzero(c2[b.lead] > 0)
        at, lead = b.triple_at[seen], b.lead[seen]
        p[at] = (np.maximum(c3[b.triple[seen]] - d3, 0) + d3 * t2[lead] * p[at]) / c2[lead]
        n = len(b.length)
        text = np.repeat(np.arange(n), b.length)
        per_text = [np.bincount(text, b.own * x, minlength=n) for x in (1.0, (c1 > 0)[b.ids], np.log10(base)[b.ids], np.log10(p))]
        whole = [pa.array(x.astype(np.int64)) for x in per_text[:2]]
        out = pa.Table.from_arrays([b.texts.column(0).cast(pa.int64()), b.texts.column(1), b.texts.column("whole"), *whole, *map(pa.array, per_text[2:])], names=[f.split()[0] for f in _SCORES.split(", ")])
        return out.filter(b.texts.column("asked"))

    return finish


@dataclass
class LanguageModel:
    texts: DataFrame


def train(texts: DataFrame, text_col: str = "text") -> LanguageModel:
    """The training texts; their counts are taken where they are needed, in the shards of ``score``."""
    return LanguageModel(texts.select(F.col(text_col).alias("text")))


def _keep_room() -> None:
    """Lets a process keep ``ROOM`` freed bytes (``mallopt``) until ``release``: else each array's pages are given back and zeroed anew."""
    try:
        ctypes.CDLL(None).mallopt(-1, ROOM)
    except (AttributeError, OSError):  # another C library
        pass


def _lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_room()
        yield from work(batches)

    return lean(run)


def _group(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``work`` on one group, after which the process holds no freed memory."""

    def run(group: pa.Table) -> pa.Table:
        keep_freed_memory_low()
        _keep_room()
        try:
            return work(group)
        finally:
            release()

    return run


def _drop_shuffles(spark: SparkSession) -> None:
    """Frees finished plans, so that Spark's cleaner deletes their shuffle files now."""
    gc.collect()
    spark._jvm.System.gc()


def score_all(rows: DataFrame) -> DataFrame:
    """Scores the asked rows of (doc_id, held_out, train, asked, text) under the model of the train rows."""
    spark = rows.sparkSession
    small_arrow_batches(spark)
    table = materialise(rows.mapInArrow(_lean(_batches), _BATCHES), "lm-tokens", WIDE_ROWS)
    size = int(table.agg(F.coalesce(F.sum("tokens"), F.lit(0))).collect()[0][0])
    rounds = ROUNDS if size > SHARD else 1
    plan = Plan(rounds * max(1, -(-size // (rounds * SHARD))), rounds)
    settled = None
    for turn in range(rounds):
        sent = table.mapInArrow(_lean(_sender(plan, turn)), _WIRE)
        part = materialise(sent.groupBy("shard").applyInArrow(_group(_settle(plan)), _SETTLED), "lm-ngrams")
        settled = part if settled is None else settled.unionByName(part)
        _drop_shuffles(spark)
    successors = settled.where("kind = 'words'").select(F.col("place").alias("shard"), F.lit(-1).cast("long").alias("batch"), F.lit(False).alias("asked"), F.col("first").alias("keys"), F.lit(None).cast("binary").alias("counts"), F.col("second").alias("successors"))
    words = materialise(table.mapInArrow(_lean(_word_sender(plan)), _WORDS).unionByName(successors).groupBy("shard").applyInArrow(_group(_settle_words), _SETTLED), "lm-words")
    _drop_shuffles(spark)
    total = lambda df, kind, *names: [int(x or 0) for x in df.where(F.col("kind") == kind).agg(*[F.sum(n) for n in names]).collect()[0]]
    n1, n2, m1, m2 = total(settled, "sums", "n1", "n2", "m1", "m2")
    n, v = total(words, "total", "n1", "n2")
    discount = lambda ones, twos: (ones + 1) / (ones + 2 * twos + 2)
    answers = settled.where("kind = 'answer'").unionByName(words.where("kind = 'word'")).select(F.col("place").alias("batch"), "kind", "shard", "first", "second", "third")
    every = table.where("asked").select("batch", "texts", "words", "ids").unionByName(answers, allowMissingColumns=True)
    finish = _finish(plan, n, v, discount(n1, n2), discount(m1, m2))
    out = None
    for turn in range(rounds):
        mine = every.where(F.pmod(F.hash("batch"), F.lit(rounds)) == turn)
        part = materialise(mine.groupBy("batch").applyInArrow(_group(finish), _SCORES), "lm-scores")
        out = part if out is None else out.unionByName(part)
        _drop_shuffles(spark)
    pieces = out.where("whole IS NOT NULL").groupBy("whole").agg(F.min("doc_id").alias("doc_id"), F.min("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    out = out.where("whole IS NULL").unionByName(pieces)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", held: str = "held_out") -> DataFrame:
    """One row per row of ``docs``: ids, token counts, base score and model score."""
    asked = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(held).alias("held_out"), F.lit(False).alias("train"), F.lit(True).alias("asked"), F.col(text_col).alias("text"))
    learnt = model.texts.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(True).alias("train"), F.lit(False).alias("asked"), "text")
    return score_all(asked.unionByName(learnt))


def op9_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out(F.col("doc_id"), 7).alias("held_out"))
    #: Training rows are scored too, so one pass over the texts both counts and asks.
    return score_all(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", (~F.col("held_out")).alias("train"), F.lit(True).alias("asked"), "text"))

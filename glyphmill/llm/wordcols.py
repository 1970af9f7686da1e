"""Vectorised word and shingle arrays over Arrow string columns.

Every Python-side operator of this subpackage reads texts through this module, so
that "word", "lower case" and "shingle" mean the same thing everywhere:

* a word is a maximal run of characters other than space and ``\\x09``-``\\x0D``;
* lower case touches A-Z only (both are byte-level rules, valid on UTF-8);
* a shingle is five consecutive words; a text of one to four words has its whole
  word sequence as its only shingle; a text without words has none.

All arrays are flat over a batch of texts with an offset array, never one Python
object per word. Batches are cut to a byte budget; a single longer text is hashed in
pieces of ``HASH_BYTES``, so that it costs a few bytes a byte. ``lean`` gives what a
partition needed back to the system, for a worker process outlives its tasks.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
#: Bytes of text handled at once; a single longer text forms a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes whose prefix sums are held at once while spans are hashed.
HASH_BYTES = 1 << 18

#: Size from which an array is mapped alone; smaller ones are used again without new pages.
MAPPED_BYTES = 5 << 20

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, HASH_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over a partition, after which the process holds no freed memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory_low()
        yield from work(batches)
        release()

    return run


def keep_freed_memory_low() -> None:
    """Has large arrays mapped one by one (``mallopt``), so that freeing one gives its pages back."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, MAPPED_BYTES)
    except (AttributeError, OSError):  # another C library: freed pages return later
        pass


def release() -> None:
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator: spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    moved = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        np.right_shift(x, np.uint64(shift), out=moved)
        x ^= moved
        if factor != 1:
            x *= np.uint64(factor)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its texts; a null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes of letters: ASCII ones and all of other scripts.
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True


def letters_only(data: np.ndarray) -> np.ndarray:
    """Lower case (A-Z and the capitals of Latin-1 in UTF-8), everything but letters as spaces."""
    out = np.where(LETTER[data], data, np.uint8(32))
    out[(out >= 65) & (out <= 90)] += 32
    if len(out) > 1:
        tail = out[1:]
        tail[(out[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 0x20
    return out


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of marked bytes of each text."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    filled = offsets[:-1] < offsets[1:]
    if filled.any():
        out[filled] = np.add.reduceat(mask.view(np.uint8), offsets[:-1][filled], dtype=np.int64)
    return out


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold at most ``limit`` bytes together."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = text_buffer(column)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Word positions and hashes of a batch of texts.

    ``start`` and ``end`` are byte positions in ``data``; words of text ``i`` are
    ``first[i]:first[i + 1]``; ``hash`` is a 64-bit hash of the lower-cased word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~SEPARATOR[data]
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            filled = offsets[:-1][offsets[:-1] < offsets[1:]]
            begins[filled] = inside[filled]
            last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            ends[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._hash: np.ndarray | None = None

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        return cls(*text_buffer(column))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of lower-cased byte spans in ascending order; equal bytes have equal hashes wherever they stand."""
        out = np.empty(len(start), dtype=np.uint64)
        at = 0
        while at < len(start):
            low = int(start[at])
            to = max(at + 1, int(np.searchsorted(start, low + HASH_BYTES // 2)))
            high = int(end[at:to].max())
            if high - low > HASH_BYTES:  # spans that are long themselves, one by one
                for i in range(at, to):
                    out[i] = self._long_span(int(start[i]), int(end[i]))
            else:
                sums = np.zeros(high - low + 1, dtype=np.uint64)
                np.cumsum((_LOWER[self.data[low:high]].astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, high - low), out=sums[1:])
                out[at:to] = (sums[end[at:to] - low] - sums[start[at:to] - low]) * _power_table(_BASE_INV, high - low + 1)[start[at:to] - low]
            at = to
        return mix(out)

    def _long_span(self, start: int, end: int) -> int:
        total, shift = 0, 1
        for at in range(start, end, HASH_BYTES):
            piece = _LOWER[self.data[at : min(end, at + HASH_BYTES)]].astype(np.uint64) + np.uint64(1)
            total += int((piece * _power_table(_BASE, len(piece))).sum(dtype=np.uint64)) * shift
            shift = shift * pow(_BASE, len(piece), 1 << 64) % (1 << 64)
        return total % (1 << 64)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.span_hash(self.start, self.end)
        return self._hash

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def shingles(self, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles, repeats included, and the offsets of each text's shingles."""
        counts = np.diff(self.first)
        per_doc = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
        offsets = np.concatenate([[0], np.cumsum(per_doc)])
        out = np.zeros(offsets[-1], dtype=np.uint64)
        weights = _power_table(0xD6E8FEB86659FD93, words + 1)[1:]
        long = np.repeat(counts >= words, per_doc)
        where = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - self.first[:-1], per_doc)
        for k in range(words):
            out[long] += self.hash[where[long] + k] * weights[k]
        for i in np.flatnonzero((counts > 0) & (counts < words)):
            own = self.hash[self.first[i] : self.first[i + 1]]
            out[offsets[i]] = (own * weights[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
        return mix(out), offsets

    def shingle_sets(self, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes of each text, and their offsets."""
        return distinct(*self.shingles(words))


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts and de-duplicates each of the runs that ``offsets`` bound."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[keep], doc[keep]
    return values, np.searchsorted(doc, np.arange(len(offsets)))

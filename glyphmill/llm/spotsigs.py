"""SpotSigs document fingerprints.

Words are letter runs in lower case. A spot is an anchor (a common word, and one in
``EVERY`` of the others by hash, so that lists have spots too) with the chain of the next
``CHAIN`` content words (words that are not common) after it. A fingerprint is the number
of words and the set of the spots' 30-bit hashes, in ascending order as five letters each.
Texts of few words have next to no spots; their fingerprints have two more parts, the
words (below ``SHORT_WORDS``) and the runs of three bytes (below ``TINY_WORDS``).

Two fingerprints are compared by Jaccard similarity, on the parts that the longer of both
texts has, so a pair is never compared on different kinds of features. Sets are partitioned
by length first: a pair whose partitions or sizes show that it cannot reach ``FLOOR`` is
not intersected and has likeness 0; every other likeness is exact.

``edit_likeness`` compares each text with an edited copy (its end replaced by the start
of the next document in id order) and with the next document. Documents are range-
partitioned and sorted by id, the first document of each range is also sent to the range
before it, and a range streams through with one document held back, so no global window
is needed and each text moves once.

Defined results: null texts are empty; texts without words have an empty fingerprint,
and two empty fingerprints have likeness 1; a text with words but no spot (no anchor, or
nothing after it) uses every word as an anchor; rows of one id follow one another in text
order; null ids come first; an only document is its own next one; texts of any length are
taken whole; empty tables give empty results; only the id and the text of a table are
read by ``edit_likeness``, and ``fingerprint`` gives a clashing column an underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import fresh
from .wordcols import SEPARATOR, Words, distinct, lean, letters_only, mix, slices, text_buffer

CHAIN = 2
#: Stands for a null id while ranges are formed: the smallest long.
_NULL_ID = -(1 << 63)
#: One in so many other words (by hash) is an anchor too: lists have no function words.
EVERY = 8
#: Below so many words a fingerprint also holds single words, or runs of three bytes.
SHORT_WORDS, TINY_WORDS = 40, 8
#: Frequent function words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in a is that it for on was as with be by are this at from or an he his not but they which you have had has were "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans par sur plus pas au avec ce se il sont ou "
    "el los las y del al con su para una por lo como más o esta son entre"
).split()
_BITS = 30
#: Likeness below which sizes alone may settle a pair.
FLOOR = 0.1
_LETTERS = np.frombuffer(b"+0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz~", dtype=np.uint8)


def _anchor_hashes() -> np.ndarray:
    words = Words.of(pa.array(ANCHORS))
    return np.unique(words.hash)


_ANCHORS = _anchor_hashes()


def spot_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct spot hashes of each text (words follow from 2^30, runs from 2^31), their offsets, and numbers of words."""
    words = Words(letters_only(data), offsets)
    n = len(offsets) - 1
    doc, hashes = words.doc, words.hash
    place = np.minimum(np.searchsorted(_ANCHORS, hashes), len(_ANCHORS) - 1)
    anchor = _ANCHORS[place] == hashes
    content = np.flatnonzero(~anchor)
    spots = np.flatnonzero(anchor | (hashes % np.uint64(EVERY) == 0))
    after = np.searchsorted(content, spots, side="right")
    value, owner = hashes[spots], doc[spots]
    whole = after + CHAIN <= len(content)
    value, owner, after = value[whole], owner[whole], after[whole]
    inside = doc[content[after + CHAIN - 1]] == owner if len(after) else np.zeros(0, dtype=bool)
    value, owner, after = value[inside], owner[inside], after[inside]
    for k in range(CHAIN):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[content[after + k]])
    #: Texts without a spot: chains of all words, shorter ones at the end.
    bare = (np.bincount(owner, minlength=n) == 0) & (np.diff(words.first) > 0)
    if bare.any():
        at = np.flatnonzero(bare[doc])
        own = hashes[at]
        for k in range(1, CHAIN + 1):
            there = np.minimum(at + k, len(doc) - 1)
            same = (at + k < len(doc)) & (doc[there] == doc[at])
            own = mix(own * np.uint64(0x9E3779B97F4A7C15) + np.where(same, hashes[there], np.uint64(0)))
        value, owner = np.concatenate([value, own]), np.concatenate([owner, doc[at]])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    #: Few spots say little: short texts add their words, the shortest their runs of three bytes.
    short = lambda x: x >> np.uint64(64 - _BITS)
    counts = np.diff(words.first)
    at = np.flatnonzero((counts < SHORT_WORDS)[doc])
    value, owner = [short(value), short(mix(hashes[at] + np.uint64(7))) + np.uint64(1 << _BITS)], [owner, doc[at]]
    for i in np.flatnonzero((counts < TINY_WORDS) & (np.diff(offsets) > 0)):
        raw = np.concatenate([data[offsets[i] : offsets[i + 1]], np.zeros(2, dtype=np.uint8)]).astype(np.uint64)
        if (~SEPARATOR[raw[:-2].astype(np.int64)]).any():
            runs = (raw[:-2] << np.uint64(16)) + (raw[1:-1] << np.uint64(8)) + raw[2:]
            value.append(short(mix(runs + np.uint64(3 << 32))) + np.uint64(2 << _BITS))
            owner.append(np.full(len(runs), i))
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    value, owner = value[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return *distinct(value, bounds), counts


@dataclass
class Print:
    """A fingerprint: number of words, and the sorted set."""

    words: int
    values: np.ndarray

    def part(self, kinds: int) -> np.ndarray:
        """Spots, and with more kinds words and runs."""
        return self.values[: np.searchsorted(self.values, np.uint64(kinds << _BITS))]

    def __str__(self) -> str:
        """The parts after the number of words, five letters a number; empty without features."""
        if not len(self.values):
            return ""
        cuts = np.searchsorted(self.values, np.array([k << _BITS for k in range(4)], dtype=np.uint64))
        return ".".join([str(self.words), *(_letters(self.values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))])


def prints(data: np.ndarray, offsets: np.ndarray) -> list[Print]:
    values, bounds, words = spot_sets(data, offsets)
    return [Print(int(words[i]), values[bounds[i] : bounds[i + 1]]) for i in range(len(words))]


def _letters(values: np.ndarray) -> str:
    parts = np.stack([(values >> np.uint64(s)) & np.uint64(63) for s in (24, 18, 12, 6, 0)], axis=1)
    return _LETTERS[parts.ravel().astype(np.int64)].tobytes().decode("ascii")


def likeness(a: Print, b: Print, floor: float = FLOOR) -> float:
    """Pruned Jaccard similarity of the parts that the longer text has."""
    longer = max(a.words, b.words)
    kinds = 1 if longer >= SHORT_WORDS else 2 if longer >= TINY_WORDS else 3
    return pruned_jaccard(a.part(kinds), b.part(kinds), floor)


def length_partition(size: int, floor: float) -> int:
    """Partition of a set size such that sets of partitions two or more apart cannot have Jaccard ``floor``."""
    return int(np.log(max(1, size)) / -np.log(floor)) if 0 < floor < 1 else 0


def pruned_jaccard(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard similarity of sorted sets; 0 for pairs that length partitions or the size bound exclude."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if floor and (abs(length_partition(len(a), floor) - length_partition(len(b), floor)) > 1 or min(len(a), len(b)) < floor * max(len(a), len(b))):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text."""
    (name,) = fresh(docs, name)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                made = [str(x) for x in prints(*text_buffer(part.column(part.schema.get_field_index(text_col))))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], names=[*part.schema.names, name])

    return docs.mapInArrow(lean(add), T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_RESULT_NAMES = [f.split()[0] for f in _RESULT.split(", ")]


def _compare(ids: list, texts: list[str], own: list[Print], nexts: list[str], following: list[Print]) -> list[pa.Array]:
    edited = []
    for text, after in zip(texts, nexts, strict=True):
        cut = len(text) // 4
        edited.append(text[: len(text) - cut] + after[:cut])
    edits = prints(*text_buffer(pa.array(edited, pa.string())))
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([str(x) for x in own], pa.string()),
        pa.array([str(x) for x in edits], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, edits, strict=True)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, following, strict=True)], pa.float64()),
    ]


def _deal(bounds: np.ndarray, firsts: dict[int, int]):
    """Adds each row's range (``part``) and copies the first document of each range to the range before it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array(sorted(firsts), dtype=np.int64)
        sends = np.array([firsts[x] for x in starts.tolist()], dtype=np.int32)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            part = np.searchsorted(bounds, ids, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(np.zeros(len(ids), dtype=np.int8))], names=["doc_id", "text", "part", "ahead"])
            at = np.minimum(np.searchsorted(starts, ids), len(starts) - 1)
            copies = np.flatnonzero(starts[at] == ids)
            if len(copies):
                own = batch.take(pa.array(copies))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(sends[at[copies]]), pa.array(np.ones(len(copies), dtype=np.int8))], names=["doc_id", "text", "part", "ahead"])

    return deal


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each document of a sorted range with its successor; a range ends with the copies from the next one."""
    held: tuple | None = None
    for batch in batches:
        for piece in slices(batch, "text"):
            column = piece.column(1).fill_null("")
            rows = list(zip(piece.column(0).to_pylist(), column.to_pylist(), prints(*text_buffer(column)), piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True))
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[3] == b[3] and not a[4]]
            if pairs:
                yield pa.RecordBatch.from_arrays(_compare([a[0] for a, _ in pairs], [a[1] for a, _ in pairs], [a[2] for a, _ in pairs], [b[1] for _, b in pairs], [b[2] for _, b in pairs]), names=_RESULT_NAMES)


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited copy, and the likeness to that and to the next document.

    Only ids are looked at to find the ranges (bounds and first ids, eight ranges a
    shuffle partition); texts then move once, each range with the first document of the
    next one behind its own.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    ranges = 8 * parts
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).collect()[0][0]
    bounds = np.array(sorted(set(cuts or [])), dtype=np.int64)
    number = F.lit(0)
    if len(bounds):
        steps = F.array(*[F.lit(int(b)) for b in bounds])
        number = F.size(F.filter(steps, lambda b: b <= F.col("doc_id")))
    low = {r["part"]: r["low"] for r in rows.groupBy(number.alias("part")).agg(F.min("doc_id").alias("low")).collect()}
    order = sorted(low)
    firsts = {low[p]: order[i - 1] for i, p in enumerate(order)}
    dealt = rows.mapInArrow(lean(_deal(bounds, firsts)), "doc_id long, text string, part int, ahead byte")
    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", "ahead", "doc_id", "text")
    out = ordered.select("doc_id", "text", "part", "ahead").mapInArrow(lean(_walk), _RESULT)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")))


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edit_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Quality by weak labels.

Overlapping heuristic labellers (bad or abstain; the silence of all votes for good) look at shouting, symbol noise,
repeated words, repeated lines, table-like separators, function words, sentence ends,
letters, word length and digits. Expectation-maximisation estimates their accuracies
and dependences from the vote patterns of all texts, without any label. The posterior
labels train a linear scorer over hashed features (shapes of tokens, their widths,
repeats of the token before), which then scores every text from its words alone.

The corpus counts its vote patterns in one pass (at most 2^11 patterns reach the driver);
the scorer is fitted on a sample of about ``SAMPLE`` documents (hash of the id).

Defined results: null, empty and wordless texts get no votes and score 0; equal texts
get equal scores, so ties and repeated rows do; texts of any length are read whole; an
empty table gives a scorer that says 0.5 of every text; empty tables give empty results;
clashing added columns get a leading underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spotsigs import ANCHORS
from .support import fresh
from .weak_labels import fit_label_model, fit_linear
from .wordcols import LETTER, Words, lean, letters_only, mix, per_text, slices, text_buffer

SAMPLE = 8000
BUCKETS = 1 << 14
PASSAGE = 200
KEEP = 0.5
#: Share of good texts that the label model starts from.
PRIOR = 0.85
#: Weight of those beliefs, in shares of the texts.
TRUST = 0.1
LABELLERS = ("shouting", "symbols", "stutter", "few_words", "repeated_lines", "separators", "function_words", "sentences", "letters", "word_length", "digits")
_FUNCTION_WORDS = np.unique(Words.of(pa.array(ANCHORS)).hash)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#$%&*|<>{}[]\\^~=_@+!"]] = True
#: Byte classes of token shapes: lower, upper, digit, other script, then each punctuation byte for itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes of ``LABELLERS`` (texts x labellers): 0 bad, -1 abstains."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    doc, count = words.doc, np.diff(words.first)
    size = np.maximum(1, np.diff(offsets))
    letters = np.maximum(1, per_text(LETTER[data], offsets))
    upper = per_text((data >= 65) & (data <= 90), offsets) / letters
    symbols = per_text(_SYMBOL[data], offsets) / size
    #: Words that are new in their passage of ``PASSAGE`` words: no measure of length.
    passage = (np.arange(len(doc)) - words.first[doc]) // PASSAGE
    pairs = np.lexsort((words.hash, passage, doc))
    new = np.ones(len(pairs), dtype=bool)
    new[1:] = (words.hash[pairs][1:] != words.hash[pairs][:-1]) | (passage[pairs][1:] != passage[pairs][:-1]) | (doc[pairs][1:] != doc[pairs][:-1])
    distinct = np.bincount(doc[pairs], new, minlength=n) / np.maximum(1, count)
    follows = np.zeros(len(doc), dtype=bool)
    follows[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    stutter = np.bincount(doc, follows, minlength=n) / np.maximum(1, count)
    alone = np.bincount(doc, (words.end - words.start == 1) & ~LETTER[data[words.start]] if len(doc) else None, minlength=n) / np.maximum(1, count)
    runs = Words(letters_only(data), offsets)
    common = np.isin(runs.hash, _FUNCTION_WORDS)
    function = np.bincount(runs.doc, common, minlength=n) / np.maximum(1, np.diff(runs.first))
    stop = np.bincount(doc, np.isin(data[words.end - 1], [46, 63]) if len(doc) else None, minlength=n) / np.maximum(1, count)
    length = np.bincount(doc, words.end - words.start, minlength=n) / np.maximum(1, count)
    digit = per_text((data >= 48) & (data <= 57), offsets) / size
    #: Lines: the share of words that stand on a line whose first word and length were seen before in the text.
    line_start = np.flatnonzero(data == 10) + 1
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    line_end = np.append(line_start[1:] - 1, len(data))
    line_end = np.minimum(line_end, offsets[np.minimum(line_doc + 1, n)])
    ok = (line_end > line_start + 20) & (line_doc < n)
    line_start, line_end, line_doc = line_start[ok], line_end[ok], line_doc[ok]
    again = np.zeros(n)
    if len(line_start):
        h = words.span_hash(line_start, line_end)
        order = np.lexsort((h, line_doc))
        repeat = np.zeros(len(order), dtype=bool)
        repeat[1:] = (h[order][1:] == h[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
        again = np.bincount(line_doc[order], repeat * (line_end - line_start)[order], minlength=n) / size
    #: Faults come one at a time, so freedom from one of them is no sign of quality.
    rule = lambda good, bad: np.where(bad, 0, np.where(good, 1, -1))
    never = np.zeros(n, dtype=bool)
    out = np.stack([
        rule(never, upper > 0.4),
        rule(never, symbols > 0.06),
        rule(never, stutter > 0.15),
        rule(never, (distinct < 0.25) & (count > 20)),
        rule(never, again > 0.3),
        rule(never, alone > 0.2),
        rule(never, (function < 0.08) & (count > 30)),
        rule(never, (stop < 0.005) & (count > 60)),
        rule(never, letters / size < 0.6),
        rule(never, (length > 14) | (length < 2)),
        rule(never, digit > 0.2),
    ], axis=1)
    out[count == 0] = -1
    return out.astype(np.int8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, share of its tokens): shapes of tokens, their last bytes and pairs of equal neighbours."""
    words = Words(data, offsets)
    shaped = Words(np.where(data == 32, np.uint8(32), _SHAPE[data]), offsets)
    doc = words.doc
    if not len(doc):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    width = np.minimum(words.end - words.start, 12).astype(np.uint64)
    last = shaped.data[shaped.end - 1].astype(np.uint64)
    before = shaped.data[np.maximum(shaped.end - 2, shaped.start)].astype(np.uint64)
    first = shaped.data[shaped.start].astype(np.uint64)
    follows = np.zeros(len(doc), dtype=np.uint64)
    follows[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    common = np.isin(words.hash, _FUNCTION_WORDS).astype(np.uint64)
    kinds = [
        (first << np.uint64(16)) + (before << np.uint64(8)) + last + np.uint64(1 << 40),
        width + (common << np.uint64(8)) + np.uint64(2 << 40),
        follows + np.uint64(3 << 40),
    ]
    bucket = np.concatenate([(mix(k) % np.uint64(BUCKETS)).astype(np.int64) for k in kinds])
    both, n = np.unique(np.tile(doc, len(kinds)) * BUCKETS + bucket, return_counts=True)
    of = both // BUCKETS
    return of, both % BUCKETS, n / np.maximum(1, np.diff(words.first))[of]


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    accuracies: dict[str, float]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, bucket, share = features(data, offsets)
        z = np.bincount(doc, self.weights[bucket] * share, minlength=len(offsets) - 1) + self.bias
        out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        out[np.bincount(doc, minlength=len(out)) == 0] = 0.0
        return out


def vote_patterns(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Distinct votes of all texts of ``docs`` (patterns x labellers) and the number of texts of each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                said, n = np.unique(_coded(votes(*text_buffer(part.column(0)))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(said, pa.int64()), pa.array(n, pa.int64())], ["pattern", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(count), "pattern long, n long")
    got = rows.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    pattern = np.array([r["pattern"] for r in got], dtype=np.int64)
    return _spelled(pattern), np.array([r["n"] for r in got], dtype=float)


def _coded(said: np.ndarray) -> np.ndarray:
    """Votes as a number: one bit a labeller that says bad."""
    return (said == 0).astype(np.int64) @ (1 << np.arange(len(LABELLERS)))


def _spelled(pattern: np.ndarray) -> np.ndarray:
    """Votes of a pattern; the silence of all labellers is a last vote, for good."""
    said = np.where((pattern[:, None] >> np.arange(len(LABELLERS))) & 1, 0, -1)
    return np.column_stack([said, np.where((said == 0).any(axis=1), -1, 1)])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Estimates labeller accuracies from all texts and trains the scorer on a bounded sample of ``docs``."""
    said, number = vote_patterns(docs, text_col)
    if not len(said):
        return QualityModel(np.zeros(BUCKETS), 0.0, {})
    total = float(number.sum())
    talk = np.stack([(number @ (said == v)) / total for v in (0, 1, -1)], axis=1)
    #: Where the label model starts: a labeller that says bad is right 19 times of 20.
    believed = np.zeros((said.shape[1], 3, 2))
    for j in range(said.shape[1]):
        bad = np.clip(talk[j, 0] * 0.95 / (1 - PRIOR), 0.02, 0.9)
        slip = np.clip(talk[j, 0] * 0.05 / PRIOR, 1e-3, 0.2)
        believed[j, :, 0] = bad, 1e-4, 1 - bad
        believed[j, :, 1] = slip, 1e-4, 1 - slip
    believed[-1, :, 0] = 1e-4, 0.1, 0.9
    believed[-1, :, 1] = 1e-4, 0.95, 0.05
    weight = TRUST * total
    model = fit_label_model(said, PRIOR, believed, strength=weight, prior_weight=weight, apart=(said.shape[1] - 1,), number=number)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("quality sample")), F.lit(1_000_000)) / 1e6
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(draw < min(1.0, SAMPLE / total))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column(1))
                pattern = _coded(votes(data, offsets))
                doc, bucket, share = features(data, offsets)
                bounds = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(share))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pattern), *lists], ["id", "pattern", "bucket", "share"])

    got = sample.mapInArrow(lean(describe), "id long, pattern long, bucket array<int>, share array<double>").toPandas().sort_values(["id", "pattern"], kind="stable")
    rows = [np.asarray(b, dtype=np.int64) for b in got["bucket"]]
    values = [np.asarray(s, dtype=float) for s in got["share"]]
    weights, bias = np.zeros(BUCKETS), 0.0
    if len(rows):
        target = model.posterior(_spelled(got["pattern"].to_numpy(dtype=np.int64)))
        weights, bias = fit_linear(rows, values, target, BUCKETS, np.ones(len(rows)), epochs=80, rate=0.5, bias=1.0)
    p = model.posterior(said)
    right = {name: float(((1 - p) * number * (said[:, j] == 0)).sum() / max(1.0, (number * (said[:, j] == 0)).sum())) for j, name in enumerate(LABELLERS)}
    return QualityModel(weights, bias, right)


def score_texts(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``kept`` (score at least ``KEEP``)."""
    score, kept = fresh(docs, "score", "kept")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = model.score(*text_buffer(part.column(part.schema.get_field_index(text_col))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=[*part.schema.names, score])

    return docs.mapInArrow(lean(rate), T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])).withColumn(kept, F.col(score) >= KEEP)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, fit(docs)).select("doc_id", "score", "kept")

"""Toxicity by weak supervision.

Lexicon voters are found in labelled texts: features are letter runs and their first
three to seven characters (fold to lower case over ASCII and Latin-1), each in two
strengths, seen at all and seen twice or more in a text; those whose document counts lean significantly to the toxic label (by likelihood ratio, counted by
the cluster over the training sample) become voters that say yes or abstain.
Pattern voters (shouting, exclamation, symbol noise, repetition) say yes, no or abstain.
A generative label model estimates the voters' accuracies and correlations by
expectation-maximisation, and a linear classifier learns its posterior labels from the
presence of features. Applied, one batch costs a look-up of hashed letter runs.

The labelled sample is bounded: about ``SAMPLE`` documents (hash of the id). Texts
are never returned to the driver, only the voters' votes and feature indices.

Defined results: null and empty texts have no features and get the model's base score;
rows without a label are scored but not learnt from; without labels of both classes the
score is the share of toxic labels (0 if there are none); several labels of one id that
disagree count as toxic; equal texts get equal scores, so ties and repeated rows do; texts
of any length are read whole; empty tables give empty results; clashing added columns get
a leading underscore. ``FEATURES`` and ``VOTERS`` bound what the model holds, not the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import fresh, held_out, materialise
from .weak_labels import fit_label_model, fit_linear, labelled_beliefs
from .wordcols import LETTER, Words, lean, letters_only, mix, per_text, slices, text_buffer

THRESHOLD = 0.3
SAMPLE = 20_000
#: Features that are looked at in detail, and those of them that vote.
FEATURES, VOTERS = 3000, 200
#: Share of toxic documents among those with a feature, below which it does not vote.
PRECISION = 0.9
#: Weight of the labelled shares that the label model starts from, in shares of the sample.
TRUST = 0.1
PREFIXES = (3, 4, 5, 6, 7)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text index and hash, repeats included, first of letter runs, then of their prefixes, one length at a time."""
    words = Words(letters_only(data), offsets)
    if not len(words.start):
        return
    doc = words.doc
    yield doc, mix(words.hash + np.uint64(1))
    char_starts = np.flatnonzero((words.data & 0xC0) != 0x80)
    at = np.searchsorted(char_starts, words.start)
    char_starts = np.append(char_starts, np.full(max(PREFIXES) + 1, len(data)))
    for k in PREFIXES:
        end = char_starts[at + k]
        long = end < words.end
        yield doc[long], words.span_hash(words.start[long], end[long])


def pattern_votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes of the pattern voters (texts x 4): shouting, exclamation, symbol noise, repeated words."""
    n = len(offsets) - 1
    size = np.maximum(1, np.diff(offsets))
    total = lambda mask: per_text(mask, offsets)
    upper = total((data >= 65) & (data <= 90))
    letters = np.maximum(1, total(LETTER[data]))
    shout = np.where(upper / letters > 0.5, 1, np.where(upper / letters < 0.1, 0, -1))
    exclaim = np.where(total(data == 33) / size > 0.02, 1, -1)
    noise = np.where(total((data == 36) | (data == 38) | (data == 35) | (data == 37) | (data == 42)) / size > 0.05, 1, -1)
    words = Words(data, offsets)
    same = np.zeros(len(words.start), dtype=bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    again = np.bincount(words.doc, same, minlength=n)
    repeat = np.where(again / np.maximum(1, np.diff(words.first)) > 0.3, 1, -1)
    return np.stack([shout, exclaim, noise, repeat], axis=1).astype(np.int8)


@dataclass
class Lexicon:
    """Features by sorted hash; ``once`` and ``twice`` are the features for any and for repeated presence, or -1."""

    hashes: np.ndarray
    once: np.ndarray
    twice: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, times: np.ndarray) -> Lexicon:
        """Feature ``i`` is the ``i``-th hash, seen ``times[i]`` times."""
        found, at = np.unique(hashes, return_inverse=True)
        places = np.full((2, len(found)), -1, dtype=np.int64)
        places[times - 1, at] = np.arange(len(hashes))
        return cls(found, places[0], places[1])

    def known(self, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) of the found values, in order of the text."""
        n = len(self.hashes)
        docs, features_ = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for doc, value in found:
            at = np.minimum(np.searchsorted(self.hashes, value), n - 1)
            hit = self.hashes[at] == value
            pairs, count = np.unique(doc[hit].astype(np.int64) * n + at[hit], return_counts=True)
            for which, enough in ((self.once, count >= 1), (self.twice, count >= 2)):
                feature = which[pairs % n]
                good = enough & (feature >= 0)
                docs.append(pairs[good] // n)
                features_.append(feature[good])
        docs, features_ = np.concatenate(docs), np.concatenate(features_)
        order = np.lexsort((features_, docs))
        return docs[order], features_[order]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    @classmethod
    def constant(cls, bias: float) -> ToxicityModel:
        """Gives every text the same score."""
        return cls(Lexicon.of(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)), np.zeros(0), bias)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.full(len(offsets) - 1, self.bias)
        if len(self.weights):
            doc, feature = self.lexicon.known(features(data, offsets))
            z += np.bincount(doc, self.weights[feature], minlength=len(z))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def independent(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The first ``VOTERS`` features, best (lowest) first, that say something new.

    A feature does not vote if a chosen one occurs in nine tenths of its documents and is
    about as precise: a longer prefix of a pure prefix, or a word of which that is the only one.
    """
    having: dict[int, set[int]] = {}
    for i, row in enumerate(rows):
        for f in row.tolist():
            having.setdefault(f, set()).add(i)
    precision = {f: float(toxic[list(own)].mean()) for f, own in having.items()}
    chosen: list[int] = []
    for f in sorted(having):
        own = having[f]
        new = all(len(own & having[c]) < 0.9 * len(own) or precision[c] < precision[f] - 0.05 for c in chosen)
        if precision[f] >= PRECISION and len(chosen) < VOTERS and new:
            chosen.append(f)
    return np.array(sorted(chosen), dtype=np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by label, within the slices of a partition."""
    for batch in batches:
        for part in slices(batch, "text"):
            toxic = part.column(part.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(part.column(part.schema.get_field_index("text")))
            for doc, value in features(data, offsets):
                order = np.lexsort((doc, value))
                doc, value = doc[order], value[order]
                first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]))
                count = np.diff(np.append(first, len(doc)))
                for times in (1, 2):
                    own = first[count >= times]
                    names, inverse = np.unique(value[own], return_inverse=True)
                    yes = np.bincount(inverse, toxic[doc[own]], minlength=len(names)).astype(np.int64)
                    every = np.bincount(inverse, minlength=len(names)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.full(len(names), times, dtype=np.int32)), pa.array(yes), pa.array(every - yes)], ["feature", "times", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learns from a bounded sample of the labelled rows of ``docs`` where ``learn`` (over ``id_col``) holds."""
    known_labels = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(learn).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known_labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / max(1, n_toxic + n_clean)
        return ToxicityModel.constant(float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity sample")), F.lit(1_000_000)) / 1e6
    chosen = F.broadcast(known_labels.where(draw < min(1.0, SAMPLE / (n_toxic + n_clean))))  # about SAMPLE rows by construction
    sample = materialise(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("id", "text", "toxic"), "toxicity-sample")
    counts = sample.mapInArrow(lean(_count), "feature long, times int, toxic long, clean long").groupBy("feature", "times").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    #: Signed likelihood-ratio statistic of the 2 x 2 table (feature, label).
    drawn = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    a, b, na, nb = F.col("toxic"), F.col("clean"), float(max(1, drawn.get(1, 0))), float(max(1, drawn.get(0, 0)))
    rate = (a + b) / (na + nb)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    gain = part(a, na * rate) + part(b, nb * rate) + part(na - a, na * (1 - rate)) + part(nb - b, nb * (1 - rate))
    common = materialise(counts.where(a + b >= 4).withColumn("gain", F.round(gain, 6)), "toxicity-counts")
    #: Of so many features, one without meaning passes this with a chance of about e^-3.
    least = float(np.log(max(1, common.count())) + 3)
    ranked = common.where((a / na > b / nb) & (a * (1 - PRECISION) >= b * PRECISION) & (F.col("gain") > least)).orderBy(F.desc("gain"), "feature", "times").limit(FEATURES).toPandas()
    if not len(ranked):
        return ToxicityModel.constant(-3.0)
    vocabulary = Lexicon.of(ranked["feature"].to_numpy().view(np.uint64), ranked["times"].to_numpy(dtype=np.int64))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column(1))
                doc, index = vocabulary.known(features(data, offsets))
                bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(index, pa.int32()))
                votes = pattern_votes(data, offsets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, votes.size + 1, votes.shape[1]), pa.int32()), pa.array(votes.astype(np.int32).ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, flat, part.column(2)], ["id", "index", "votes", "toxic"])

    described = sample.mapInArrow(lean(describe), "id long, index array<int>, votes array<int>, toxic int").toPandas().sort_values("id", kind="stable")
    rows = [np.asarray(x, dtype=np.int64) for x in described["index"]]
    toxic = described["toxic"].to_numpy()
    lexicon = independent(rows, toxic)
    place = np.full(len(ranked), -1)
    place[lexicon] = np.arange(len(lexicon))
    votes = np.full((len(rows), len(lexicon) + 5), -1, dtype=np.int64)
    for i, r in enumerate(rows):
        votes[i, place[r][place[r] >= 0]] = 1
        votes[i, len(lexicon) : -1] = described["votes"].iloc[i]
    #: The silence of the whole lexicon is a vote of its own; single abstentions are no evidence.
    votes[~(votes[:, : len(lexicon)] == 1).any(axis=1), -1] = 0
    #: What the labels say of each voter is the belief that the label model starts from.
    label_model = fit_label_model(votes, float(toxic.mean()), labelled_beliefs(votes, toxic), prior_weight=TRUST * len(rows), strength=TRUST * len(rows), apart=(votes.shape[1] - 1,))
    posterior = label_model.posterior(votes)
    weights, bias = fit_linear(rows, None, posterior, len(ranked), np.ones(len(rows)), epochs=150, decay=1e-6, bias=-2.0)
    weights = np.maximum(weights, 0.0)
    return ToxicityModel(vocabulary, weights, bias)


def score_texts(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 at ``THRESHOLD`` or more)."""
    score, predicted = fresh(docs, "score", "predicted")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = model.score(*text_buffer(part.column(part.schema.get_field_index(text_col))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=[*part.schema.names, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(lean(rate), schema).withColumn(predicted, F.when(F.col(score) >= THRESHOLD, 1).otherwise(0).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject."""
    scored = score_texts(docs, model, text_col)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id"), 4))
    return score_texts(docs.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")

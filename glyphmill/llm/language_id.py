"""Language identification with a byte convolutional network.

Network: byte embedding, filters of widths 2 to 5 (ReLU), max pooling over a window,
softmax. It is trained in numpy on the driver with Adam on windows of a bounded sample
of labelled texts: about ``SAMPLE_PER_LANG`` documents of each language (a hash of the
id below a per-language fraction), one passage of ``PASSAGE`` characters at a hashed
position each.

Applied, the embedding and the filters collapse to one table of filter responses per
(offset in filter, byte), so a window costs table look-ups, additions and a running
maximum over a whole batch of fixed-length windows. Every text is covered by windows
from its first to its last byte; its class probabilities are the mean over windows,
weighted by their length.

Defined results: null texts and texts without a letter get ``und`` and score 0; rows
with null language are not learnt from; with no labelled row every text gets ``und``;
of equally likely languages the first by code point counts; equal texts and repeated rows
get equal results; texts of any length are read to their last byte; empty tables give
empty results; clashing added columns get a leading underscore. ``LANGS`` bounds the
classes of the model: of more languages (a corrupt column) the rarest are not learnt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import fresh, held_out
from .wordcols import lean, slices, text_buffer

UNKNOWN = "und"
WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4, 5), 16, 12
SAMPLE_PER_LANG, PASSAGE = 1200, 900
EPOCHS, BATCH, RATE, SEED = 5, 128, 4e-3, 20
#: Most languages that a model learns, by number of rows; more would be a corrupt column.
LANGS = 500
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Windows that one pass handles.
_AT_ONCE = 4096


@dataclass
class ByteConvNet:
    langs: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    shift: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Per width and offset: 256 x FILTERS responses."""
        return [[np.ascontiguousarray(self.embedding @ w[j]) for j in range(len(w))] for w in self.filters]


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows (count x WINDOW), their texts and their lengths."""
    sizes = np.diff(offsets)
    per = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), per)
    start = offsets[:-1][doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
    length = np.minimum(WINDOW, offsets[1:][doc] - start)
    padded = np.concatenate([_FOLD[data], np.zeros(WINDOW, dtype=np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start].copy() if len(start) else np.zeros((0, WINDOW), dtype=np.uint8)
    for i in np.flatnonzero(length < WINDOW):
        out[i, length[i] :] = 0
    return out, doc, length


def _pooled(net: ByteConvNet, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    by_place = np.ascontiguousarray(windows.T)
    n = windows.shape[0]
    out = []
    take, add = np.empty((n, FILTERS), dtype=np.float32), np.empty((n, FILTERS), dtype=np.float32)
    for table, shift in zip(tables, net.shift, strict=True):
        best = np.full((n, FILTERS), -np.inf, dtype=np.float32)
        for t in range(WINDOW - len(table) + 1):
            np.take(table[0], by_place[t], axis=0, out=add, mode="clip")
            for j in range(1, len(table)):
                np.take(table[j], by_place[t + j], axis=0, out=take, mode="clip")
                np.add(add, take, out=add)
            np.maximum(best, add, out=best)
        out.append(np.maximum(best + shift, 0))
    return np.concatenate(out, axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = SEED) -> ByteConvNet | None:
    """Fits the network to windows of ``texts``; None if there is nothing to learn from."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    x, doc, length = _windows(data, offsets)
    y = np.array([langs.index(lab) for lab in labels])[doc]
    good = length >= 16
    x, y = x[good], y[good]
    #: Short texts occur too: some windows are cut to a random length.
    cut = rng.random(len(x)) < 0.3
    for i in np.flatnonzero(cut):
        x[i, rng.integers(16, WINDOW) :] = 0
    glorot = lambda *s, fan: rng.normal(0, (2 / fan) ** 0.5, s).astype(np.float32)
    params = [rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)]
    params += [glorot(k, EMBEDDING, FILTERS, fan=k * EMBEDDING) for k in WIDTHS]
    params += [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
    params += [glorot(FILTERS * len(WIDTHS), len(langs), fan=FILTERS * len(WIDTHS)), np.zeros(len(langs), dtype=np.float32)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    nw = len(WIDTHS)
    #: Every class weighs the same.
    weight = (len(y) / (len(langs) * np.maximum(1, np.bincount(y, minlength=len(langs)))))[y].astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            emb, filters, shifts, dense, bias = params[0], params[1 : 1 + nw], params[1 + nw : 1 + 2 * nw], params[-2], params[-1]
            xb = x[pick]
            e = emb[xb]
            pooled, places = [], []
            for w, s in zip(filters, shifts, strict=True):
                k = len(w)
                response = sum(e[:, j : WINDOW - k + 1 + j] @ w[j] for j in range(k))
                best = response.argmax(axis=1)
                places.append(best)
                pooled.append(np.maximum(np.take_along_axis(response, best[:, None, :], axis=1)[:, 0] + s, 0))
            h = np.concatenate(pooled, axis=1)
            p = _softmax(h @ dense + bias)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= (weight[pick] / len(pick))[:, None]
            grads = [np.zeros_like(q) for q in params]
            grads[-2], grads[-1] = h.T @ p, p.sum(axis=0)
            back = (p @ dense.T) * (h > 0)
            for i, (w, best) in enumerate(zip(filters, places, strict=True)):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[1 + nw + i] = g.sum(axis=0)
                for j in range(len(w)):
                    chars = np.take_along_axis(xb, best + j, axis=1)
                    grads[1 + i][j] = np.einsum("bfe,bf->ef", emb[chars], g)
                    np.add.at(grads[0], chars.ravel(), (g[:, :, None] * w[j].T[None]).reshape(-1, EMBEDDING))
            step += 1
            rate = RATE * min(1.0, 20 / step) ** 0.5 if step > 20 else RATE * step / 20
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return ByteConvNet(langs, params[0], params[1 : 1 + nw], params[1 + nw : 1 + 2 * nw], params[-2], params[-1])


def probabilities(net: ByteConvNet, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean class probabilities of each text over all its windows; zeros for an empty text."""
    windows, doc, length = _windows(data, offsets)
    out = np.zeros((len(offsets) - 1, len(net.langs)))
    tables = net.tables()
    for at in range(0, len(doc), _AT_ONCE):
        part = slice(at, at + _AT_ONCE)
        p = _softmax(_pooled(net, windows[part], tables) @ net.dense + net.bias)
        np.add.at(out, doc[part], p * length[part, None])
    return out / np.maximum(1, np.diff(offsets))[:, None]


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteConvNet | None:
    """Trains on a bounded sample of the rows where ``learn`` holds and the language is known."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, SAMPLE_PER_LANG / r["n"]))])
    drawn = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1_000_000)) / 1e6 < F.element_at(share, F.col("lang"))
    first = F.pmod(F.xxhash64("id", F.lit("passage")), F.greatest(F.lit(1), F.length("text") - PASSAGE)).cast("int") + 1
    sample = rows.where(drawn).select("id", "lang", F.substring("text", first, F.lit(PASSAGE)).alias("passage")).toPandas().sort_values(["id", "lang", "passage"], kind="stable")
    return train(sample["passage"].tolist(), sample["lang"].tolist())


def identify(docs: DataFrame, net: ByteConvNet | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    pred, score, letters = fresh(docs, "lang_pred", "score", "has_letters")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                known = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                if net is None:
                    best, top = np.zeros(part.num_rows, dtype=int), np.zeros(part.num_rows)
                    names = np.array([UNKNOWN], dtype=object)
                    known = np.zeros(part.num_rows, dtype=bool)
                else:
                    p = probabilities(net, *text_buffer(part.column(part.schema.get_field_index(text_col))))
                    best, top, names = p.argmax(axis=1), p.max(axis=1), np.array(net.langs, dtype=object)
                out = np.where(known, names[best], UNKNOWN)
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out.tolist(), pa.string()), pa.array(np.where(known, np.clip(top, 0, 1), 0.0))], names=[*part.schema.names[:-1], pred, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.withColumn(letters, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))).mapInArrow(lean(label), schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    net = fit(docs, ~held_out(F.col("doc_id"), 4))
    return identify(docs.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "text"), net).select("doc_id", "held_out", "lang_pred", "score")



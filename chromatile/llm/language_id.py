"""Language identification by a convolutional network over bytes, trained and applied in numpy.

Filters of several widths slide over the bytes of fixed-length windows, are max pooled over each
window, and a softmax layer scores the languages. Every window of a text counts, weighted by its
bytes. As the input is one-hot, a filter is a sum of table look-ups; for applying, the tables of
neighbouring bytes are merged into tables over pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import freeing, sample_by_hash

WIDTHS = (2, 3, 4)
FILTERS = 16
BYTES = 256
WINDOW = 512
PAD = 32  # a blank
SHORTEST = 16
UNKNOWN = "und"


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Model:
    """filters[w][j]: byte x filter table of the j-th byte under a filter of width w; dense: features x languages."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def _features(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Max pooled features of windows x (n, WINDOW), and where the maxima are."""
    tops, places = [], []
    for w in WIDTHS:
        n = x.shape[1] - w + 1
        z = sum(model.filters[w][j][x[:, j : j + n]] for j in range(w))
        at = z.argmax(axis=1)
        places.append(at)
        tops.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0])
    return np.concatenate(tops, axis=1) + model.bias, np.concatenate(places, axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 5, batch: int = 64, rate: float = 0.005, seed: int = 0) -> Model:
    """Train by Adam on windows (n, WINDOW) of bytes and language numbers; the same input gives the same model.

    Each time a window is used, it is cut to a random part of it in half of the cases, since short
    texts fill windows only in part.
    """
    rng = np.random.default_rng(seed)
    k, f = len(languages), len(WIDTHS) * FILTERS
    model = Model(languages, {w: rng.normal(0, 0.3, (w, BYTES, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(f, np.float32), rng.normal(0, 0.3, (f, k)).astype(np.float32), np.zeros(k, np.float32))
    weights = [*(model.filters[w] for w in WIDTHS), model.bias, model.dense, model.dense_bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            x, y = windows[order[at : at + batch]].copy(), labels[order[at : at + batch]]
            for row in x[rng.random(len(x)) < 0.5]:
                size = int(rng.integers(SHORTEST, WINDOW))
                begin = int(rng.integers(0, WINDOW - size + 1))
                row[:size], row[size:] = row[begin : begin + size].copy(), PAD
            z, places = _features(model, x)
            h = np.maximum(z, 0)
            d = _softmax(h @ model.dense + model.dense_bias)
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            back = (d @ model.dense.T) * (z > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(model.filters[w])
                own, own_at = back[:, i * FILTERS : (i + 1) * FILTERS], places[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (x[np.arange(len(x))[:, None], own_at + j], np.arange(FILTERS)[None, :]), own)
                grads.append(g)
            grads += [back.sum(axis=0), h.T @ d, d.sum(axis=0)]
            step += 1
            now = rate * (1 - at / len(order)) if epoch == epochs - 1 else rate  # the last epoch slows down
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


class Scorer:
    """Applies a model to windows in pieces that fit the cache."""

    def __init__(self, model: Model):
        t = model.filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(BYTES * BYTES, FILTERS)
        self.model = model
        self.pairs = np.ascontiguousarray(np.concatenate([pair(t[2][0], t[2][1]), pair(t[3][0], t[3][1]), pair(t[4][0], t[4][1])], axis=1))
        self.third = np.ascontiguousarray(t[3][2])
        self.last = np.ascontiguousarray(pair(t[4][2], t[4][3]))

    def probabilities(self, x: np.ndarray, step: int = 16) -> np.ndarray:
        """Of windows x (n, WINDOW); windows lie along the last axis while pooling, so that maxima are taken over whole rows."""
        out = []
        for at in range(0, len(x), step):
            c = np.ascontiguousarray(x[at : at + step].T)
            p = c[:-1].astype(np.int32) * BYTES + c[1:]
            z = self.pairs[p]
            z3 = z[:-1, :, FILTERS : 2 * FILTERS] + self.third[c[2:]]
            z4 = z[:-2, :, 2 * FILTERS :] + self.last[p[2:]]
            top = np.concatenate([z[:, :, :FILTERS].max(axis=0), z3.max(axis=0), z4.max(axis=0)], axis=1)
            out.append(np.maximum(top + self.model.bias, 0))
        return _softmax(np.concatenate(out) @ self.model.dense + self.model.dense_bias)


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last one padded with blanks, and the bytes in each."""
    n = max(1, -(-len(data) // WINDOW))
    x = np.full(n * WINDOW, PAD, np.uint8)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    size = np.full(n, WINDOW)
    size[-1] = len(data) - (n - 1) * WINDOW
    return x.reshape(n, WINDOW), size


def has_letter(data: bytes) -> bool:
    """Whether a UTF-8 text has a letter of any script."""
    x = np.frombuffer(data, np.uint8)
    if _LETTER[x].any():
        return True
    return bool((x >= 128).any()) and any(c.isalpha() for c in data.decode("utf-8", "replace"))


def with_letter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter; needs no model."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).view(pa.binary()).to_pylist()
            yield batch.filter(pa.array([bool(t) and has_letter(t) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", docs_per_language: int = 800, most_docs: int = 20_000, most_languages: int = 256, seed: int = 0) -> Model:
    """Fit on a bounded sample of the rows of ``docs`` that have a label and are not held out.

    ``docs_per_language`` documents a language (fewer if there are so many languages that they would
    be over ``most_docs``) are chosen by a hash of the text, so that copies count once; all windows of their whole texts
    count. Languages beyond the ``most_languages`` most frequent are not learned. Without any
    labelled row the model knows no language.
    """
    rows = docs.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(label_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("_id"))
    counts = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_lang").limit(most_languages).collect()
    languages = sorted(r["_lang"] for r in counts)
    if not languages:
        return Model([], {}, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    each = max(1, min(docs_per_language, most_docs // len(languages)))
    chosen = sample_by_hash(rows.filter(F.col("_lang").isin(languages)), "_lang", each, "_text")
    got = sorted((r["_lang"], r["_text"].encode()) for r in chosen.filter("_text != ''").select("_lang", "_text").collect())
    found = [windows_of(data)[0] for _, data in got]
    number = {k: i for i, k in enumerate(languages)}
    labels = np.repeat([number[lang] for lang, _ in got], [len(x) for x in found]).astype(np.int64)
    return fit(np.concatenate(found) if found else np.zeros((0, WINDOW), np.uint8), labels, languages, seed=seed)


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language of the whole text and its probability.

    Null texts and texts without a letter, and all texts if the model knows no language, are ``und``
    with score 0. Only the text is an input of the prediction; all columns of ``docs`` are kept, but
    for columns that have the names of the new ones, which are replaced.
    """
    docs = docs.drop(lang_col, score_col)
    text_at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model.languages else None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(text_at).cast(pa.string()).view(pa.binary()).to_pylist()
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                known = [i for i, t in enumerate(texts) if scorer and t and has_letter(t)]
                if known:
                    windows, sizes = zip(*[windows_of(texts[i]) for i in known], strict=True)
                    size = np.concatenate(sizes).astype(float)
                    p = scorer.probabilities(np.concatenate(windows)) * size[:, None]
                    first = np.cumsum([0, *map(len, sizes[:-1])])
                    p = np.add.reduceat(p, first) / np.add.reduceat(size, first)[:, None]
                    for i, row in zip(known, p, strict=True):
                        langs[i], scores[i] = model.languages[int(row.argmax())], float(min(1.0, row.max()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*[f"c{i}" for i in range(part.num_columns)], lang_col, score_col])

    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema) + f", `{lang_col}` string, `{score_col}` double"
    return flat.mapInArrow(freeing(apply), schema).toDF(*docs.columns, lang_col, score_col)

"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

Words and their shapes (letter case, first and last character, length, whether the word before is the same) are hashed
into a fixed number of rows. Every row has a random index vector; a row's vector adds the index vectors of its
neighbours in the training texts. A document is the mean of its words' vectors and of its shapes' vectors with its
length and their norms. Labels come from at most `SAMPLE` labelled documents outside the held-out fold (crc32 of the
doc_id's text mod 4 = 2); every document is scored.

NULL and empty texts pool to zeros and get a score like any other. Labels other than 0 and 1, and labels of unknown
documents, are left out; with one class only, or none, every score is that class's share (0.5 for none)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.words import Words, mixed, pieces, words_of

SAMPLE = 4000  # labelled documents that the model is fitted on, at most
ROWS, SHAPES, WIDTH = 1 << 14, 1 << 10, 24
HIDDEN, ROUNDS, RATE, DECAY = 24, 400, 0.02, 1e-4
THRESHOLD = 0.7

# Kinds of bytes: other, lower, upper, digit, full stop or comma, each symbol of its own.
_KIND = np.zeros(256, dtype=np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[44, 46]] = 4
for _i, _c in enumerate(b"!#$%&*|<>?-:;\"'()"):
    _KIND[_c] = 5 + _i


@dataclass
class Model:
    vectors: np.ndarray  # of rows, then of shapes
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        x = (pooled - self.mean) / self.scale
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled) / self.temperature, -30, 30)))


def rows_of_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, row of its shape)."""
    if not len(words.start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    again = np.zeros(len(words.hash), dtype=np.int64)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    size = words.end - words.start
    second = np.where(size > 1, words.data[np.minimum(words.start + 1, words.end - 1)], 0)
    kinds = [_KIND[words.data[words.start]], _KIND[second], _KIND[words.data[words.end - 1]], np.minimum(size, 12) // 3, again]
    shape = np.zeros(len(size), dtype=np.int64)
    for kind in kinds:
        shape = shape * 32 + kind
    return (words.hash % np.uint64(ROWS)).astype(np.int64), ROWS + (mixed(shape.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)


def word_vectors(texts: list[pa.Array], seed: int) -> np.ndarray:
    """Index vectors plus the mean index vector of neighbours two words to each side."""
    rng = np.random.default_rng(seed)
    index = (rng.integers(0, 6, size=(ROWS + SHAPES, WIDTH)) // 2 - 1).astype(np.float32)
    sums, counts = np.zeros_like(index), np.zeros(ROWS + SHAPES, dtype=np.float32)
    for text in texts:
        words = words_of(text)
        for ids in rows_of_words(words):
            for step in (1, 2):
                same = np.flatnonzero(words.row[step:] == words.row[:-step])
                for a, b in ((same, same + step), (same + step, same)):
                    np.add.at(sums, ids[a], index[ids[b]])
                    np.add.at(counts, ids[a], 1)
    vectors = index + sums / np.maximum(counts, 1)[:, None]
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True).clip(1e-6)).astype(np.float32)


def pool(text: pa.Array, vectors: np.ndarray) -> np.ndarray:
    words = words_of(text)
    size = np.diff(words.first)
    some = np.flatnonzero(size)
    out = np.zeros((len(size), 2 * WIDTH + 3), dtype=np.float64)
    if len(some):
        for k, ids in enumerate(rows_of_words(words)):
            mean = np.add.reduceat(vectors[ids], words.first[some], axis=0) / size[some, None]
            out[some, k * WIDTH : (k + 1) * WIDTH] = mean
            out[some, 2 * WIDTH + k] = np.linalg.norm(mean, axis=1)
    out[:, -1] = np.log1p(size)
    return out


def train(pooled: np.ndarray, labels: np.ndarray, vectors: np.ndarray, seed: int) -> Model:
    """Adam on all but every fifth row; those set the temperature."""
    rng = np.random.default_rng(seed + 1)
    mean, scale = pooled.mean(axis=0), pooled.std(axis=0) + 1e-6
    x, y = (pooled - mean) / scale, labels.astype(np.float64)
    fold = np.arange(len(y)) % 5 == 4
    if fold.all() or not fold.any() or len(np.unique(y[~fold])) < 2:
        fold = np.zeros(len(y), dtype=bool)
    share = np.array([0.5 / max((y[~fold] == k).mean(), 1e-9) for k in (0, 1)])
    weight = np.sqrt(share)[y.astype(int)]
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    xt, yt, wt = x[~fold], y[~fold], weight[~fold] / weight[~fold].sum()
    for step in range(1, ROUNDS + 1):
        hidden = np.tanh(xt @ params[0] + params[1])
        z = np.clip(hidden @ params[2] + params[3][0], -30, 30)
        error = (1 / (1 + np.exp(-z)) - yt) * wt
        back = np.outer(error, params[2]) * (1 - hidden**2)
        slopes = [xt.T @ back + DECAY * params[0], back.sum(axis=0), hidden.T @ error + DECAY * params[2], np.array([error.sum()])]
        for i, slope in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.999 * second[i] + 0.001 * slope**2
            params[i] = params[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    if fold.any():
        z = model.logits(pooled[fold])
        grid = np.geomspace(0.25, 8, 41)
        loss = [np.mean(np.logaddexp(0, -z / t) * y[fold] + np.logaddexp(0, z / t) * (1 - y[fold])) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 1) -> Model | float:
    """The model, or the share of label 1 where there are not two classes."""
    chosen = labels.select("doc_id", "quality").where("quality in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    table = rows.toArrow().combine_chunks()
    table = table.take(np.argsort(table["doc_id"].to_numpy(), kind="stable"))
    quality = table["quality"].to_numpy().astype(int)
    if len(set(quality.tolist())) < 2:
        return float(quality.mean()) if len(quality) else 0.5
    texts = [p.column("text") for p in pieces(iter(table.select(["text"]).to_batches()))]
    vectors = word_vectors(texts, seed)
    order = np.argsort([zlib.crc32(str(d).encode()) for d in table["doc_id"].to_pylist()], kind="stable")
    pooled = np.concatenate([pool(t, vectors) for t in texts])
    return train(pooled[order], quality[order], vectors, seed)


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 2 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for piece in pieces(batches):
            if isinstance(held, float):
                found = np.full(piece.num_rows, held)
            else:
                found = held.scores(pool(piece.column("text"), held.vectors))
            yield pa.record_batch([piece.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    rows = score(docs, fit(docs, labels, sample))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

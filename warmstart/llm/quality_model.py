"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Tokens are runs of letters and digits (case kept) and single marks, hashed to ``BUCKETS``. Every bucket has a
fixed sparse ternary index vector; a word's vector is the sum of the index vectors of the tokens around it,
over all documents: each task adds up its rows in one table and emits it, Spark sums the tables.
The result (``BUCKETS`` x ``DIM``, the same size for any corpus) is broadcast. A document is the mean and
the spread of its tokens' unit vectors and the logarithm of their number. A two-layer numpy network is fitted on at most
``MAX_ROWS`` labelled rows (those with the smallest hash of their id), a fifth of them kept aside to fit
the temperature that calibrates its probabilities.

Defined results: null and empty texts are documents without tokens (all pooled values 0) and get the score the
network gives to those; null labels are not learned from, a doc_id with several labels takes the smallest;
if there are no rows of both labels every score is the share of label 1 (0.5 without rows); repeated rows get
equal scores; a very long text is a slice of its own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warmstart.llm import arrowtext as A
from warmstart.llm.common import bounded_sample, store

BITS, DIM, NONZERO, REACH = 14, 32, 4, 2
BUCKETS = 1 << BITS
MAX_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4
_FLUSH = 1 << 20  # tokens that are added up at once

_rng = np.random.default_rng(11)
_PLACE = np.argsort(_rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]  # distinct places of each index vector
_SIGN = np.where(np.arange(NONZERO) % 2 == 0, 1.0, -1.0)


def _buckets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, buf, offs in A.slices(texts):
        starts, ends, row = A.tokens(buf, offs)
        yield i, j, (A.hashes(buf, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64), row


def _add_contexts(total: np.ndarray, word: np.ndarray, row: np.ndarray) -> None:
    for d in range(1, REACH + 1):
        near = row[d:] == row[:-d]
        left, right = word[:-d][near], word[d:][near]
        for at, around in ((left, right), (right, left)):
            for t in range(NONZERO):
                cell = at * DIM + _PLACE[around, t]
                total += _SIGN[t] * np.bincount(cell, minlength=len(total))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS * DIM)
    words, rows, held, seen = [], [], 0, 0
    for b in batches:
        for i, j, word, row in _buckets(b.column(0)):
            words.append(word)
            rows.append(row + seen)
            seen += j - i
            held += len(word)
            if held >= _FLUSH:
                _add_contexts(total, np.concatenate(words), np.concatenate(rows))
                words, rows, held = [], [], 0
    if held:
        _add_contexts(total, np.concatenate(words), np.concatenate(rows))
    vec = total.reshape(BUCKETS, DIM).astype(np.int64)
    at = np.flatnonzero(vec.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(vec[at, k]) for k in range(DIM))],
                                     names=["bucket", *(f"v{k}" for k in range(DIM))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of all buckets (zero if unseen), from every text of ``docs``."""
    dims = [f"v{k}" for k in range(DIM)]
    got = (docs.select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
           .mapInArrow(_contexts, "bucket long, " + ", ".join(f"{d} long" for d in dims))
           .groupBy("bucket").agg(*(F.sum(d).alias(d) for d in dims)).toPandas())
    out = np.zeros((BUCKETS, DIM))
    out[got["bucket"].to_numpy(dtype=int)] = got[dims].to_numpy(dtype=float)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the pooled vector of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            parts = []
            for i, j, word, row in _buckets(b.column(1)):
                n = np.bincount(row, minlength=j - i)
                x = np.zeros((j - i, 2 * DIM + 1), dtype=np.float32)
                full = np.flatnonzero(n)
                if len(full):
                    first = (np.cumsum(n) - n)[full]
                    got = v[word]
                    mean = np.add.reduceat(got, first, axis=0, dtype=np.float64) / n[full, None]
                    square = np.add.reduceat(got * got, first, axis=0, dtype=np.float64) / n[full, None]
                    x[full, :DIM] = mean
                    x[full, DIM:2 * DIM] = np.sqrt(np.maximum(square - mean**2, 0))
                x[:, -1] = np.log1p(n)
                parts.append(x)
            if parts:
                flat = np.concatenate(parts)
                lists = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], flat.ravel())
                yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "x"])

    shape = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("x", T.ArrayType(T.FloatType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pool, shape)


@dataclass
class Network:
    """sigmoid((tanh(z(x) w1 + b1) w2 + b2) / temperature) with standardised inputs z."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, on a grid of ratios."""
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.mean(np.logaddexp(0, -np.where(y > 0, 1, -1) * logit / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Adam on the log loss, in the order of the rows as shuffled by ``seed``."""
    dim = x.shape[1] if x.ndim == 2 else 2 * DIM + 1
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 10 or share in (0.0, 1.0):
        b2 = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return Network(np.zeros(dim), np.ones(dim), np.zeros((dim, 1)), np.zeros(1), np.zeros(1), b2)
    rng = np.random.default_rng(seed)
    aside = np.arange(len(y)) % 5 == 4
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    xs, ys = ((x - shift) / scale)[~aside], y[~aside].astype(float)
    p = [rng.normal(0, dim**-0.5, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(ys)), max(1, len(ys) // BATCH)):
            h = np.tanh(xs[at] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - ys[at]) / len(at)
            back = np.outer(err, p[2]) * (1 - h * h)
            grads = [xs[at].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ err + DECAY * p[2], np.array([err.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(shift, scale, p[0], p[1], p[2], float(p[3][0]))
    if aside.any():
        net.temperature = _temperature(net.logits(x[aside]), y[aside])
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, labelled: Column, max_rows: int = MAX_ROWS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``; ``labelled`` marks the rows whose labels may be learned from."""
    feats = store(pooled(docs, word_vectors(docs, text_col), id_col, text_col), "pooled")
    lab = (labels.filter("quality is not null and doc_id is not null")
           .groupBy("doc_id").agg(F.min("quality").alias("label")))
    may = docs.filter(labelled).select(F.col(id_col).alias("id")).distinct()
    picked = bounded_sample(may.join(lab, F.col("id") == F.col("doc_id")).select("id", "label"), "id", max_rows)
    # ids are sent to the features: max_rows of them at most
    rows = feats.join(F.broadcast(picked), "id").dropDuplicates(["id"]).orderBy(F.xxhash64(F.col("id").cast("string")), "id")
    got = rows.select("x", "label").toPandas()
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), 2 * DIM + 1)
    shared = docs.sparkSession.sparkContext.broadcast(fit(x, got["label"].to_numpy(dtype=float)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                flat = b.column(1).flatten().to_numpy().reshape(len(b), -1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(flat))], names=["id", "score"])

    return feats.mapInArrow(score, T.StructType([feats.schema["id"], T.StructField("score", T.DoubleType())]))

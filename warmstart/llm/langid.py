"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (1 to 3 characters of the lower-cased text, hashed to ``BUCKETS``) of all
learnable rows: every task sums its rows into one table per language and emits its non-zero cells, Spark adds
them up. The model is a languages x buckets matrix of log probabilities. Its size is checked
against ``MAX_MODEL_BYTES`` before it is collected and broadcast: it depends on the number of
languages alone, never on the corpus. Scoring sums a document's sparse n-gram counts times the matrix.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for every text if
there is nothing to learn from; equal likelihoods give the language first in code-point order; null labels
are not learned from; repeated rows get equal results; a very long text is a slice of its own; an empty table gives an empty
table; other columns are passed through, but for those named like the outputs, which the outputs replace.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmstart.llm import arrowtext as A
from warmstart.llm.common import fresh

BITS = 15
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
SMOOTHING = 0.1
MAX_MODEL_BYTES = 256 << 20
UNKNOWN = "und"
_MULT = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def _grams(cp: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each character; BUCKETS where it would leave its row."""
    h = np.full(len(cp), n * 0x27D4EB2F & 0xFFFFFFFF, dtype=np.uint32)
    for i in range(n):
        part = cp[i:] * _MULT[i]
        h[:len(cp) - i] ^= part
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(15)
    h = (h >> np.uint32(32 - BITS)).astype(np.int32)
    for k in range(1, n):
        at = ends - k
        h[at[at >= 0]] = BUCKETS
    return h


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        lang = b.column(0).to_pylist()
        for i, j, buf, offs in A.slices(b.column(1)):
            cp, offs = A.code_points(buf, offs)
            names = sorted(set(lang[i:j]))
            code = {x: k for k, x in enumerate(names)}
            row = np.repeat(np.array([code[x] for x in lang[i:j]]), np.diff(offs)) * (BUCKETS + 1)
            got = np.zeros(len(names) * (BUCKETS + 1), dtype=np.int64)
            for n in ORDERS:
                got += np.bincount(row + _grams(cp, offs[1:], n), minlength=len(got))
            for name, x in zip(names, got.reshape(len(names), -1)[:, :BUCKETS]):
                total[name] = total[name] + x if name in total else x.copy()
    for name, x in total.items():
        at = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(x[at])],
            names=["lang", "bucket", "n"])


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (BUCKETS + 1) x languages, the last row is zero
    prior: np.ndarray


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows with a label and a text."""
    known = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.lower(F.col(text_col).cast("string")).alias("text"))
    docs = known.groupBy("lang").count()
    n_langs = docs.count()
    if 4 * n_langs * (BUCKETS + 1) > MAX_MODEL_BYTES:
        raise ValueError(f"{n_langs} languages: the model passes {MAX_MODEL_BYTES} bytes")
    prior = {r["lang"]: r["count"] for r in docs.collect()}
    langs = sorted(prior)  # of str: code-point order
    counts = np.zeros((len(langs), BUCKETS))
    cells = (known.mapInArrow(_count, "lang string, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    code = {x: i for i, x in enumerate(langs)}
    counts[cells["lang"].map(code).to_numpy(dtype=int), cells["bucket"].to_numpy(dtype=int)] = cells["n"].to_numpy()
    p = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    logp = np.vstack([np.log(p).T, np.zeros((1, len(langs)))]).astype(np.float32)
    n = np.array([prior[x] for x in langs], dtype=float)
    return Model(langs, logp, np.log(n / n.sum()) if len(n) else n)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability (softmax of the mean log likelihood per
    character, sharpened by the square root of the length)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    body, letter, res = fresh(docs, "__low", "__letter", "__res")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            best, prob = np.zeros(len(b), dtype=np.int64), np.zeros(len(b))
            for i, j, buf, offs in A.slices(b.column(b.num_columns - 2)):
                cp, offs = A.code_points(buf, offs)
                size = np.diff(offs)
                full = np.flatnonzero(size)
                logl = np.zeros((j - i, len(m.langs)))
                if len(full) and m.langs:
                    for n in ORDERS:
                        part = m.logp[_grams(cp, offs[1:], n)]
                        logl[full] += np.add.reduceat(part, offs[:-1][full], axis=0, dtype=np.float64)
                    logl += m.prior
                    best[i:j] = logl.argmax(axis=1)
                    z = (logl - logl.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(size, 1))[:, None]
                    prob[i:j] = 1 / np.exp(z).sum(axis=1)
            ok = np.array(b.column(b.num_columns - 1).to_pylist(), dtype=bool) & bool(m.langs)
            name = [m.langs[k] if o else UNKNOWN for k, o in zip(best, ok)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], pa.array(name, pa.string()), pa.array(np.where(ok, prob, 0.0))],
                names=[*b.schema.names[:-2], lang_out, score_out])

    text = F.col(text_col).cast("string")
    ddl = docs.drop(lang_out, score_out).schema.add(lang_out, "string").add(score_out, "double")
    return (docs.drop(lang_out, score_out).withColumn(body, F.lower(text))
            .withColumn(letter, F.coalesce(text.rlike(r"\p{L}"), F.lit(False))).mapInArrow(score, ddl))


def keep_languages(docs: DataFrame, labelled: Column, min_score: float, text_col: str = "text",
                   lang_col: str = "lang") -> DataFrame:
    """``docs`` (same columns) without those of no language or of a too uncertain one.

    The model is learned from the rows of ``docs`` for which ``labelled`` holds."""
    pred, score = fresh(docs, "__lang_pred", "__lang_score")
    model = train(docs.filter(labelled), text_col, lang_col)
    found = predict(docs, model, text_col, pred, score)
    return found.filter((F.col(pred) != UNKNOWN) & (F.col(score) >= min_score)).select(*docs.columns)

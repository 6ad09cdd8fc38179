"""Periodic runs of words in whole texts, found by seed and extend on diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
``max(MIN_LENGTH, MIN_TIMES * q)`` words that cannot be extended on either side.

On the diagonal of lag q a run of that period is a stretch of at least ``max(24 - q, 2 * q)`` equal pairs of words.
Lags are taken by octave: up to 16, then up to 32, 64 and so on. For the octave up to k, every such stretch holds k
equal pairs at least, so k-grams are indexed (ranks by doubling, exact, no hashing) and same-document occurrence pairs are seeds.
As k is not below the period, no other occurrence lies between a run's first k-gram and the one a period later: pairs of
consecutive occurrences are enough, at most one seed per word and octave. Seeds that follow each other on one diagonal
count once; a table of the furthest position covered on each lag suppresses the others, and what is left is extended to both
sides, word by word in growing steps. If no k-gram repeats no longer one does, and the search ends.

The work is O(n log n) for n words, memory some arrays of n numbers and the distinct words.

Defined results: a null, empty or white-space text has no word and no run; null ids are carried through; repeated rows
get the same result; ties (several runs of the greatest exponent): smallest start, then period; an empty table gives an empty
table; very long texts are split into words piece by piece and looked at as a whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warmstart.llm import arrowtext as A
from warmstart.llm.words import texts, word_lists

MIN_LENGTH, MIN_TIMES = 24, 3
#: Words of the shortest seeds: max(24 - q, 2 q) is 16 at least.
SEED = 16

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def _ranks(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """A number for every word (equal for equal words) and the word of every number."""
    number: dict[bytes, int] = {}
    parts = [np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64) for words in word_lists(data)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), list(number)


def _double(gram: np.ndarray, k: int) -> tuple[np.ndarray, bool]:
    """Ranks of 2k-grams from those of k-grams, and whether any 2k-gram repeats."""
    if len(gram) <= k:
        return gram[:0], False
    distinct, rank = np.unique(gram[:-k] * (int(gram.max()) + 1) + gram[k:], return_inverse=True)
    return rank, len(distinct) < len(rank)


def _right(w: np.ndarray, q: int, i: int) -> int:
    """The first place from i on where the word differs from the one q later."""
    step = 64
    while i + q < len(w):
        m = min(step, len(w) - q - i)
        differ = w[i:i + m] != w[i + q:i + q + m]
        if differ.any():
            return i + int(differ.argmax())
        i, step = i + m, 2 * step
    return i


def _left(w: np.ndarray, q: int, i: int) -> int:
    """The first place of the stretch of equal pairs that ends before i."""
    step = 64
    while i > 0:
        m = min(step, i)
        differ = (w[i - m:i] != w[i - m + q:i + q])[::-1]
        if differ.any():
            return i - int(differ.argmax())
        i, step = i - m, 2 * step
    return i


def _smallest(w: np.ndarray, a: int, q: int) -> bool:
    """True if q is the smallest period of a run that starts at a (it has three periods, so a smaller one divides q)."""
    n, f = q, 2
    while n > 1:
        f = f if f * f <= n else n
        if n % f == 0:
            p = q // f
            if np.array_equal(w[a:a + q], w[a + p:a + p + q]):
                return False
            while n % f == 0:
                n //= f
        f += 1
    return True


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of numbers, by start, then period."""
    gram, k, repeats, found = w, 1, len(w) >= MIN_LENGTH, []
    covered: dict[int, int] = {}  # lag: end of the last stretch on its diagonal
    while repeats:
        gram, repeats = _double(gram, k)
        k *= 2
        if k < SEED or not repeats:
            continue
        low = 0 if k == SEED else k // 2
        if MIN_TIMES * (low + 1) > len(w):
            break
        order = np.argsort(gram, kind="stable")
        same = gram[order[1:]] == gram[order[:-1]]
        at, lag = order[:-1][same], (order[1:] - order[:-1])[same]
        ok = (lag > low) & (lag <= k)
        at, lag = at[ok], lag[ok]
        by = np.lexsort((at, lag))
        at, lag = at[by], lag[by]
        head = np.ones(len(at), dtype=bool)
        head[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        for i, q in zip(at[head].tolist(), lag[head].tolist()):
            if i < covered.get(q, 0):
                continue
            a, b = _left(w, q, i), _right(w, q, i + k)
            covered[q] = b
            if b + q - a >= max(MIN_LENGTH, MIN_TIMES * q) and _smallest(w, a, q):
                found.append((a, b + q - a, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w: np.ndarray, found: list[tuple[int, int, int]]) -> np.ndarray:
    """The places of the words that stay: those that no run holds after its first period."""
    stay = np.ones(len(w), dtype=bool)
    for start, length, q in found:
        stay[start + q:start + length] = False
    return np.flatnonzero(stay)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, _, _ in A.slices(b.column(1)):
            size, every, best, text = [], [], [], []
            for data in texts(b.column(1).slice(i, j - i)):
                w, words = _ranks(data)
                found = runs(w)
                size.append(len(w))
                every.append([dict(zip(("start", "length", "period"), r)) for r in found])
                best.append(dict(zip(("start", "length", "period"), max(
                    found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])))) if found else None)
                text.append(b" ".join([words[x] for x in w[collapsed(w, found)].tolist()]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(every, pa.list_(_RUN)), pa.array(best, _RUN),
                 pa.array(text, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "strongest", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, strongest, collapsed), a row for every row of ``docs``.

    ``runs`` are structs (start, length, period) by start, then period; ``strongest`` is the one with the greatest
    length / period (null without runs); ``collapsed`` is the text with one period of every run, joined by spaces."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shape = T.StructType([T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
                          T.StructField("strongest", RUN), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(_scan, shape)

"""Quality rules: text statistics, and a decision list learned from labelled ones.

``with_statistics`` counts words, symbols, repeats and so on in one Arrow pass over whole texts.
``learn`` grows an ordered list of threshold conjunctions by sequential covering: each rule is grown
on two thirds of the rows still uncovered by the condition with the best FOIL gain, then its last conditions
are pruned while that helps on the other third; the list ends when a new rule is not precise
enough. ``expression`` turns the list into one ordered Spark ``when`` chain, so applying it needs no Python.

Learning uses a bounded sample: at most ``MAX_ROWS`` labelled rows, those with the smallest hash of their
id (``max_rows`` of ``labelled_statistics``). Applying covers all rows.

Defined results: a null text counts as empty (all statistics 0); null labels are not learned from, a doc_id with
several labels takes the smallest; without rows of both labels the list is empty and keeps everything; ties
between conditions go to the first in the order of ``FEATURES`` and thresholds; repeated rows get equal
results; a very long text is a slice of its own; an empty table gives an empty table; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warmstart.llm import arrowtext as A
from warmstart.llm.common import bounded_sample, fresh

MAX_ROWS = 40_000
WINDOW = 5
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines",
         "n_distinct_words"]
#: What conditions test, as (numerator, denominator); a denominator counts as 1 at least.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
    "words": ("n_words", None),
}
MAX_CONDITIONS, MAX_RULES, CUTS = 4, 24, 32
MIN_COVER, MIN_PRECISION = 8, 0.7

_IS_SYMBOL = np.zeros(256, dtype=np.int64)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = 1
_IS_MARK = (A.KINDS == A.MARK).astype(np.int64)
_IS_UPPER = np.zeros(256, dtype=np.int64)
_IS_UPPER[65:91] = 1


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offs[1:]] - sums[offs[:-1]]


def _pair_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct (a, b), equal for equal pairs only."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def _repeated(words: list[bytes]) -> tuple[int, int]:
    """(distinct words, words in a window of WINDOW that the text holds twice or more)."""
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    n = len(x) - WINDOW + 1
    if n < 2 or len(ids) == len(words):
        return len(ids), 0
    # a window found twice starts with a word found twice
    two = _pair_ids(x[:-1], x[1:])
    four = _pair_ids(two[:-2], two[2:])
    five = _pair_ids(four[:n], x[4:])
    hit = np.bincount(five)[five] > 1
    covered = np.zeros(len(x) + 1, dtype=np.int64)
    covered[:n] += hit
    covered[WINDOW:] -= hit
    return len(ids), int((np.cumsum(covered)[:-1] > 0).sum())


def _statistics(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {s: [] for s in STATS}
        for _, _, buf, offs in A.slices(b.column(b.num_columns - 1)):
            heads = (buf & 0xC0) != 0x80  # of code points
            out["word_chars"].append(_per_row(heads & ~A.SPACES[buf], offs))
            for stat, flag in (("n_symbols", _IS_SYMBOL), ("n_upper", _IS_UPPER), ("n_marks", _IS_MARK)):
                out[stat].append(_per_row(flag[buf], offs))
            raw, rows = buf.tobytes(), []
            for s, e in zip(offs[:-1], offs[1:]):
                text = raw[s:e]
                words = text.split()
                lines = [x for x in text.split(b"\n") if x.strip()]
                rows.append((len(words), len(lines) - len(set(lines)), len(lines), *_repeated(words)))
            for stat, x in zip(("n_words", "n_dup_lines", "n_lines", "n_distinct_words", "n_repeat_words"), zip(*rows)):
                out[stat].append(np.array(x, dtype=np.int64))
        if out["n_words"]:
            stats = pa.StructArray.from_arrays([pa.array(np.concatenate(out[s]), pa.int64()) for s in STATS], names=STATS)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], stats], names=[*b.schema.names[:-1], name])


def with_statistics(rows: DataFrame, text: Column, out: str) -> DataFrame:
    """``rows`` with the statistics of ``text`` as a struct column ``out``, which must be a new name."""
    (t,) = fresh(rows, "__text")
    stats = T.StructType([T.StructField(s, T.LongType()) for s in STATS])
    return (rows.withColumn(t, text.cast("string"))
            .mapInArrow(lambda batches: _statistics(batches, out), T.StructType([*rows.schema.fields, T.StructField(out, stats)])))


def feature(name: str, stats: Column) -> Column:
    a, b = FEATURES[name]
    if b is None:
        return stats[a].cast("double")
    return stats[a] / F.greatest(stats[b], F.lit(1))


def labelled_statistics(docs: DataFrame, labels: DataFrame, labelled: Column, max_rows: int = MAX_ROWS,
                        text_col: str = "text") -> DataFrame:
    """(label, feature ...) of at most ``max_rows`` rows of ``docs`` for which ``labelled`` holds and that have
    a label. The ids are picked first, so only their texts are looked at; they are few enough to broadcast."""
    lab = (labels.filter("quality is not null and doc_id is not null")
           .groupBy("doc_id").agg(F.min("quality").alias("label")))
    picked = bounded_sample(docs.filter(labelled).select("doc_id").distinct().join(lab, "doc_id"), "doc_id", max_rows)
    texts = (docs.select("doc_id", F.col(text_col).alias("text"))
             .join(F.broadcast(picked.select("doc_id", "label")), "doc_id").select("doc_id", "label", "text"))
    stats = with_statistics(texts, F.col("text"), "stats")
    # repeated rows of an id are looked at once
    rows = stats.select("doc_id", "label", *(feature(f, F.col("stats")).alias(f) for f in FEATURES))
    return rows.dropDuplicates(["doc_id"]).orderBy("doc_id").drop("doc_id")


Rule = list[tuple[str, str, float]]  # conditions (feature, "<=" or ">", threshold)


def _match(x: dict[str, np.ndarray], rule: Rule, n: int) -> np.ndarray:
    ok = np.ones(n, dtype=bool)
    for f, op, t in rule:
        ok &= x[f] <= t if op == "<=" else x[f] > t
    return ok


def _grow(x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    rule: Rule = []
    live = np.ones(len(y), dtype=bool)
    while len(rule) < MAX_CONDITIONS and y[live].any() and not y[live].all():
        p0, n0 = y[live].sum(), live.sum()
        best, gain = None, 0.0
        for f in FEATURES:
            for t in np.unique(np.quantile(x[f][live], np.linspace(0, 1, CUTS + 1)[1:-1])):
                for op in ("<=", ">"):
                    hit = live & (x[f] <= t if op == "<=" else x[f] > t)
                    p, n = y[hit].sum(), hit.sum()
                    if n >= MIN_COVER and p and (g := p * (np.log2(p / n) - np.log2(p0 / n0))) > gain + 1e-9:
                        best, gain = (f, op, float(t)), g
        if best is None:
            break
        rule.append(best)
        live &= _match(x, [best], len(y))
    return rule


def learn(sample) -> list[Rule]:
    """Rules for the rows with label 0, from a pandas frame (label, feature ...)."""
    x = {f: sample[f].to_numpy(dtype=float) for f in FEATURES}
    y = sample["label"].to_numpy() == 0
    third = np.arange(len(y)) % 3 == 2
    left, rules = np.ones(len(y), dtype=bool), []
    while len(rules) < MAX_RULES and y[left].any():
        g, p = left & ~third, left & third
        rule = _grow({f: v[g] for f, v in x.items()}, y[g])

        def worth(r: Rule) -> float:
            hit = _match({f: v[p] for f, v in x.items()}, r, int(p.sum()))
            return (y[p][hit].sum() - (~y[p][hit]).sum()) / max(1, hit.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = left & _match(x, rule, len(y))
        if not rule or hit.sum() < MIN_COVER or y[hit].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def expression(rules: list[Rule], stats: Column) -> Column:
    """Number of the first rule that fits, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for f, op, t in rule:
            cond &= feature(f, stats) <= t if op == "<=" else feature(f, stats) > t
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return F.lit(0) if out is None else out.otherwise(0)


def describe(rules: list[Rule]) -> list[str]:
    """The list in words, in order."""
    return [" and ".join(f"{f} {op} {t:g}" for f, op, t in r) for r in rules]


def base_failed(stats: Column) -> Column:
    """Fixed rules: fewer than 10 words, or over a fifth of the words in repeated windows."""
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with the struct ``out`` and columns base_failed, rule, kept beside it, in a struct ``out``_verdict."""
    st = with_statistics(docs, F.col(text_col), out)
    c = F.col(out)
    failed, rule = base_failed(c), expression(rules, c)
    return st.withColumn(f"{out}_verdict", F.struct(failed.alias("base_failed"), rule.alias("rule"),
                                                    (~failed & (rule == 0)).alias("kept")))


def drop_junk(docs: DataFrame, labels: DataFrame, labelled: Column, text_col: str = "text") -> DataFrame:
    """``docs`` (same columns) without those that fail the base rules or fit a learned rule."""
    rules = learn(labelled_statistics(docs, labels, labelled, text_col=text_col).toPandas())
    (out,) = fresh(docs, "__stats")
    return judge(docs, rules, text_col, out).filter(F.col(f"{out}_verdict")["kept"]).select(*docs.columns)

"""Hand cases for the title functions (C1-C5, C13, C14) and the similarity kernels."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import plain_strings as plain
from warmstart.functions import similarity as sim
from warmstart.functions import text as tx


def _one(spark, fn, value):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize("raw,expected", [("tom & jerry!", "tom and jerry"), ("ama(c)lie", "amelie"),
                                          ("a  b   c", "a b c"), ("x.(y)\nz", "x.(y)\nz")])
def test_clean_special(spark, raw, expected):
    assert _one(spark, tx.clean_special, raw) == expected


@pytest.mark.parametrize("raw,expected", [("Heat (1995)", "heat"), ("Heat", "heat"), ("Été", "été"),
                                          ("Amélie & Co (2001)", "amelie and co")])
def test_raw_title(spark, raw, expected):
    assert _one(spark, tx.raw_title, raw) == expected


@pytest.mark.parametrize("raw,expected", [("Seven (a.k.a. Se7en) (1995)", "seven (1995)"),
                                          ("Heat (1995)", "heat (1995)"), ("Heat", "heat")])
def test_raw_title_year(spark, raw, expected):
    assert _one(spark, tx.raw_title_year, raw) == expected


def test_unaccent_table_is_rule_built():
    assert len(tx.ACCENT_FROM) == len(tx.ACCENT_TO)
    pairs = dict(zip(tx.ACCENT_FROM, tx.ACCENT_TO))
    assert pairs["é"] == "e" and pairs["ñ"] == "n" and pairs["ø"] == "o" and pairs["ç"] == "c"


def test_unaccent_multi(spark):
    assert _one(spark, lambda c: tx.unaccent(F.lower(c)), "Straße Æon Œuvre") == "strasse aeon oeuvre"


def test_scenario_and_run_key(spark):
    df = spark.createDataFrame([("PCA", "random", "pca", "m", 0.5, 1), (None, "random", None, "m", 1.0, 2)],
                               "src string, init string, init2 string, method string, lim double, split int")
    rows = df.select(tx.scenario_label(F.col("src"), F.col("init")).alias("s"),
                     tx.run_key(F.col("init2"), F.col("method"), F.col("lim"), F.col("split")).alias("k")).collect()
    assert rows[0]["s"] == "PCA to Random" and rows[1]["s"] == "Baseline"
    assert rows[0]["k"] == "pca\tm\t0.5\t1" and rows[1]["k"] == "None\tm\t1.0\t2"


def test_plain_hand_cases():
    assert abs(plain.cosine("heat 1995", "heat") - 0.707107) < 1e-6
    assert plain.cosine("", "anything") == 0.0
    assert 2 * plain.lcs("abc", "abd") == 4
    assert plain.levenshtein_similarity("abc", "abd") == 2


def _strings(seed=5, n=60, longest=200):
    rnd = random.Random(seed)
    size = lambda: rnd.choice([0, 1, 2, 30, 63, 64, 65, 127, 128, 129, rnd.randint(0, longest)])
    return ["".join(rnd.choice("ab cé(1)日") for _ in range(size())) for _ in range(n)]


def test_pair_kernels_equal_plain_versions():
    strs = _strings()
    a, b = [x for x in strs for _ in strs], strs * len(strs)
    x, y, at = sim.Strings(a), sim.Strings(b), np.arange(len(a))
    assert sim.pair_lcs(x, at, y, at).tolist() == [plain.lcs(p, q) for p, q in zip(a, b)]
    assert sim.pair_levenshtein(x, at, y, at).tolist() == [plain.levenshtein(p, q) for p, q in zip(a, b)]
    assert np.allclose(sim.pair_jaro(x, at, y, at), [plain.jaro(p, q) for p, q in zip(a, b)], atol=1e-12)
    assert np.allclose(sim.pair_jaro_winkler(x, at, y, at), [plain.jaro_winkler(p, q) for p, q in zip(a, b)], atol=1e-12)


def test_long_pairs_in_small_passes(monkeypatch):
    monkeypatch.setattr(sim, "PAIRS", 32)
    monkeypatch.setattr(sim, "TABLE", 1 << 10)
    strs = _strings(6, 25, 700)
    a, b = [x for x in strs for _ in strs], strs * len(strs)
    x, y, at = sim.Strings(a), sim.Strings(b), np.arange(len(a))
    assert sim.pair_lcs(x, at, y, at).tolist() == [plain.lcs(p, q) for p, q in zip(a, b)]
    assert sim.pair_levenshtein(x, at, y, at).tolist() == [plain.levenshtein(p, q) for p, q in zip(a, b)]
    assert np.allclose(sim.pair_jaro(x, at, y, at), [plain.jaro(p, q) for p, q in zip(a, b)], atol=1e-12)


@pytest.mark.parametrize("tile", [3, 32])
def test_extremes_over_a_block_equal_all_pairs(monkeypatch, tile):
    monkeypatch.setattr(sim, "TILE", tile)
    strs = _strings(7, 70, 80)
    strs[10:20] = [strs[0] + "x"] * 10
    src, blk = sim.Strings(strs[:30]), sim.Block(strs[30:])
    none = np.full(30, -1)
    lcs = np.array([[plain.lcs(a, b) for b in strs[30:]] for a in strs[:30]])
    lev = np.array([[plain.levenshtein_similarity(a, b) for b in strs[30:]] for a in strs[:30]])
    most = sim.greatest(src, blk, none, none)
    assert most[0].tolist() == lcs.max(1).tolist() and most[1].tolist() == lev.max(1).tolist()
    assert (most[2] >= lcs.min(1)).all()
    fewest = sim.least(src, blk)
    assert fewest[0].tolist() == lcs.min(1).tolist() and fewest[1].tolist() == lev.min(1).tolist()
    seeded = sim.greatest(src, blk, lcs.max(1), np.full(30, 1 << 40))
    assert seeded[0].tolist() == lcs.max(1).tolist() and (seeded[1] == 1 << 40).all()


def test_extremes_of_empty_strings():
    blk = sim.Block(["", ""])
    one = sim.greatest(sim.Strings(["abc", ""]), blk, np.full(2, -1), np.full(2, -1))
    assert one[0].tolist() == one[1].tolist() == [0, 0]
    assert [x.tolist() for x in sim.least(sim.Strings(["abc", ""]), blk)] == [[0, 0], [0, 0]]


def test_spark_levenshtein_agrees_with_kernel(spark):
    pairs = [("kitten", "sitting"), ("", "abc"), ("été", "ete"), ("flaw", "lawn"), ("a" * 300, "a" * 200 + "b" * 100), (None, "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(sim.levenshtein_similarity(F.col("a"), F.col("b")).alias("l"),
                    sim.indel_similarity(F.col("a"), F.col("b")).alias("i")).collect()
    for (a, b), row in zip(pairs, got):
        assert row["l"] == (None if a is None else plain.levenshtein_similarity(a, b))
        assert row["i"] == 2 * plain.lcs(a or "", b)


def test_registry_rejects_unknown():
    with pytest.raises(ValueError):
        sim.metric("hamming")
    assert sim.metric("levenshtein") is not None

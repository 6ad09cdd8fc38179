"""Smallest and greatest similarities over all targets (W5, W7): every pair, without lists of pairs."""

import numpy as np
import plain_strings as plain
import pytest
from warmstart.functions import similarity as sim
from warmstart.operators import matching as mt


def _brute(src, tgt):
    src, tgt = [s or "" for s in src], [t or "" for t in tgt]
    lcs = np.array([[plain.lcs(a, b) for b in tgt] for a in src])
    lev = np.array([[plain.levenshtein_similarity(a, b) for b in tgt] for a in src])
    return [f(axis=1).tolist() for x in (lcs, lev) for f in (x.min, x.max)]


@pytest.mark.parametrize("tile, cells, table", [(512, 1 << 14, 1 << 21), (5, 12, 1 << 21), (7, 64, 200)])
def test_extremes_evaluate_all_pairs_without_lists(monkeypatch, tile, cells, table):
    def listed(*_):
        raise AssertionError("a list of pairs")

    for name, value in (("TILE", tile), ("CELLS", cells), ("TABLE", table), ("pair_lcs", listed), ("pair_levenshtein", listed)):
        monkeypatch.setattr(sim, name, value)
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdé 19\U0001f600"), int(rng.integers(0, n))))
    src = [word(16) for _ in range(20)] + ["", None, "a" * 63, "b" * 64, "ab" * 33, word(200), "xyz", "ab1 " * 50]
    tgt = [word(16) for _ in range(15)] + ["", None, "a" * 64, "ba" * 40, word(150), "é" * 129, "qqq"]
    got = sim.extremes(sim.Strings(src), sim.Block(tgt))
    assert [x.tolist() for x in got] == _brute(src, tgt)
    some = [t for t in tgt if t]
    assert [x.tolist() for x in sim.extremes(sim.Strings(src), sim.Block(some))] == _brute(src, some)


def test_extremes_without_targets_or_characters():
    big = np.iinfo(np.int64).max
    assert [x.tolist() for x in sim.extremes(sim.Strings(["ab"]), sim.Block([]))] == [[big], [-1], [big], [-1]]
    assert [x.tolist() for x in sim.extremes(sim.Strings(["ab", ""]), sim.Block(["", None]))] == [[0, 0]] * 4
    assert all(len(x) == 0 for x in sim.extremes(sim.Strings([]), sim.Block(["a"])))


def test_pairs_of_blocks_and_chunks_are_not_coalesced(spark):
    src = spark.range(300).selectExpr("id as sid", "concat('title ', id) as key")
    tgt = spark.range(90).selectExpr("id as tid", "concat('other ', id * 7) as key")
    plan = mt.all_target_stats(src, tgt, block_rows=30)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("REPARTITION_BY_NUM") == 2
    got = sorted(map(tuple, mt.all_target_stats(src, tgt, block_rows=30).collect()))
    lcs_min, lcs_max, lev_min, lev_max = _brute([f"title {i}" for i in range(300)], [f"other {i * 7}" for i in range(90)])
    assert got == [(i, lev_min[i], lev_max[i], 2 * lcs_min[i], 2 * lcs_max[i]) for i in range(300)]

"""What decides a fuzzy match at size: candidates that share frequent tokens only, sources without a match, dominated pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from warmstart.functions import similarity as sim
from warmstart.operators import matching as mt
from warmstart.plans import catalog

SF = "/root/testdata/sf0.001"


def _tokens(spark, titles, id_col):
    rows = [(k, " ".join(t)) for k, t in enumerate(titles)]
    return mt.token_table(spark.createDataFrame(rows, f"{id_col} long, key string"), id_col)


def _cosine(x, y):
    a, b = ({w: t.count(w) for w in t} for t in (x, y))
    return sum(n * b.get(w, 0) for w, n in a.items()) / np.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def test_frequent_tokens_together_pair_nothing(spark):
    src = [["brand", "red", "and", "promo"]] * 40 + [["and", "promo", "old", "rod"]] * 100
    tgt = [["brand", "red", "promos", "steels"]] * 40 + [["promos", "steels", "big", "bolt"]] * 100
    assert mt.candidate_pairs(_tokens(spark, src, "sid"), _tokens(spark, tgt, "tid"), 0.583).count() == 0


@pytest.mark.parametrize("crowded", [0, 1, 16])
def test_no_candidate_is_lost_at_any_depth(spark, crowded):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(9)]
    src, tgt = ([[words[int(9 * rng.random() ** 2)] for _ in range(rng.integers(1, 11))] for _ in range(n)] for n in (60, 50))
    got = {(r["sid"], r["tid"]) for r in mt.candidate_pairs(_tokens(spark, src, "sid"), _tokens(spark, tgt, "tid"), 0.583, crowded).collect()}
    want = {(i, j) for i, x in enumerate(src) for j, y in enumerate(tgt) if _cosine(x, y) >= 0.583}
    assert want and want <= got


def test_a_dominated_pair_needs_no_smallest_values(spark):
    a = spark.createDataFrame([(1, "red widget brand7 promo 12 (1999)")], "item_id long, title string")
    b = spark.createDataFrame([(10, "red widget brand7 promo 12 b (1999)"), (11, "red widget brand7 promo 34 (1999)"), (12, "zzz")], "item_id long, title string")
    rows = mt.certified_pairs(a, b, (3, 0, 0, 0, 2)).select("tid", "decided").collect()
    assert [(r["tid"], r["decided"]) for r in rows] == [(10, True)]
    assert [mt.match_fuzzy(a, b, (3, 0, 0, 0, 2), stats=s).collect()[0]["target_item"] for s in ("certified", "all")] == [10, 10]


def test_a_part_of_the_targets_rejects_sources_and_changes_no_match(spark):
    rng = np.random.default_rng(5)
    words = ["red", "blue", "old", "gear", "bolt", "rods", "small", "large"]
    title = lambda: " ".join(rng.choice(words, int(rng.integers(2, 6))).tolist()) + f" ({int(rng.integers(1990, 1994))})"
    a, b = (spark.createDataFrame([(at + k, title()) for k in range(n)], "item_id long, title string") for at, n in ((0, 70), (1000, 120)))
    for weights in ((3, 1, 0, 0, 1), (3, 0, 0, 0, 2)):
        got = mt.best_match(mt.certified_pairs(a, b, weights, block_rows=30)).filter(F.round("score", 4) > 0.75)
        want = mt.match_fuzzy(a, b, weights, stats="all").select(F.col("source_item").alias("sid"), F.col("target_item").alias("tid"), "score")
        got, want = ({(r["sid"], r["tid"], round(r["score"], 9)) for r in t.collect()} for t in (got, want))
        assert got == want and want


def test_greatest_stops_above_a_limit():
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcd 1"), int(rng.integers(0, 30))))
    src, tgt = [word() for _ in range(80)], [word() for _ in range(300)]
    s, blk = sim.Strings(src), sim.Block(tgt)
    none, far = np.full(s.n, -1), np.full(s.n, 1 << 40)
    lcs, lev, _ = sim.greatest(s, blk, none, none)
    limit = lev - rng.integers(0, 4, s.n)
    got = sim.greatest(s, blk, none, none, far, limit)
    assert (got[1] <= lev).all() and (got[1] >= np.minimum(lev, limit)).all()
    exact = lev <= limit
    assert np.array_equal(got[0][exact], lcs[exact]) and np.array_equal(got[1][exact], lev[exact])
    assert ((got[1] > limit) == (lev > limit)).all()


def test_catalogs_are_pinned_before_the_exact_stages(spark):
    for side in catalog._left(spark, SF):
        assert "p_brand" not in side._jdf.queryExecution().optimizedPlan().toString()

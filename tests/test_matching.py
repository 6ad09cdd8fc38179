"""Catalog matching cascade (J1-J6, W5, W7, A8) against a brute-force evaluation of the
reference's definition on the sf0.001 catalogs (every source against every target)."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import plain_strings as plain
from tests.conftest import SF
from warmstart.functions import similarity as sim
from warmstart.functions import text as tx
from warmstart.operators import matching as mt
from warmstart.sources import fixtures as fx


def _keys(df):
    c = F.col("title")
    return {r["item_id"]: r for r in df.select("item_id", "title", tx.raw_title(c).alias("raw"),
                                                  tx.raw_title_year(c).alias("ry")).collect()}


def brute_force(a_rows, b_rows, weights=(3, 1, 0, 0, 1), thr=0.75):
    out = {}
    a_ids, b_ids = sorted(a_rows), sorted(b_rows)
    # stage 1 and 2: equi-joins; every row that joined leaves the pool
    for stage, key in ((1, "title"), (2, "raw")):
        by_key = {}
        for t in b_ids:
            by_key.setdefault(b_rows[t][key], []).append(t)
        hit_a, hit_b = set(), set()
        for s in a_ids:
            ts = by_key.get(a_rows[s][key], [])
            if ts:
                out[s] = (min(ts), stage)
                hit_a.add(s)
                hit_b.update(ts)
        a_ids = [s for s in a_ids if s not in hit_a]
        b_ids = [t for t in b_ids if t not in hit_b]
    if not b_ids:
        return out
    wc, wi, _, _, wl = weights
    for s in a_ids:
        x = a_rows[s]["ry"]
        cos = np.array([plain.cosine(x, b_rows[t]["ry"]) for t in b_ids])
        ind = np.array([2 * plain.lcs(x, b_rows[t]["ry"]) for t in b_ids], dtype=float)
        lev = np.array([plain.levenshtein_similarity(x, b_rows[t]["ry"]) for t in b_ids], dtype=float)

        def scale(v):
            return (v - v.min()) / (v.max() - v.min()) if v.max() > v.min() else np.zeros_like(v)

        score = (wc * cos + wi * scale(ind) + wl * scale(lev)) / sum(weights)
        k = int(np.argmax(score))
        if round(score[k], 4) > thr:
            out[s] = (b_ids[k], 3)
    return out


@pytest.fixture(scope="module")
def cascade(spark):
    a, b = fx.catalog_a(spark, SF), fx.catalog_b(spark, SF)
    return {r["source_item"]: (r["target_item"], r["stage"]) for r in mt.match_items(a, b).collect()}


def test_cascade_equals_brute_force(spark, cascade):
    a, b = fx.catalog_a(spark, SF), fx.catalog_b(spark, SF)
    assert cascade == brute_force(_keys(a), _keys(b))
    stages = [v[1] for v in cascade.values()]
    assert stages.count(1) == 50 and stages.count(2) == 50 and stages.count(3) == 50


def test_candidates_mode_is_a_restriction(spark, cascade):
    # min/max over candidates only: stages 1-2 unchanged; stage 3 accepts only true candidates
    a, b = fx.catalog_a(spark, SF), fx.catalog_b(spark, SF)
    approx = {r["source_item"]: (r["target_item"], r["stage"])
              for r in mt.match_items(a, b, stats="candidates").collect()}
    assert {k: v for k, v in approx.items() if v[1] < 3} == {k: v for k, v in cascade.items() if v[1] < 3}
    assert all(cascade.get(k) == v for k, v in approx.items() if v[1] == 3)


def test_prefix_filter_keeps_every_pair_above_bound(spark):
    a, b = fx.catalog_a(spark, SF), fx.catalog_b(spark, SF)
    sk = a.select(F.col("item_id").alias("sid"), tx.raw_title_year(F.col("title")).alias("key"))
    tk = b.select(F.col("item_id").alias("tid"), tx.raw_title_year(F.col("title")).alias("key"))
    ts, tt = mt.token_table(sk, "sid"), mt.token_table(tk, "tid")
    theta = 0.3
    cands = {(r["sid"], r["tid"]) for r in mt.candidate_pairs(ts, tt, theta).collect()}
    srows, trows = sk.collect(), tk.collect()
    for s in srows:
        for t in trows:
            if plain.cosine(s["key"], t["key"]) >= theta:
                assert (s["sid"], t["tid"]) in cands


def test_minmax_stats_blocked_equals_single_block(spark):
    a, b = fx.catalog_a(spark, SF), fx.catalog_b(spark, SF)
    sk = a.select(F.col("item_id").alias("sid"), tx.raw_title_year(F.col("title")).alias("key"))
    tk = b.select(F.col("item_id").alias("tid"), tx.raw_title_year(F.col("title")).alias("key"))
    one = sorted(map(tuple, mt.all_target_stats(sk, tk).collect()))
    many = sorted(map(tuple, mt.all_target_stats(sk, tk, block_rows=37).collect()))
    assert one == many


def test_empty_leftover_targets_give_no_stage3(spark):
    a = fx.catalog_a(spark, SF)
    m = mt.match_items(a, a.select("item_id", "title"))
    assert m.filter("stage = 3").count() == 0
    assert m.count() == a.count()


def test_previous_mapping_kept_and_skipped(spark):
    a, b = fx.catalog_a(spark, SF), fx.catalog_b(spark, SF)
    prev = spark.createDataFrame([(0, 1000001)], "source_item long, target_item long")
    m = {r["source_item"]: (r["target_item"], r["stage"]) for r in mt.match_items(a, b, previous=prev).collect()}
    assert m[0] == (1000001, 0)
    assert all(v[0] != 1000001 for k, v in m.items() if k != 0)


def test_coverage_and_solve(spark):
    a, b = fx.catalog_a(spark, SF), fx.catalog_b(spark, SF)
    m = mt.match_items(a, b, fuzzy=False)
    cov = mt.mapping_coverage(m, b).first()
    assert cov["n_mapped"] == 100 and cov["coverage"] == 50.0
    idx_a = a.select("item_id").withColumn("idx", F.col("item_id") * 2)
    idx_b = b.select("item_id").filter("item_id % 2 = 0").withColumn("idx", F.col("item_id"))
    solved = mt.solve_mapping(m, idx_a, idx_b)
    assert solved.filter("target_item % 2 = 1").count() == 0


def test_one_to_one_keeps_best_source(spark):
    a = spark.createDataFrame([(1, "red widget brand7 (1999)"), (2, "red widget brand7 x (1999)")],
                              "item_id long, title string")
    b = spark.createDataFrame([(10, "red widget brand7 z (1999)"), (11, "blue bolt (2001)")],
                              "item_id long, title string")
    many = {r["source_item"]: r["target_item"] for r in mt.match_items(a, b).collect()}
    one = {r["source_item"]: r["target_item"] for r in mt.match_items(a, b, one_to_one=True).collect()}
    assert set(many.values()) == {10} and len(many) == 2
    assert list(one.values()) == [10] and len(one) == 1


def test_normalize_all_titles(spark):
    df = spark.createDataFrame([("Été & Co",)], "t string")
    row = df.select(tx.raw_title(F.col("t")).alias("a"), tx.raw_title(F.col("t"), normalize_all=True).alias("b")).first()
    assert row["a"] == "été & co" and row["b"] == "ete and co"


def _titles(spark, seed, n, item):
    """Random titles over few words, so that many pairs share tokens and score near the threshold."""
    import random

    rng = random.Random(seed)
    words = ["red", "blue", "old", "new", "widget", "gear", "bolt", "rod", "small", "large"]
    rows = [(item + i, " ".join(rng.choice(words) + rng.choice(["", "", "s"]) for _ in range(rng.randint(1, 6)))
             + rng.choice(["", f" ({1990 + rng.randint(0, 2)})"])) for i in range(n)]
    return spark.createDataFrame(rows, "item_id long, title string")


@pytest.mark.parametrize("weights", [(3, 1, 0, 0, 1), (3, 0, 0, 0, 2), (3, 2, 0, 0, 0), (4, 1, 1, 0, 1), (1, 0, 0, 0, 0)])
def test_certified_match_equals_full_statistics(spark, weights):
    a, b = _titles(spark, 1, 120, 0), _titles(spark, 2, 90, 1000)
    for threshold in (0.6, 0.75, 0.9):
        if mt.cosine_bound(weights, threshold) <= 0:
            continue
        got, want = ({(r["source_item"], r["target_item"], round(r["score"], 9))
                      for r in mt.match_fuzzy(a, b, weights, threshold, stats=s).collect()} for s in ("certified", "all"))
        assert got == want
        if threshold < 0.9:
            assert want


def test_certified_match_with_constant_statistics(spark):
    """One target: every metric is constant, so the scaled terms are 0 and nothing can be accepted on the cosine's weight alone."""
    a = spark.createDataFrame([(1, "red widget brand7 (1999)")], "item_id long, title string")
    b = spark.createDataFrame([(10, "red widget brand7 x (1999)")], "item_id long, title string")
    assert mt.match_fuzzy(a, b).collect() == mt.match_fuzzy(a, b, stats="all").collect() == []


def test_few_sources_need_the_smallest_values(spark):
    a, b = fx.catalog_a(spark, SF), fx.catalog_b(spark, SF)
    _, a1, b1 = mt.match_exact(a, b)
    _, a2, b2 = mt.match_raw_title(a1, b1)
    rows = mt.certified_pairs(a2, b2).select("sid", "decided").distinct().collect()
    assert sum(r["decided"] for r in rows) >= 50


def test_greatest_equals_brute_force_with_and_without_seeds():
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdé 19"), int(rng.integers(0, 14))))
    src, tgt = [word() for _ in range(150)] + ["", None], [word() for _ in range(90)] + [""]
    s, blk = sim.Strings(src), sim.Block(tgt)
    i, j = (x.ravel() for x in np.indices((s.n, blk.strings.n)))
    lcs = sim.pair_lcs(s, i, blk.strings, j).reshape(s.n, -1)
    lev = (np.maximum(s.length[i], blk.strings.length[j]) - sim.pair_levenshtein(s, i, blk.strings, j)).reshape(s.n, -1)
    shared = blk.shared(sim._counts(s))
    assert shared.dtype == np.float32 and np.array_equal(shared, blk.common(sim._counts(s))) and (shared >= lcs).all()
    none, far = np.full(s.n, -1), np.full(s.n, 1 << 40)
    for a, b in ((none, none), (lcs[:, 3], lev[:, 3]), (far, lev[:, 5]), (lcs[:, 5], far)):
        got = sim.greatest(s, blk, a, b)
        assert np.array_equal(got[0], np.maximum(a, lcs.max(axis=1))) and np.array_equal(got[1], np.maximum(b, lev.max(axis=1)))
        assert np.array_equal(got[2], shared.min(axis=1))
    for more in ([], ["ab1 " * 50], ["1" * 400]):  # long strings on one side and on both
        for a, b in ((sim.Strings(src + more), sim.Block(tgt)), (sim.Strings(src[:20] + more), sim.Block(tgt + more))):
            i, j = (x.ravel() for x in np.indices((a.n, b.strings.n)))
            lcs = sim.pair_lcs(a, i, b.strings, j).reshape(a.n, -1)
            lev = (np.maximum(a.length[i], b.strings.length[j]) - sim.pair_levenshtein(a, i, b.strings, j)).reshape(a.n, -1)
            assert [x.tolist() for x in sim.least(a, b)] == [lcs.min(axis=1).tolist(), lev.min(axis=1).tolist()]


def test_keys_of_the_fuzzy_stage_are_made_once(spark):
    a = spark.createDataFrame([(1, "Alpha beta gamma (1999)"), (2, "Other words here (2001)")], "item_id long, title string")
    b = spark.createDataFrame([(11, "Alpha beta gammas (1999)"), (12, "Nothing of this")], "item_id long, title string")
    keys = mt._candidates_scored(a, b, mt.DEFAULT_WEIGHTS, mt.DEFAULT_THRESHOLD)[:2]
    assert all("regexp" not in k._jdf.queryExecution().optimizedPlan().toString() for k in keys)

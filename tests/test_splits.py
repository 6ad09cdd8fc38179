"""Splits, folds, leave-one-out and negative sampling invariants."""
import pytest
from pyspark.sql import functions as F

from warmstart.operators import filters, implicit, splits
from warmstart.sources import fixtures as fx
from tests.conftest import SF


def test_split_hand_case(spark):
    rows = [(u, i, 1.0) for u in (1, 2, 3) for i in range(5)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    lab = splits.split_users_disjoint(df, 6, seed=42)
    s = lab.filter("part = 'sample'")
    assert s.select("user_id").distinct().count() == 2 and s.count() == 10  # crossing user included


def test_split_disjoint_complete_and_minimal(spark, rat):
    lab = splits.split_users_disjoint(rat, 1000, seed=7).cache()
    assert lab.count() == rat.count()
    users = lab.groupBy("user_id").agg(F.countDistinct("part").alias("k"))
    assert users.filter("k > 1").count() == 0
    tot = splits.user_running_totals(rat, 7).toPandas().sort_values("before")
    chosen = tot[tot.before < 1000]
    assert chosen.n.sum() >= 1000 and chosen.n.sum() - chosen.n.iloc[-1] < 1000
    assert lab.filter("part = 'sample'").count() == chosen.n.sum()


def test_running_totals_match_sorted_cumsum(spark, rat):
    import hashlib

    t = splits.user_running_totals(rat, 3).toPandas()
    t["h"] = [int(hashlib.md5(f"3:{u}".encode()).hexdigest()[:8], 16) for u in t.user_id]
    t = t.sort_values(["h", "user_id"])
    assert (t.before.values == (t.n.cumsum() - t.n).values).all()


def test_build_index_dense_and_ordered(spark, rat):
    idx = splits.build_index(rat, "item_id").toPandas().sort_values("item_id")
    assert list(idx.idx) == list(range(len(idx)))


def test_kfold_partition(spark, rat):
    f = splits.fold_long(splits.kfold(rat, 5, 1), 5)
    per = f.groupBy("user_id", "item_id").agg(F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).alias("t"),
                                              F.count(F.lit(1)).alias("n"))
    assert per.filter("t != 1 or n != 5").count() == 0


def test_core_filters(spark, rat):
    cu = filters.core_users(rat, 5)
    assert cu.groupBy("user_id").count().filter("count < 5").count() == 0
    both = filters.core_both(rat, 5)
    counts = rat.groupBy("item_id").count().filter("count >= 5")
    assert both.join(counts, "item_id", "left_anti").count() == 0


def test_leave_one_out_one_per_user(spark):
    impl = fx.implicit(spark, SF)
    loo = implicit.leave_one_out(impl, 42, 1).cache()
    per = loo.groupBy("user_id").agg(F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).alias("t"),
                                     F.count(F.lit(1)).alias("n"))
    assert per.filter("t != 1").count() == 0
    assert per.filter("n <= 1").count() == 0
    small = impl.groupBy("user_id").count().filter("count <= 1").select("user_id")
    assert loo.join(small, "user_id").count() == 0


def test_negatives_valid_and_complete(spark):
    impl = fx.implicit(spark, SF)
    loo = implicit.leave_one_out(impl, 42, 1)
    train, test = loo.filter("split = 'train'"), loo.filter("split = 'test'")
    neg = implicit.negative_sample(test, train, 99, 42).cache()
    per = neg.groupBy("user_id", "pos_item").agg(F.count(F.lit(1)).alias("n"), F.max("j").alias("mj"))
    assert per.filter("n != 99 or mj != 98").count() == 0
    assert per.count() == test.count()
    hits = neg.join(train.select("user_id", F.col("item_id").alias("neg_item")), ["user_id", "neg_item"])
    assert hits.count() == 0
    assert neg.filter("neg_item = pos_item").count() == 0
    items = train.select(F.col("item_id").alias("neg_item")).distinct()
    assert neg.join(items, "neg_item", "left_anti").count() == 0


def test_negatives_of_a_dense_user(spark):
    # user 1 owns 18 of 20 items, another is the test item: one is left
    rows = [(1, i, 1.0) for i in range(18)] + [(2, i, 1.0) for i in range(20)]
    train = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    test = spark.createDataFrame([(1, 18, 1.0)], "user_id long, item_id long, rating double")
    neg = implicit.negative_sample(test, train, 99, 3).toPandas()
    assert len(neg) == 99 and set(neg.neg_item) == {19}


@pytest.mark.parametrize("width", [3, 64, 1 << 16])
def test_negatives_are_the_kth_allowed_items(spark, width):
    """Every draw is the allowed item of its rank, whatever the spans."""
    import hashlib
    import random

    rng = random.Random(width)
    own = {u: {3 * i for i in range(60) if rng.random() < p} for u, p in ((1, 0.5), (2, 0.02), (3, 0.98), (4, 0.0))}
    own[5] = {3 * i for i in range(60)}
    pos = {1: 0, 2: 177, 3: 7, 4: 90, 5: 3}  # 7 is no train item; 5 owns its test item and all others
    train = spark.createDataFrame([(u, i) for u in own for i in own[u]], "user_id long, item_id long")
    test = spark.createDataFrame(list(pos.items()), "user_id long, item_id long")
    got = {(r["user_id"], r["j"]): r["neg_item"] for r in implicit.negative_sample(test, train, 40, 9, width=width).collect()}
    items = sorted(set().union(*own.values()))
    want = {}
    for u, p in pos.items():
        allowed = [i for i in items if i not in own[u] and i != p]
        for j in range(40 if allowed else 0):
            h = int(hashlib.md5(f"9:{u}:{p}:{j}".encode()).hexdigest()[:8], 16)
            want[u, j] = allowed[h % len(allowed)]
    assert got == want

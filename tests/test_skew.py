"""One user holds a third of all rows: the operators stay correct and never need the
hot user's rows in one row (bounded pieces) or a global sort."""
import pytest
from pyspark.sql import functions as F

from warmstart.operators import factors as fa
from warmstart.operators import filters, implicit, mf, splits, stats
from warmstart.operators.skipgram import pieces
from warmstart.operators.ordering import positions_within
from warmstart.sources import fixtures as fx
from tests.conftest import SF

HOT = -1


@pytest.fixture(scope="module")
def skewed(spark):
    li = fx.table(spark, SF, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    od = fx.table(spark, SF, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    user = F.when(F.col("l_orderkey") % 3 == 0, F.lit(HOT)).otherwise(F.col("o_custkey"))
    df = j.select(user.cast("long").alias("user_id"),
                  (F.col("l_orderkey") * 100000 + F.col("l_linenumber")).cast("long").alias("item_id"),
                  (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double").alias("rating"),
                  F.col("o_orderdate").alias("ts"))
    df = df.groupBy("user_id", "item_id").agg(F.max("rating").alias("rating"), F.max("ts").alias("ts"))
    return df.cache()


def test_hot_user_holds_a_third(skewed):
    n = skewed.count()
    hot = skewed.filter(F.col("user_id") == HOT).count()
    assert 0.25 * n < hot < 0.42 * n


def test_filters_and_split(skewed):
    pdf = skewed.toPandas()
    cnt = pdf.groupby("user_id").size()
    assert filters.core_users(skewed, 5).count() == int(cnt[cnt >= 5].sum())
    lab = splits.split_users_disjoint(skewed, len(pdf) // 2, seed=3)
    parts = lab.groupBy("user_id").agg(F.countDistinct("part").alias("k"))
    assert parts.filter("k > 1").count() == 0 and lab.count() == len(pdf)


def test_leave_one_out_hot_user(skewed):
    loo = implicit.leave_one_out(skewed, 42, 1)
    hot = loo.filter(F.col("user_id") == HOT).groupBy("split").count().collect()
    got = {r["split"]: r["count"] for r in hot}
    assert got["test"] == 1 and got["train"] == skewed.filter(F.col("user_id") == HOT).count() - 1


def test_positions_and_pieces(skewed):
    pos = positions_within(skewed.select("user_id", "item_id"), "user_id", ["item_id"], "p").toPandas()
    pdf = skewed.select("user_id", "item_id").toPandas().sort_values(["user_id", "item_id"])
    pdf["p"] = pdf.groupby("user_id").cumcount()
    m = pos.merge(pdf, on=["user_id", "item_id"], suffixes=("", "_pd"))
    assert len(m) == len(pdf) and (m.p == m.p_pd).all()
    adj = stats.adjacency(skewed, "user_id", "item_id", "rating", max_len=100).toPandas()
    assert adj.entries.map(len).max() <= 100
    hot = adj[adj.user_id == HOT]
    assert hot.entries.map(len).sum() == (pdf.user_id == HOT).sum() and len(hot) > 5
    cut = pieces(skewed, 5, piece=100, ts=None).toPandas()
    assert cut.rows.map(len).max() <= 110
    owned = cut.apply(lambda p: sum(p.start <= x["r"] < p.start + 100 for x in p.rows), axis=1)
    assert owned.sum() == len(pdf)


def test_negatives_for_hot_user(skewed):
    loo = implicit.leave_one_out(skewed, 42, 1)
    train, test = loo.filter("split = 'train'"), loo.filter("split = 'test'")
    neg = implicit.negative_sample(test.filter(F.col("user_id") == HOT), train, 99, 5)
    owned = train.filter(F.col("user_id") == HOT).select(F.col("item_id").alias("neg_item"))
    assert neg.count() == 99 and neg.join(owned, "neg_item").count() == 0


def test_dsgd_with_hot_user(spark, skewed):
    rs = splits.kfold(skewed, 5, 1)
    train, test = rs.filter("fold != 1"), rs.filter("fold = 1")
    u = fa.init_random(train.select(F.col("user_id").alias("id")), 4, 0.1, seed=1, side="user")
    i = fa.init_random(train.select(F.col("item_id").alias("id")), 4, 0.1, seed=1, side="item")
    res = mf.fit(train, u, i, None, epochs=2, lr=0.01, blocks=4)
    assert res.loss[1] < res.loss[0]
    assert res.users.count() == train.select("user_id").distinct().count()


@pytest.mark.parametrize("extra", [True, False])
def test_hot_token_does_not_pair_everything(spark, extra):
    """'the' is in every title. With 3-token titles it falls in the suffix; with 2-token
    titles it is in the prefix but the suffix-norm buckets keep it from pairing titles."""
    from tests import plain_strings as plain
    from warmstart.operators import matching as mt

    n = 300
    tail = (lambda i, c: f" {c}{i}") if extra else (lambda i, c: "")
    src = spark.createDataFrame([(i, f"the w{i}{tail(i, 'z')}") for i in range(n)], "sid long, key string")
    tgt = spark.createDataFrame([(i, f"the w{i}{tail(i, 'y')}") for i in range(n)], "tid long, key string")
    theta = mt.cosine_bound(mt.DEFAULT_WEIGHTS, 0.75) - 1e-6
    cands = mt.candidate_pairs(mt.token_table(src, "sid"), mt.token_table(tgt, "tid"), theta)
    got = {(r["sid"], r["tid"]) for r in cands.collect()}
    assert len(got) <= 2 * n  # not n * n
    for i in range(0, n, 37):  # every true pair above the bound is kept
        a, b = f"the w{i}{tail(i, 'z')}", f"the w{i}{tail(i, 'y')}"
        if plain.cosine(a, b) >= theta:
            assert (i, i) in got

"""Factor-model operators."""
import math

import numpy as np
from pyspark.sql import functions as F

from warmstart.operators import factors as fa
from warmstart.operators import splits
from warmstart.sources import fixtures as fx
from tests.conftest import SF


def _side(spark, n, dim, offset=0.0):
    rows = [(i, [float((i * 7 + k) % 5) / 10 + offset for k in range(dim)], 0.01 * i) for i in range(n)]
    return spark.createDataFrame(rows, "id long, vec array<double>, bias double")


def test_init_random_moments_and_stability(spark, rat):
    ids = rat.select(F.col("item_id").alias("id"))
    e1 = fa.init_random(ids, 32, stddev=0.1, seed=3).toPandas().sort_values("id")
    e2 = fa.init_random(ids.repartition(7), 32, stddev=0.1, seed=3).toPandas().sort_values("id")
    m = np.stack(e1.vec.to_numpy())
    assert np.array_equal(m, np.stack(e2.vec.to_numpy()))
    assert abs(m.mean()) < 0.01 and abs(m.std() - 0.1) < 0.01
    n = ids.distinct().count()
    s = np.stack(fa.init_random(ids, 32, stddev=0.1, use_sigma=True, seed=3).toPandas().vec.to_numpy())
    assert abs(s.std() - 0.1 / math.sqrt(n)) < 0.002


def test_transfer_hand_case(spark):
    n = 10
    tgt = _side(spark, n, 2, offset=0.0)
    src = spark.createDataFrame([(100 + i, [9.0, 9.0], 0.0) for i in range(n)], "id long, vec array<double>, bias double")
    mapping = spark.createDataFrame([(100 + i, i, 1 if i < 5 else 3) for i in range(n)],
                                    "source_item long, target_item long, stage int")
    strict, n_emb = fa.transfer_items(tgt, src, mapping, n, 0.25)
    compat, _ = fa.transfer_items(tgt, src, mapping, n, 0.25, compat=True)
    assert n_emb == 3
    assert strict.filter("transferred").count() == 3 and compat.filter("transferred").count() == 4
    zero, _ = fa.transfer_items(tgt, src, mapping, n, 0.0)
    zero_c, _ = fa.transfer_items(tgt, src, mapping, n, 0.0, compat=True)
    assert zero.filter("transferred").count() == 0 and zero_c.filter("transferred").count() == 1
    full, _ = fa.transfer_items(tgt, src, mapping, n, 1.0)
    assert full.filter("transferred").count() == n
    assert all(r["vec"] == [9.0, 9.0] for r in full.collect())


def test_interpolate_endpoints(spark):
    a, b = _side(spark, 5, 3), _side(spark, 5, 3, offset=1.0)
    at0 = {r["id"]: r["vec"] for r in fa.interpolate_params(a, b, 0.0).collect()}
    at1 = {r["id"]: r["vec"] for r in fa.interpolate_params(a, b, 1.0).collect()}
    assert at0 == {r["id"]: r["vec"] for r in a.collect()}
    assert all(np.allclose(at1[r["id"]], r["vec"]) for r in b.collect())


def test_interpolate_rmse_equals_brute_force(spark, rat):
    f0u, f0i = fx.factors(spark, SF, "user", 0, rat), fx.factors(spark, SF, "item", 0, rat)
    f1u, f1i = fx.factors(spark, SF, "user", 1, rat), fx.factors(spark, SF, "item", 1, rat)
    r = splits.kfold(rat, 5, 1).withColumn("split", F.when(F.col("fold") == 1, "test").otherwise("train"))
    mu = 3.0
    got = fa.interpolate_rmse(r, f0u, f0i, f1u, f1i, mu, n=7).toPandas()
    for alpha in (0.0, 0.5, 1.0):
        u = fa.interpolate_params(f0u, f1u, alpha)
        i = fa.interpolate_params(f0i, f1i, alpha)
        p = fa.predict(r, u, i, mu).groupBy("split").agg(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("est"), 2))).alias("x"))
        for row in p.collect():
            g = got[(got.split == row["split"]) & (np.isclose(got.alpha, alpha))].rmse.iloc[0]
            assert abs(g - row["x"]) < 1e-9


def test_gradient_step_matches_numpy(spark):
    ratings = spark.createDataFrame([(0, 0, 4.0), (0, 1, 2.0), (1, 1, 5.0)], "user_id long, item_id long, rating double")
    users, items = _side(spark, 2, 3), _side(spark, 2, 3, offset=0.2)
    nu, ni = fa.gradient_step(ratings, users, items, 3.0, lr=0.1, reg=0.05)
    U = {r["id"]: (np.array(r["vec"]), r["bias"]) for r in users.collect()}
    I = {r["id"]: (np.array(r["vec"]), r["bias"]) for r in items.collect()}
    gu = {k: [np.zeros(3), 0.0] for k in U}
    gi = {k: [np.zeros(3), 0.0] for k in I}
    for u, i, r in [(0, 0, 4.0), (0, 1, 2.0), (1, 1, 5.0)]:
        e = r - (3.0 + U[u][1] + I[i][1] + U[u][0] @ I[i][0])
        gu[u][0] += e * I[i][0] - 0.05 * U[u][0]
        gu[u][1] += e - 0.05 * U[u][1]
        gi[i][0] += e * U[u][0] - 0.05 * I[i][0]
        gi[i][1] += e - 0.05 * I[i][1]
    for r in nu.collect():
        assert np.allclose(r["vec"], U[r["id"]][0] + 0.1 * gu[r["id"]][0])
        assert abs(r["bias"] - (U[r["id"]][1] + 0.1 * gu[r["id"]][1])) < 1e-12
    for r in ni.collect():
        assert np.allclose(r["vec"], I[r["id"]][0] + 0.1 * gi[r["id"]][0])

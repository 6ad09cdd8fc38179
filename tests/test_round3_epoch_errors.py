"""RMSE at an epoch's end (M5, M8): measured where the ratings are packed."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from warmstart.operators import mf
from warmstart.operators.blocks import Side, Strata, places
from warmstart.operators.factors import init_random


def _data(spark, n=400):
    rat = spark.range(n).select((F.col("id") * 7 % 23).alias("user_id"), (F.col("id") * 5 % 31).alias("item_id"),
                                (F.col("id") % 5 + 1).cast("double").alias("rating"))
    sides = [init_random(rat.select(F.col(c).alias("id")), 4, seed=1, side=c[:4]) for c in ("user_id", "item_id")]
    return rat, sides


@pytest.mark.parametrize("repeated", [False, True])
def test_epoch_errors_equal_the_grid(spark, monkeypatch, repeated):
    rat, (users, items) = _data(spark)
    test = rat.filter("item_id % 3 = 0").unionByName(spark.sql("select 3L user_id, 4L item_id, cast(null as double) rating"))
    test = test.unionByName(spark.sql("select * from values (999L, 4L, 1d), (null, 4L, 2d), (3L, null, 3d) t(user_id, item_id, rating)"))
    if repeated:
        items = items.unionByName(items.filter("id < 5"))
    monkeypatch.setattr(mf, "epoch_rmse", lambda *_: pytest.fail("ratings sent through the grid"))
    res = mf.fit(rat, users, items, test, epochs=1, blocks=4)
    monkeypatch.undo()
    mu = rat.agg(F.avg("rating")).first()[0]
    want = mf.epoch_rmse(rat, test, res.users, res.items, mu)
    assert np.allclose((res.loss[0], res.val_loss[0]), want, rtol=1e-12)
    monkeypatch.setattr(mf, "IN_PLACE", 3)
    grid = mf.fit(rat, users, items, test, epochs=1, blocks=4)
    assert np.allclose((grid.loss[0], grid.val_loss[0]), want, rtol=1e-12)
    assert math.isnan(mf.fit(rat, users, items, None, epochs=1, blocks=2).val_loss[0])
    assert math.isnan(mf.fit(rat, users, items, test.limit(0), epochs=1, blocks=2).val_loss[0])


def test_measured_parts_and_names(spark, monkeypatch):
    rat, (users, items) = _data(spark)
    rows = rat.toDF("u", "i", "r")
    strata = Strata(spark, 3, 42)
    try:
        strata.begin(users, items, rows, {"more": rows.filter("r > 3"), "none": rows.limit(0)})
        got = strata.measure(["entries", "more", "none"], lambda us, ii, r, one, two: float((r * one.ids[us] + two.ids[ii]).sum()))
    finally:
        strata.abandon()
    want = {k: (sum(r.r * r.u + r.i for r in t), len(t)) for k, t in (("entries", rows.collect()), ("more", rows.filter("r > 3").collect()), ("none", []))}
    assert got == want


def test_places_of_repeated_and_unknown_ids():
    side = lambda *ids: Side(np.array(ids), np.zeros((len(ids), 1)), np.zeros(len(ids)))
    at, u, i = places(np.array([5, 7, 1, 5]), np.array([2, 2, 2, 9]), side(1, 5, 5), side(2, 2, 3))
    assert list(zip(at.tolist(), u.tolist(), i.tolist())) == [(0, 1, 0), (0, 1, 1), (0, 2, 0), (0, 2, 1), (2, 0, 0), (2, 0, 1)]

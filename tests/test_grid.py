"""Ratings and factors in a grid of cells: the rows and values of plain joins, vectors sent with their block only."""
import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from warmstart.operators import factors as fa
from warmstart.operators import grid

VECTORS = {"double": [[0.5, 1.0], [2.0, -1.0], None, [1.0, None], [3.0], [0.25, 0.1]], "float": [[0.5, 1.0], [2.0, -1.0], None, [1.0, None], [3.0], [0.25, 4.0]]}


def _tables(spark, kind, id_type="long"):
    key = str if id_type == "string" else int
    side = lambda shift: spark.createDataFrame(
        [(key(k % 5), VECTORS[kind][(k + shift) % 6], None if k == 3 else k / 10) for k in range(8)] + [(None, [1.0, 1.0], 0.0)],
        f"id {id_type}, vec array<{kind}>, bias double")  # ids 0, 1 and 2 twice
    rows = [(key(u), key(i), None if (u, i) == (1, 1) else float(u + i)) for u in range(7) for i in range(6)] * 2 + [(None, key(1), 1.0), (key(1), None, 1.0)]
    return spark.createDataFrame(rows, f"user_id {id_type}, item_id {id_type}, rating double"), side(0), side(1)


def _joined(ratings, users, items):
    u = users.select(F.col("id").alias("user_id"), F.col("vec").alias("p"), F.col("bias").alias("bu"))
    i = items.select(F.col("id").alias("item_id"), F.col("vec").alias("q"), F.col("bias").alias("bi"))
    return ratings.join(u, "user_id").join(i, "item_id").withColumn("est", F.lit(3.0) + F.col("bu") + F.col("bi") + fa.dot(F.col("p"), F.col("q")))


@pytest.mark.parametrize("kind,id_type", [("double", "long"), ("float", "long"), ("double", "string")])
def test_predict_equals_joins(spark, kind, id_type):
    ratings, users, items = _tables(spark, kind, id_type)
    cols = ["user_id", "item_id", "rating", "bu", "bi", F.round("est", 9).alias("est")]
    want = sorted(map(repr, _joined(ratings, users, items).select(cols).collect()))
    assert sorted(map(repr, fa.predict(ratings, users, items, 3.0, cells=2).select(cols).collect())) == want
    assert any("est=None" in r for r in want) and len(want) > 60


def test_rows_of_a_cell_without_vectors_are_dropped(spark):
    ratings, users, items = _tables(spark, "double")
    assert fa.predict(ratings, users.limit(0), items, 3.0, cells=2).count() == 0


def test_vector_parts_add_up(spark):
    ratings, users, items = _tables(spark, "double")
    ratings, (users, items) = ratings.dropna(), (t.filter(F.size("vec") == 2).filter(~F.exists("vec", lambda x: x.isNull())).dropna() for t in (users, items))
    err = lambda r, bu, bi, p, q: r - (3.0 + bu + bi + np.einsum("kd,kd->k", p, q))
    for by, other in (("user_id", "q"), ("item_id", "p")):
        got = {r["id"]: r for r in grid.vector_sums(ratings, users, items, "user_id", "item_id", by, err, "rating").groupBy("id")
               .agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("gv")[0]).alias("a"), F.sum(F.col("gv")[1]).alias("b")).collect()}
        e = F.col("rating") - F.col("est")
        want = (_joined(ratings, users, items).groupBy(F.col(by).alias("id"))
                .agg(F.count(F.lit(1)).alias("n"), F.sum(e).alias("w"), F.sum(e * F.col(other)[0]).alias("a"), F.sum(e * F.col(other)[1]).alias("b")).collect())
        assert len(got) == len(want) > 2
        for r in want:
            assert np.allclose([got[r["id"]][c] for c in "nwab"], [r[c] for c in "nwab"])


def test_no_shuffle_of_ratings_with_vectors(spark):
    """One exchange for the ratings: no join of a rating with a vector."""
    ratings, users, items = _tables(spark, "double")
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        fa.predict(ratings, users, items, 3.0).explain()
    assert "Join" not in plan.getvalue() and plan.getvalue().count("Exchange") == 1


def test_interpolation_with_a_null_vector_of_one_model(spark):
    """At alpha 0 the other model's missing vector changes nothing."""
    ratings = spark.createDataFrame([(u, i, float(u + i), "train") for u in range(3) for i in range(3)], "user_id long, item_id long, rating double, split string")
    side = lambda gone: spark.createDataFrame([(k, None if k == gone else [0.5 * k, 1.0], 0.1) for k in range(3)], "id long, vec array<float>, bias double")
    got = fa.interpolate_rmse(ratings, side(None), side(None), side(1), side(None), 0.0, n=2).filter("k = 0").first()["rmse"]
    want = np.sqrt(np.mean([(u + i - (0.2 + 0.25 * u * i + 1.0)) ** 2 for u in range(3) for i in range(3)]))
    assert abs(got - want) < 1e-6

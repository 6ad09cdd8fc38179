"""Biased matrix-factorisation models as tables.

A model side is a table ``(id, vec array<double>, bias double)``: one row per user
(or item). Ratings meet the factor tables in a grid of cells (``operators.grid``): a vector is sent to the cells of its
block, not with every rating. Element-wise vector sums are parts per cell, added up by id, so a user with a
third of all ratings is still combined inside every cell before the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmstart.functions.seeded import hash_normal
from warmstart.operators import grid
from warmstart.operators.ordering import global_index


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equal-length arrays (built-in higher-order functions)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, v: acc + v)


def axpby(alpha: float | Column, a: Column, beta: float | Column, b: Column) -> Column:
    """Element-wise ``alpha * a + beta * b``."""
    al = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    be = beta if isinstance(beta, Column) else F.lit(float(beta))
    return F.zip_with(a, b, lambda x, y: al * x + be * y)


# ---------------------------------------------------------------- M1
def init_random(ids: DataFrame, dim: int, stddev: float = 0.1, use_sigma: bool = False, seed: int = 42,
                side: str = "item", id_col: str = "id") -> DataFrame:
    """M1: N(0, sigma) vectors, sigma = stddev, or stddev / sqrt(n) with ``use_sigma``.

    Every element is a pure function of ``(seed, side, id, k)``, so the table is the
    same however it is partitioned or recomputed.
    """
    sigma = float(stddev)
    if use_sigma:
        sigma = stddev / math.sqrt(max(ids.select(id_col).distinct().count(), 1))
    idc = F.col(id_col)
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda k: hash_normal(seed, F.lit(side), idc, k, stddev=sigma))
    return ids.select(idc.alias("id")).distinct().select("id", vec.alias("vec"), F.lit(0.0).alias("bias"))


# ---------------------------------------------------------------- J8 / A5 / A6
def predict(ratings: DataFrame, users: DataFrame, items: DataFrame, mu: float,
            user: str = "user_id", item: str = "item_id", cells: int = grid.GRID) -> DataFrame:
    """``est = mu + bu + bi + pu . qi`` for every rating, with ``bu``, ``bi`` and the squared norms ``pp`` and ``qq``.

    A stream of ratings is joined with the factor tables instead (stateless)."""
    if ratings.isStreaming:
        u = users.select(F.col("id").alias(user), F.col("vec").alias("pu"), F.col("bias").alias("bu"))
        i = items.select(F.col("id").alias(item), F.col("vec").alias("qi"), F.col("bias").alias("bi"))
        p, q = F.col("pu"), F.col("qi")
        met = ratings.join(u, user).join(i, item).withColumns({"pq": dot(p, q), "pp": dot(p, p), "qq": dot(q, q)}).drop("pu", "qi")
    else:
        met = grid.dots(ratings, users, items, user, item, lambda p, q: [_dots(p, q), _dots(p, p), _dots(q, q)],
                        ["pq", "pp", "qq"], ["bu"], ["bi"], cells)
    return met.withColumn("est", F.lit(float(mu)) + F.col("bu") + F.col("bi") + F.col("pq")).drop("pq")


def _dots(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, added up in the order of the elements as ``dot`` does: the same bits."""
    return np.add.reduce(np.ascontiguousarray((p * q).T), axis=0)


def regularized_loss(pred: DataFrame, reg: float, rating: str = "rating") -> DataFrame:
    """``sum((r - est)^2 + reg * (bu^2 + bi^2 + |pu|^2 + |qi|^2))`` over the ratings."""
    sq = F.pow(F.col(rating) - F.col("est"), 2)
    pen = F.pow("bu", 2) + F.pow("bi", 2) + F.col("pp") + F.col("qq")
    return pred.agg(F.sum(sq + F.lit(float(reg)) * pen).alias("loss"))


# ---------------------------------------------------------------- J9 / W6 / O3
def transfer_items(target_items: DataFrame, source_items: DataFrame, mapping: DataFrame, n_items: int,
                   limit: float, compat: bool = False) -> tuple[DataFrame, int]:
    """Overwrite target item vectors with mapped source vectors, within a budget.

    ``mapping(source_item, target_item, stage)`` is consumed in (stage, source_item)
    order (W6); the first ``ceil(n_items * limit)`` entries are used (O3). With
    ``compat=True`` one more entry is used, as the reference's loop does (Q1).
    When two used entries share a target, the later one wins. Returns the new item
    table (with a ``transferred`` flag) and ``n_emb``. A pair uses up budget only if its
    source has a vector and its target is in the table.
    """
    n_emb = int(math.ceil(n_items * limit))
    usable = (mapping.select("source_item", "target_item", "stage")
              .join(source_items.select(F.col("id").alias("source_item")), "source_item", "left_semi")
              .join(target_items.select(F.col("id").alias("target_item")), "target_item", "left_semi"))
    ranked = global_index(usable, ["stage", "source_item"], "rank")
    cut = F.col("rank") <= n_emb if compat else F.col("rank") < n_emb
    used = (ranked.filter(cut).groupBy("target_item")
            .agg(F.max_by("source_item", "rank").alias("source_item")))
    src = source_items.select(F.col("id").alias("source_item"), F.col("vec").alias("_svec"))
    moved = used.join(src, "source_item").select(F.col("target_item").alias("id"), "_svec")
    out = (target_items.join(moved, "id", "left")
           .select("id", F.coalesce(F.col("_svec"), F.col("vec")).alias("vec"), "bias",
                   F.col("_svec").isNotNull().alias("transferred")))
    return out, min(n_emb, n_items)


# ---------------------------------------------------------------- M12 / A14
def interpolate_params(m0: DataFrame, m1: DataFrame, alpha: float) -> DataFrame:
    """``(1 - alpha) * m0 + alpha * m1`` for vectors and biases (ids joined)."""
    a = m0.select("id", F.col("vec").alias("v0"), F.col("bias").alias("b0"))
    b = m1.select("id", F.col("vec").alias("v1"), F.col("bias").alias("b1"))
    return (a.join(b, "id")
            .select("id", axpby(1.0 - alpha, F.col("v0"), alpha, F.col("v1")).alias("vec"),
                    ((1.0 - alpha) * F.col("b0") + alpha * F.col("b1")).alias("bias")))


def interpolate_rmse(ratings: DataFrame, users0: DataFrame, items0: DataFrame, users1: DataFrame,
                     items1: DataFrame, mu: float, n: int = 50, lo: float = 0.0, hi: float = 1.0,
                     by: str = "split", user: str = "user_id", item: str = "item_id",
                     rating: str = "rating") -> DataFrame:
    """RMSE of the models on the line ``(1 - a) m0 + a m1`` for ``n`` values of ``a``.

    The prediction is quadratic in ``a``: ``est(a) = c0 + c1 a + c2 a^2``, so the
    squared error is a quartic whose five coefficients are sums over the ratings.
    One scan aggregates them per ``by`` group (e.g. train/test); the ``n`` grid
    points are generated from the aggregated row with ``explode(sequence)``.
    """
    def both(m0, m1):
        # the two models of a side are joined first (factor-sized); vectors and biases stand one behind the other
        return (m0.select("id", F.col("vec").alias("v0"), F.col("bias").alias("b0"))
                .join(m1.select("id", F.col("vec").alias("v1"), F.col("bias").alias("b1")), "id"))

    def side(t):
        # a vector without a value takes its model's terms only: zeros in its place, a null among the marks behind the biases
        def part(v, other):
            known = F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull())
            zeros = F.transform(F.coalesce(v, other), lambda x: F.lit(0.0)).cast(t.schema[v].dataType)
            return F.when(known, F.col(v)).otherwise(zeros), F.when(known, F.lit(0.0))

        (x0, k0), (x1, k1) = part("v0", "v1"), part("v1", "v0")
        return t.select("id", F.concat(x0, x1).alias("vec"), F.array("b0", "b1", k0, k1).alias("bias"))

    def products(p, q):
        d = p.shape[1] // 2
        p0, p1, q0, q1 = p[:, :d], p[:, d:], q[:, :d], q[:, d:]
        return [_dots(p0, q0), _dots(p1, q1), _dots(p0, q1) + _dots(p1, q0)]

    j = grid.dots(ratings.select(by, user, item, rating), side(both(users0, users1)), side(both(items0, items1)), user, item, products,
                  ["p0q0", "p1q1", "cross"], ["bu0", "bu1", "ku0", "ku1"], ["bi0", "bi1", "ki0", "ki1"])
    p0q0, p1q1 = (F.col(f"p{m}q{m}") + F.col(f"ku{m}") + F.col(f"ki{m}") for m in (0, 1))
    cross = F.col("cross") + F.col("ku0") + F.col("ku1") + F.col("ki0") + F.col("ki1")
    b0 = F.col("bu0") + F.col("bi0")
    b1 = F.col("bu1") + F.col("bi1")
    j = (j.withColumn("_c1", b1 - b0 - 2 * p0q0 + cross)
         .withColumn("_c2", p0q0 - cross + p1q1)
         .withColumn("_e0", F.col(rating) - (F.lit(float(mu)) + b0 + p0q0)))
    e0, c1, c2 = F.col("_e0"), F.col("_c1"), F.col("_c2")
    coef = j.groupBy(by).agg(
        F.sum(e0 * e0).alias("s0"), F.sum(-2 * e0 * c1).alias("s1"), F.sum(c1 * c1 - 2 * e0 * c2).alias("s2"),
        F.sum(2 * c1 * c2).alias("s3"), F.sum(c2 * c2).alias("s4"), F.count(F.lit(1)).alias("cnt"))
    step = (hi - lo) / (n - 1) if n > 1 else 0.0
    a = F.col("alpha")
    steps = (coef.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
             .withColumn("alpha", F.lit(lo) + F.col("k") * F.lit(step)))
    sse = F.col("s0") + F.col("s1") * a + F.col("s2") * a * a + F.col("s3") * a * a * a + F.col("s4") * a * a * a * a
    return steps.select(by, "k", "alpha", F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("cnt")).alias("rmse"))


# ---------------------------------------------------------------- M6
def gradient_step(ratings: DataFrame, users: DataFrame, items: DataFrame, mu: float, lr: float = 0.001,
                  reg: float = 0.04, user: str = "user_id", item: str = "item_id",
                  rating: str = "rating") -> tuple[DataFrame, DataFrame]:
    """M6: one full-batch step of the biased MF loss (the SGD rule, all updates from old values).

    ``bu += lr * sum_i(err - reg * bu)``, ``pu += lr * sum_i(err * qi - reg * pu)``
    and symmetrically for items. The sums come in parts, one per cell of the grid and id, and are added up by id;
    the regularisation needs only the number of ratings.
    """
    def err(r, bu, bi, p, q):
        return r - (mu + bu + bi + _dots(p, q))

    def added(xs: Column) -> Column:
        return F.aggregate(F.slice(xs, 2, F.size(xs)), xs[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))

    def apply(side: DataFrame, by: str) -> DataFrame:
        g = (grid.vector_sums(ratings, users, items, user, item, by, err, rating).groupBy("id")
             .agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.collect_list("gv").alias("gv"))
             .withColumn("gv", added(F.col("gv"))))
        step, r = F.lit(float(lr)), F.lit(float(reg)) * F.col("n")
        return (side.join(g, "id", "left")
                .select("id",
                        F.when(F.col("gv").isNull(), F.col("vec"))
                        .otherwise(F.zip_with("vec", "gv", lambda x, y: x + step * (y - r * x))).alias("vec"),
                        F.when(F.col("n").isNull(), F.col("bias"))
                        .otherwise(F.col("bias") + step * (F.col("w") - r * F.col("bias"))).alias("bias")))

    return apply(users, user), apply(items, item)

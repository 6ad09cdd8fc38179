"""Implicit-feedback evaluation sets.

Leave-one-out picks one interaction per user with an aggregate (``min_by`` over
an md5 key), not a per-user window sort: a user holding a third of all rows is
reduced map-side like any other. Negative sampling selects by rank: draw ``j`` of a test row is the ``k``-th
allowed item, ``k = pmod(md5(seed:user:item:j), n_allowed)``, i.e. ``n`` uniform draws with replacement from the
items that are neither the user's positives nor the test item. With the taken places ``p_0 < p_1 < ...`` of the dense
item index, ``p_i - i`` allowed items come before ``p_i``, so the k-th allowed item stands at ``k`` plus the number
of taken places with ``p_i - i <= k``. Nothing is rejected or drawn again, and neither a list of allowed items nor a
user x item product is formed. Taken places are kept in spans of ``SPAN`` places with a directory of their sizes, so
the places of a user with a third of all rows are many bounded rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warmstart.functions.seeded import hash_int
from warmstart.operators.ordering import positions_within
from warmstart.operators.splits import build_index
from warmstart.session import cut_lineage


def leave_one_out(df: DataFrame, seed: int = 42, min_n: int = 1, fold: int | None = None,
                  user: str = "user_id", item: str = "item_id") -> DataFrame:
    """``split`` = test for one md5-chosen interaction per user, train for the rest.

    Users with ``min_n`` interactions or fewer are dropped from both sides. ``fold``
    (optional) enters the key, so folds draw independently. An interaction is a
    (user, item) pair: duplicate rows of the chosen pair go to test together.
    """
    keys = [F.lit(fold)] if fold is not None else []
    h = hash_int(seed, *keys, F.col(user), F.col(item))
    per_user = (df.groupBy(user)
                .agg(F.count(F.lit(1)).alias("_n"), F.min_by(item, F.struct(h, F.col(item))).alias("_test"))
                .filter(F.col("_n") > min_n))
    return (df.join(per_user, user)
            .withColumn("split", F.when(F.col(item) == F.col("_test"), "test").otherwise("train"))
            .drop("_n", "_test"))


def loo_folds(df: DataFrame, k: int = 5, seed: int = 42, min_n: int = 1, user: str = "user_id",
              item: str = "item_id") -> DataFrame:
    """M13 input: ``k`` leave-one-out splits as one long table with a ``fold`` column.

    One job over the table with an exploded fold; fold f is ``leave_one_out(fold=f)``."""
    long = df.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    h = hash_int(seed, F.col("fold"), F.col(user), F.col(item))
    per_user = (long.groupBy("fold", user)
                .agg(F.count(F.lit(1)).alias("_n"), F.min_by(item, F.struct(h, F.col(item))).alias("_test"))
                .filter(F.col("_n") > min_n))
    return (long.join(per_user, ["fold", user])
            .withColumn("split", F.when(F.col(item) == F.col("_test"), "test").otherwise("train"))
            .drop("_n", "_test").select(*df.columns, "split", "fold"))


def allowed_counts(test: DataFrame, train: DataFrame, n_items: int | DataFrame, user: str = "user_id",
                   item: str = "item_id", fold: str | None = None) -> DataFrame:
    """Per test row, the number of items that are neither train positives of the user nor the test item.

    With ``fold`` all tables carry that column and ``n_items`` is a table (fold, n_items)."""
    by = [fold] if fold else []
    pos = train.select(*by, user, item).distinct()
    n_pos = pos.groupBy(*by, user).agg(F.count(F.lit(1)).alias("_np"))
    in_train = pos.withColumn("_in", F.lit(1))
    t = test.select(*by, user, F.col(item).alias("pos_item"))
    t = t.join(n_items, fold) if fold else t.withColumn("n_items", F.lit(n_items).cast("long"))
    return (t.join(n_pos, [*by, user], "left")
            .join(in_train.withColumnRenamed(item, "pos_item"), [*by, user, "pos_item"], "left")
            .select(*by, user, "pos_item", "n_items",
                    (F.col("n_items") - F.coalesce(F.col("_np"), F.lit(0)) - F.when(F.col("_in").isNull(), 1).otherwise(0))
                    .alias("n_allowed")))


#: Places of the item index in one span of taken places.
SPAN = 1 << 16


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of an array of lists one behind the other, and where each list begins (a null list is empty)."""
    size = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("c", T.LongType()), T.StructField("r", T.LongType())])))
def _locate(k: pa.Array, spans: pa.Array, sizes: pa.Array, width: pa.Array) -> pa.Array:
    """The span c of each k-th allowed place, and its rank r among the allowed places of that span."""
    draws, at = _lists(k)
    (c, cut), (n, _), size = _lists(spans), _lists(sizes), width.to_numpy(zero_copy_only=False).astype(np.int64)
    span, rank = np.empty(len(draws), dtype=np.int64), np.empty(len(draws), dtype=np.int64)
    for i in range(len(k)):
        ks, cs = draws[at[i]:at[i + 1]], c[cut[i]:cut[i + 1]]
        taken = np.concatenate([[0], np.cumsum(n[cut[i]:cut[i + 1]])])
        t = np.searchsorted((cs + 1) * size[i] - taken[1:], ks, side="right")  # spans that end before
        place = ks + taken[t]  # right if no taken place of its own span comes before
        start = np.append(cs, np.iinfo(np.int64).max // size[i])[t] * size[i]
        here = np.where(place >= start, start, place // size[i] * size[i])
        span[at[i]:at[i + 1]], rank[at[i]:at[i + 1]] = here // size[i], place - here
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(span), pa.array(rank)], ["c", "r"]))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _select(r: pa.Array, local: pa.Array) -> pa.Array:
    """Places inside a span of its r-th allowed places; ``local`` are the taken ones, sorted."""
    rank, at = _lists(r)
    taken, cut = _lists(local)
    place = rank.copy()
    for i in range(len(r)):
        gaps = taken[cut[i]:cut[i + 1]]
        place[at[i]:at[i + 1]] += np.searchsorted(gaps - np.arange(len(gaps)), rank[at[i]:at[i + 1]], side="right")
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(place))


def negative_sample(test: DataFrame, train: DataFrame, n: int = 99, seed: int = 42, user: str = "user_id",
                    item: str = "item_id", fold: str | None = None, width: int = SPAN) -> DataFrame:
    """``(user, pos_item, j, neg_item)``: ``n`` negatives per test row (``j`` = 0..n-1).

    The item universe is the set of train items. A row with no allowed item gets no
    negatives (the reference would fail there). With ``fold`` every fold is sampled by itself, all of them in the same jobs.
    ``width`` places of the item index make one span; the result does not depend on it.
    """
    by = [fold] if fold else []
    key = [*by, user, "pos_item"]
    if fold:
        index = positions_within(train.select(fold, item).distinct(), fold, [item], "idx")
        sizes = index.groupBy(fold).agg(F.count(F.lit(1)).alias("_items"))
    else:
        index = build_index(train, item, "idx")
        n_items = index.count()
        if n_items == 0:
            raise ValueError("empty train set")
    index = index.select(*by, F.col(item).alias("neg_item"), "idx")
    rows = test.select(*by, user, F.col(item).alias("pos_item")).distinct()
    own = rows.select(*key, F.col("pos_item").alias("neg_item"))
    taken = (rows.join(train.select(*by, user, F.col(item).alias("neg_item")), [*by, user]).select(*key, "neg_item")
             .unionByName(own).distinct().join(index, [*by, "neg_item"]))
    span = F.floor(F.col("idx") / width)
    spans = cut_lineage(taken.groupBy(*key, span.alias("c")).agg(
        F.sort_array(F.collect_list((F.col("idx") - span * width).cast("int"))).alias("local")))
    listed = spans.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("c", F.size("local").alias("n")))).alias("_l"))
    rows = rows.join(sizes, fold) if fold else rows.withColumn("_items", F.lit(n_items).cast("long"))
    none = F.array().cast("array<struct<c:bigint,n:int>>")
    rows = rows.join(listed, key, "left").withColumn("_l", F.coalesce("_l", none))
    allowed = F.col("_items") - F.aggregate("_l", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    rows = rows.withColumn("_allowed", allowed).filter("_allowed > 0")
    draws = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")),
                        lambda j: F.pmod(hash_int(seed, *map(F.col, key), j), F.col("_allowed")))
    found = rows.select(*key, F.posexplode(_locate(draws, F.col("_l.c"), F.col("_l.n"), F.lit(width))).alias("j", "at"))
    met = (found.groupBy(*key, F.col("at.c").alias("c")).agg(F.collect_list(F.struct("j", "at.r")).alias("_d"))
           .join(spans, [*key, "c"], "left"))
    places = met.select(*key, "c", F.explode(F.arrays_zip(F.col("_d.j").alias("j"), _select("_d.r", "local").alias("p"))).alias("_x"))
    return (places.select(*key, F.col("_x.j").alias("j"), (F.col("c") * width + F.col("_x.p")).alias("idx"))
            .join(index, [*by, "idx"]).select(*key, "j", "neg_item"))


def negatives_lines(neg: DataFrame, user: str = "user_id") -> DataFrame:
    """K2 layout: ``('<user>', '<item>')`` then the negatives in ``j`` order, tab separated."""
    head = F.concat(F.lit("('"), F.col(user).cast("string"), F.lit("', '"), F.col("pos_item").cast("string"), F.lit("')"))
    g = neg.groupBy(user, "pos_item").agg(F.sort_array(F.collect_list(F.struct("j", "neg_item"))).alias("_l"))
    body = F.concat_ws("\t", F.transform("_l", lambda x: x["neg_item"].cast("string")))
    return g.select(user, "pos_item", F.concat_ws("\t", head, body).alias("line"))


def implicit_dataset(df: DataFrame, k: int = 5, seed: int = 42, n_neg: int = 99, user: str = "user_id",
                     item: str = "item_id"):
    """Per fold: leave-one-out train/test, fold statistics and negatives for the test rows."""
    from warmstart.operators.stats import dataset_stats

    # every later job reads both sides of all folds: pin them once
    folds = cut_lineage(loo_folds(df, k, seed, 1, user, item))
    meta = dataset_stats(folds.filter(F.col("split") == "train"), by=["fold"], user=user, item=item)
    negs = negative_sample(folds.filter(F.col("split") == "test"), folds.filter(F.col("split") == "train"),
                           n_neg, seed, user=user, item=item, fold="fold")
    return folds, meta, negs


__all__ = ["leave_one_out", "loo_folds", "allowed_counts", "negative_sample", "negatives_lines",
           "implicit_dataset"]

"""Splits of an interaction table.

All random choices are md5 keys of ``(seed, ids)`` (see ``functions.seeded``), so
a split does not depend on partitioning and survives task retries unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warmstart.functions.seeded import hash_int
from warmstart.operators.ordering import global_index, hashed_prefix_sum


def distinct_ids(df: DataFrame, col: str) -> DataFrame:
    """U4: unique ids."""
    return df.select(col).distinct()


def build_index(df: DataFrame, col: str, name: str = "idx") -> DataFrame:
    """Dense 0-based index of the distinct values of ``col`` (raw id ascending)."""
    return global_index(df.select(col).distinct(), [col], name=name)


def kfold(df: DataFrame, k: int = 5, seed: int = 42, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Assign every interaction to one of ``k`` folds (1-based ``fold`` column)."""
    return df.withColumn("fold", (F.pmod(hash_int(seed, user, item), F.lit(k)) + 1).cast("int"))


def fold_long(df: DataFrame, k: int = 5) -> DataFrame:
    """W2, long form: one copy per fold ``f`` with ``split`` = test where fold == f, else train."""
    return (df.withColumn("f", F.explode(F.sequence(F.lit(1), F.lit(k))))
            .withColumn("split", F.when(F.col("fold") == F.col("f"), "test").otherwise("train"))
            .drop("fold").withColumnRenamed("f", "fold"))


def get_fold(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """The (train, test) pair of fold ``fold`` from a frame carrying ``fold``."""
    return df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)


def round_robin(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """Element ``i`` goes to batch ``i % n``."""
    return df.withColumn("batch", (F.col(idx) % n).cast("int"))


def restrict_test(train: DataFrame, test: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Drop test rows whose user or item never occurs in train."""
    return (test.join(train.select(user).distinct(), user, "left_semi")
            .join(train.select(item).distinct(), item, "left_semi"))


def user_running_totals(df: DataFrame, seed: int = 42, user: str = "user_id") -> DataFrame:
    """Per user ``n`` and ``before`` = interactions of all users earlier in shuffled order.

    The shuffle order is ``(md5(seed:user), user)``; the running sum is a two-level
    prefix sum over hash buckets (no single-partition window).
    """
    counts = (df.groupBy(user).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("_h", hash_int(seed, user)))
    return hashed_prefix_sum(counts, "_h", user, "n", out="before").drop("_h")


def split_users_disjoint(df: DataFrame, target_n: int, seed: int = 42, user: str = "user_id",
                         part_col: str = "part") -> DataFrame:
    """Label each interaction ``sample`` or ``rest``, disjoint in users.

    Users are taken in shuffled order until at least ``target_n`` interactions are
    selected; the user that crosses the target is included. Raises when the table
    has no more than ``target_n`` interactions (the complement would be empty).
    """
    check_split_size(df, target_n)
    totals = user_running_totals(df, seed, user)
    chosen = totals.filter(F.col("before") < target_n).select(user)
    flagged = chosen.withColumn("_in", F.lit(True))
    out = (df.join(flagged, user, "left")
           .withColumn(part_col, F.when(F.col("_in"), "sample").otherwise("rest")).drop("_in"))
    return out


def check_split_size(df: DataFrame, target_n: int) -> None:
    """Q11 decision: a target at or above the table size is an error, not a silent copy."""
    n = df.count()
    if target_n >= n:
        raise ValueError(f"target {target_n} >= {n} interactions: the complement would be empty")

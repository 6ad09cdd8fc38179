"""Aggregations over interaction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warmstart.operators.splits import fold_long
from warmstart.session import pinned


def dataset_stats(df: DataFrame, by: list[str] | None = None, user: str = "user_id",
                  item: str = "item_id", extra: list | None = None) -> DataFrame:
    """A1 + A2: ``n_users, n_items, n_ratings, sparsity`` (optionally per group, e.g. fold)."""
    by, df = by or [], pinned(df, "stats")
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_ratings"), *(extra or []))
    out = _side_by_side(by, rows, *(_distinct_ids(df, by, c, name) for c, name in ((user, "n_users"), (item, "n_items"))))
    rest = [c for c in rows.columns if c not in by]
    return out.select(*by, "n_users", "n_items", *rest).withColumn("sparsity", sparsity_expr())


def _distinct_ids(df: DataFrame, by: list[str], col: str, name: str) -> DataFrame:
    """Distinct ids per group, counted by themselves: counted together with others, a task's aggregate holds the keys of all counts."""
    return df.select(*by, col).distinct().groupBy(*by).agg(F.count(col).alias(name))


def _side_by_side(by: list[str], *parts: DataFrame) -> DataFrame:
    """The columns of aggregates over the same groups (one row a group in each), also of null groups."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy(*by).agg(*(F.max(c).alias(c) for c in out.columns if c not in by))


def fold_stats(folded: DataFrame, k: int = 5, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """A1 of every fold's train and test side: ``(fold, split, n_users, n_items, n_ratings)`` of a table with its ``fold``.

    The long form (k rows a rating) is made of the distinct (id, fold) pairs and of the folds' counts, never of the ratings."""
    df, by = pinned(folded.select(user, item, "fold"), "folds"), ["fold", "split"]
    counts = df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    rows = fold_long(counts, k).groupBy(*by).agg(F.sum("n").alias("n_ratings"))
    ids = (_distinct_ids(fold_long(df.select(c, "fold").distinct(), k), by, c, name) for c, name in ((user, "n_users"), (item, "n_items")))
    return _side_by_side(by, rows, *ids).select(*by, "n_users", "n_items", "n_ratings")


def sparsity_expr():
    """A2: ``1 - n_ratings / (n_items * n_users)``."""
    return F.lit(1.0) - F.col("n_ratings").cast("double") / (
        F.col("n_items").cast("double") * F.col("n_users").cast("double"))


def global_mean(df: DataFrame, rating: str = "rating") -> DataFrame:
    """A3: the mean rating (mu)."""
    return df.agg(F.avg(rating).alias("global_mean"))


def group_counts(df: DataFrame, key: str) -> DataFrame:
    """A4: ratings per user / per item (partial + final aggregate)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def rmse(pred: DataFrame, by: list[str] | None = None, rating: str = "rating", est: str = "est") -> DataFrame:
    """A5: ``sqrt(mean((r - est)^2))``, optionally grouped."""
    return pred.groupBy(*(by or [])).agg(
        F.sqrt(F.avg(F.pow(F.col(rating) - F.col(est), 2))).alias("rmse"))


def adjacency(df: DataFrame, key: str, other: str, value: str | None = None, max_len: int = 1000) -> DataFrame:
    """Key -> its (other[, value]) entries in ``other`` order, as pieces of at most ``max_len``.

    ``(key, piece, entries)``: a key with more than ``max_len`` entries spans several
    rows, so no row (and no task) holds an unbounded list."""
    from warmstart.operators.ordering import positions_within

    fields = [other] + ([value] if value else [])
    pos = positions_within(df.select(key, *fields), key, fields, "_p")
    return (pos.groupBy(key, F.floor(F.col("_p") / max_len).alias("piece"))
            .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("entries")))


def rating_rows(df: DataFrame, row: str = "user_id", col: str = "item_id", val: str = "rating",
                max_len: int = 1000) -> DataFrame:
    """Sparse rating-matrix rows ``(row, piece, cells map<col, val>)``, pieces of at most
    ``max_len`` cells (the latest value wins on duplicate cells, the largest without a ``ts``)."""
    from warmstart.operators.ordering import positions_within

    dedup = df.groupBy(row, col).agg((F.max_by(val, F.struct("ts", val)) if "ts" in df.columns else F.max(val)).alias(val))
    pos = positions_within(dedup, row, [col], "_p")
    return (pos.groupBy(row, F.floor(F.col("_p") / max_len).alias("piece"))
            .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(col, val)))).alias("cells")))


def row_l2_normalize(df: DataFrame, row: str, val: str = "rating", out: str = "value") -> DataFrame:
    """Divide each cell of a long (row, col, val) table by its row's L2 norm; zero rows stay 0.

    The norm is an aggregate joined back on the row key (no window sort).
    """
    norms = df.groupBy(row).agg(F.sqrt(F.sum(F.col(val) * F.col(val))).alias("_norm"))
    return (df.join(norms, row)
            .withColumn(out, F.when(F.col("_norm") > 0, F.col(val) / F.col("_norm")).otherwise(F.lit(0.0)))
            .drop("_norm"))


def token_counts(df: DataFrame, id_col: str, text_col: str, pattern: str | None = None) -> DataFrame:
    """Bag-of-words counts ``(id, token, cnt)`` per text."""
    from warmstart.functions.text import WORD_PATTERN

    pat = pattern or WORD_PATTERN
    return (df.select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pat), 0)).alias("token"))
            .groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("cnt")))

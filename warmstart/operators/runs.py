"""Experiment-run analytics.

A *run* is one trained model: its configuration plus per-epoch ``loss`` and
``val_loss``. Two equivalent forms are supported: the nested form read from the
runs' ``config.json`` files (``results.loss``/``results.val_loss`` arrays, see
``sources.readers.read_runs``) and the long form ``(run_id, epoch, loss, val_loss)``.
Column names: ``dataset, method, init, lim, split, last_epoch, is_complete``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warmstart.functions.text import run_key, scenario_label
from warmstart.session import cut_lineage

# Datasets whose epoch alignment is per (dataset, method, limit, init).
PER_INIT_DATASETS = ["ML100k", "ML1M"]
# Dataset renamed while reading runs.
DATASET_ALIASES = {"ExplicitML100kLeakage": "ExplicitMLTransfer"}
# One method renamed before alignment.
METHOD_RENAMES = {"Pretrained from ML100kNegativeLeakage": "Pretrained from ML100kNegativeLeakage_random"}
# Ordered levels of the initialisation factor.
INIT_LEVELS = ["random", "pca", "word2vec"]
# Report labels of the source initialisations.
SOURCE_LABELS = {"random": "Random", "pca": "PCA", "word2vec": "Word2vec"}
METHOD_LABELS = {"random": "Pretrained with Random", "pca": "Pretrained with PCA",
                 "word2vec": "Pretrained with Word2Vec"}
VALID_LIMITS = [v / 10 for v in range(11)]
CONFIG_KEY = ["dataset", "method", "lim", "init", "split"]


def _map(col, mapping: dict):
    out = None
    for k, v in mapping.items():
        out = (F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v)))
    return out.otherwise(col) if out is not None else col


# ---------------------------------------------------------------- nested <-> long
def with_results(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Attach ``results{loss[], val_loss[]}`` (epoch order) from the long metrics table."""
    arr = (metrics.groupBy("run_id")
           .agg(F.sort_array(F.collect_list(F.struct("epoch", "loss", "val_loss"))).alias("_r")))
    res = F.struct(F.transform("_r", lambda x: x["loss"]).alias("loss"),
                   F.transform("_r", lambda x: x["val_loss"]).alias("val_loss"))
    return runs.join(arr, "run_id", "left").withColumn("results", res).drop("_r")


def metrics_long(runs: DataFrame) -> DataFrame:
    """Long ``(run_id, epoch, loss, val_loss)`` from the nested ``results`` arrays."""
    z = F.arrays_zip(F.col("results.loss").alias("loss"), F.col("results.val_loss").alias("val_loss"))
    return (runs.select("run_id", F.posexplode(z).alias("epoch", "r"))
            .select("run_id", F.col("epoch").cast("int").alias("epoch"), "r.loss", "r.val_loss"))


# ---------------------------------------------------------------- filters / labels
def normalize_run_labels(runs: DataFrame) -> DataFrame:
    """``Pretrained from X_m`` -> ``Pretrained from m``; dataset aliases."""
    m = F.col("method")
    short = F.concat(F.lit("Pretrained from "), F.element_at(F.split(m, "_"), 2))
    return (runs.withColumn("method", F.when(m.startswith("Pretrained") & F.instr(m, "_").__gt__(0), short)
                            .otherwise(m))
            .withColumn("dataset", _map(F.col("dataset"), DATASET_ALIASES)))


def complete_runs(runs: DataFrame) -> DataFrame:
    """S9 filters: runs with a method, not marked incomplete (a missing flag counts as complete)."""
    return runs.filter(F.col("method").isNotNull() & F.coalesce(F.col("is_complete"), F.lit(True)))


def dedupe_runs(runs: DataFrame, key: list[str] | None = None, order: str = "run_id") -> DataFrame:
    """First run of each configuration (explicit order: smallest ``order``)."""
    key = key or CONFIG_KEY
    w = Window.partitionBy(*key).orderBy(order)
    return runs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def valid_limits(df: DataFrame) -> DataFrame:
    """Limits 0, 0.1, ..., 1 and a known init."""
    return df.filter(F.col("lim").isin(VALID_LIMITS) & F.col("init").isNotNull())


def init_ordinal(df: DataFrame, col: str = "init") -> DataFrame:
    """O2: ordinal of the ordered init factor (random < pca < word2vec)."""
    return df.withColumn(f"{col}_order", F.array_position(F.array(*[F.lit(x) for x in INIT_LEVELS]), F.col(col)).cast("int") - 1)


def sort_runs(runs: DataFrame) -> DataFrame:
    """O1: order by dataset, split, init; ties by ``run_id`` if there is one."""
    return runs.orderBy("dataset", "split", "init", *(["run_id"] if "run_id" in runs.columns else []))


def with_position(ordered: DataFrame, name: str = "pos") -> DataFrame:
    """Place of each row of an ordered table, from 0: partition offset plus place inside the partition."""
    tagged = cut_lineage(ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), F.min("_mono").alias("first")).orderBy("_pid").collect()
    shifts, before = [], 0
    for r in counts:  # one row per partition
        shifts.append((r["_pid"], before - r["first"]))
        before += r["n"]
    shift = ordered.sparkSession.createDataFrame(shifts, "_pid int, _shift long")
    return tagged.join(F.broadcast(shift), "_pid").withColumn(name, F.col("_mono") + F.col("_shift")).drop("_pid", "_mono", "_shift")


# ---------------------------------------------------------------- epochs
def min_epochs(runs: DataFrame) -> DataFrame:
    """Minimum ``last_epoch`` by (dataset, method, lim, init) and by (dataset, method, lim), in one pass."""
    g = runs.groupingSets([["dataset", "method", "lim", "init"], ["dataset", "method", "lim"]],
                          "dataset", "method", "lim", "init")
    return g.agg(F.min("last_epoch").alias("min_epoch"), F.grouping_id().alias("level"))


#: Groups of the epoch alignment up to which their minima are broadcast; they are counted first.
MAX_GROUPS = 100_000


def align_epoch(runs: DataFrame) -> DataFrame:
    """Every run's RMSE at its group's minimum ``last_epoch``.

    Group = (dataset, method, lim, init) for ``PER_INIT_DATASETS``, else
    (dataset, method, lim) over the other datasets. ``rmse2 = val_loss[epoch - 1]``,
    the last value when out of range. The minima are an aggregate over the configurations only; joined back by broadcast, the
    element is taken where the run lies and no ``val_loss`` array is shuffled.
    """
    key = ["dataset", "method", "lim", "_per_init", "_init"]
    keyed = (runs.withColumn("_per_init", F.col("dataset").isin(PER_INIT_DATASETS))
             .withColumn("_init", F.when(F.col("_per_init"), F.col("init"))))
    least = cut_lineage(keyed.groupBy(*key).agg(F.min("last_epoch").alias("last_epoch2")))
    side = least.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), "last_epoch2")
    side = F.broadcast(side) if least.count() <= MAX_GROUPS else side
    same = F.lit(True)
    for i, c in enumerate(key):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    vl, n = F.col("results.val_loss"), F.size("results.val_loss")
    value = (F.when((F.col("last_epoch2") >= 1) & (F.col("last_epoch2") <= n), F.element_at(vl, F.col("last_epoch2").cast("int")))
             .otherwise(F.element_at(vl, -1)))
    return keyed.join(side, same).select(*runs.columns, "last_epoch2", value.alias("rmse2"))


def early_stop_epoch(metrics: DataFrame, patience: int = 5) -> DataFrame:
    """Epoch at which early stopping would fire (null when it never fires).

    A strict improvement over the best so far resets the counter; training stops at
    the first epoch that ends ``patience + 1`` consecutive non-improving epochs.
    """
    w_prev = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    w_run = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    m = (metrics.withColumn("_best", F.min("val_loss").over(w_prev))
         .withColumn("_imp", F.when(F.col("_best").isNull() | (F.col("val_loss") < F.col("_best")), 1).otherwise(0))
         .withColumn("_grp", F.sum("_imp").over(w_run)))
    w_grp = Window.partitionBy("run_id", "_grp").orderBy("epoch")
    m = m.withColumn("_stale", F.row_number().over(w_grp) - 1)
    return (m.groupBy("run_id")
            .agg(F.min(F.when(F.col("_stale") >= patience + 1, F.col("epoch"))).alias("stop_epoch"),
                 F.count(F.lit(1)).alias("n_epochs")))


def final_metrics(metrics: DataFrame) -> DataFrame:
    """Last ``val_loss`` (the stored RMSE) and the best one with its epoch."""
    return metrics.groupBy("run_id").agg(
        F.max_by("val_loss", "epoch").alias("final_rmse"),
        F.min("val_loss").alias("best_rmse"),
        F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"))


# ---------------------------------------------------------------- summaries
def group_rmse(aligned: DataFrame) -> DataFrame:
    """A10: mean, sample std and count of the aligned RMSE per (dataset, method, init, lim)."""
    return (aligned.groupBy("dataset", "method", "init", "lim")
            .agg(F.avg("rmse2").alias("rmse_mean"), F.stddev_samp("rmse2").alias("rmse_std"),
                 F.count("rmse2").alias("count")))


def summarize_runs(aligned: DataFrame) -> DataFrame:
    """A10 + P8 + O2: the grouped RMSE on valid limits, with the init ordinal."""
    return init_ordinal(valid_limits(group_rmse(aligned)))


def analyze_runs(runs: DataFrame) -> DataFrame:
    """S9 filters -> P7 -> W8 -> J11 -> A10 -> P8 -> O2 on nested runs."""
    r = normalize_run_labels(complete_runs(runs))
    r = dedupe_runs(r)
    r = r.withColumn("method", _map(F.col("method"), METHOD_RENAMES))
    return summarize_runs(align_epoch(r))


def report_scenarios(results: DataFrame) -> DataFrame:
    """Report rows: limit 1 of each source, plus the random-source baseline (limit 0,
    init random, relabelled), labelled ``"<Source> to <Init>"``; keeps init random/Baseline.

    ``results`` is the A10 table with a ``source`` column (random / pca / word2vec)."""
    src_label = _map(F.col("source"), SOURCE_LABELS)
    top = results.filter(F.col("lim") == 1).withColumn("source", src_label)
    base = (results.filter((F.col("source") == "random") & (F.col("lim") == 0) & (F.col("init") == "random"))
            .withColumn("source", F.lit("Baseline")).withColumn("init", F.lit("Baseline")))
    both = base.unionByName(top)
    scen = F.when(F.col("source") != "Baseline", scenario_label(F.col("source"), F.col("init"))).otherwise(F.col("source"))
    return (both.withColumn("scenario", F.coalesce(scen, F.lit("Baseline")))
            .filter((F.col("init") == "random") | (F.col("init") == "Baseline")))


def union_results(tables: dict[str, DataFrame]) -> DataFrame:
    """Stack per-source result tables, relabelling ``method`` by source."""
    out = None
    for source, df in tables.items():
        d = df.withColumn("method", F.lit(METHOD_LABELS.get(source, source)))
        out = d if out is None else out.unionByName(d)
    return out


# ---------------------------------------------------------------- catalog / grid
def build_catalog(runs: DataFrame, group_col: str = "dataset") -> DataFrame:
    """One completeness flag per configuration (missing flag = complete) + its key (C14)."""
    return runs.select(F.col(group_col).alias("group"), "init", "method", "lim", "split",
                       F.coalesce(F.col("is_complete"), F.lit(True)).alias("is_complete"),
                       run_key(F.col("init"), F.col("method"), F.col("lim"), F.col("split")).alias("key"))


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """Number of runs per group."""
    return catalog.groupBy("group").agg(F.count(F.lit(1)).alias("n_runs"))


def experiment_grid(keys: DataFrame, inits=tuple(INIT_LEVELS), n_limits: int = 11, n_splits: int = 5) -> DataFrame:
    """Every (init, limit, split) for each row of ``keys`` (e.g. distinct dataset/method).

    Expanded with ``explode`` of literal arrays inside each row, not with a join.
    """
    return (keys.withColumn("init", F.explode(F.array(*[F.lit(i) for i in inits])))
            .withColumn("lim_i", F.explode(F.sequence(F.lit(0), F.lit(n_limits - 1))))
            .withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
            .withColumn("lim", (F.col("lim_i") / 10.0).cast("double")))


def pending_runs(grid: DataFrame, runs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Grid configurations without a complete run: ``never started`` or ``halted``."""
    key = key or ["dataset", "method", "init", "lim_i", "split"]
    r = (runs.withColumn("lim_i", F.round(F.col("lim") * 10).cast("int"))
         .groupBy(*key).agg(F.max(F.coalesce(F.col("is_complete"), F.lit(True)).cast("int")).alias("_done"),
                            F.min("run_id").alias("halted_run")))
    j = grid.join(r, key, "left")
    return (j.filter(F.coalesce(F.col("_done"), F.lit(0)) == 0)
            .withColumn("status", F.when(F.col("_done").isNull(), "never started").otherwise("halted"))
            .withColumn("halted_run", F.when(F.col("_done").isNull(), None).otherwise(F.col("halted_run")))
            .drop("_done"))


def find_run(runs: DataFrame, **config) -> DataFrame:
    """The runs of one configuration; raises when there is none."""
    cond = F.lit(True)
    for k, v in config.items():
        cond = cond & (F.col(k) == F.lit(v))
    out = runs.filter(cond)
    if out.limit(1).count() == 0:
        raise LookupError(f"no run with {config}")
    return out


def eligible_groups(runs: DataFrame, group_col: str = "group", kind_col: str = "kind") -> DataFrame:
    """Groups that have both ``source`` and ``target`` runs."""
    return (runs.groupBy(group_col)
            .agg(F.max((F.col(kind_col) == "source").cast("int")).alias("_s"),
                 F.max((F.col(kind_col) == "target").cast("int")).alias("_t"))
            .filter((F.col("_s") == 1) & (F.col("_t") == 1)).select(group_col))

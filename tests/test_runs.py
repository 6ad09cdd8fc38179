"""Run analytics."""
from pyspark.sql import functions as F

from warmstart.operators import runs as ru
from warmstart.sources import fixtures as fx
from tests.conftest import SF


def _metrics(spark, vals, run=0):
    return spark.createDataFrame([(run, e, v, v) for e, v in enumerate(vals)],
                                 "run_id long, epoch int, loss double, val_loss double")


def test_early_stop_hand_case(spark):
    r = ru.early_stop_epoch(_metrics(spark, [5.0, 4.0, 4.0, 4.0]), patience=1).first()
    assert r["stop_epoch"] == 3


def test_early_stop_never_fires(spark):
    r = ru.early_stop_epoch(_metrics(spark, [5.0, 4.0, 3.0, 2.0]), patience=1).first()
    assert r["stop_epoch"] is None and r["n_epochs"] == 4


def test_early_stop_matches_loop(spark):
    import random

    rnd = random.Random(1)
    vals = [rnd.choice([1.0, 2.0, 3.0]) for _ in range(40)]
    best, left, stop = float("inf"), 2, None
    for e, v in enumerate(vals):
        if v < best:
            best, left = v, 2
        else:
            left -= 1
        if left < 0:
            stop = e
            break
    assert ru.early_stop_epoch(_metrics(spark, vals), patience=2).first()["stop_epoch"] == stop


def test_align_epoch_out_of_range_takes_last(spark):
    runs = spark.createDataFrame(
        [(1, "ML1M", "m", "random", 0.5, 1, 3, True, {"loss": [1.0, 2.0], "val_loss": [0.9, 0.8]}),
         (2, "ML1M", "m", "random", 0.5, 2, 5, True, {"loss": [1.0, 2.0, 3.0], "val_loss": [0.7, 0.6, 0.5]})],
        "run_id long, dataset string, method string, init string, lim double, split int, last_epoch int, "
        "is_complete boolean, results struct<loss:array<double>,val_loss:array<double>>")
    out = {r["run_id"]: r["rmse2"] for r in ru.align_epoch(runs).collect()}
    assert out == {1: 0.8, 2: 0.5}  # group min epoch 3: run 1 has 2 values -> last


def test_normalize_labels(spark):
    df = spark.createDataFrame([("Pretrained from ML1M_pca", "ExplicitML100kLeakage"), ("svd", "ML1M")],
                               "method string, dataset string")
    rows = ru.normalize_run_labels(df).collect()
    assert rows[0]["method"] == "Pretrained from pca" and rows[0]["dataset"] == "ExplicitMLTransfer"
    assert rows[1]["method"] == "svd"


def test_analyze_runs_counts(spark):
    m = fx.run_metrics(spark, SF)
    r = ru.with_results(fx.runs(spark, SF, m), m)
    out = ru.analyze_runs(r)
    assert out.filter("count < 1").count() == 0
    assert set(x["init_order"] for x in out.select("init_order").distinct().collect()) <= {0, 1, 2}


def test_find_run_raises(spark):
    import pytest

    with pytest.raises(LookupError):
        ru.find_run(fx.runs(spark, SF), init="nope")


def test_pending_runs(spark):
    runs = fx.runs(spark, SF)
    grid = ru.experiment_grid(runs.select("dataset", "method").distinct())
    pend = ru.pending_runs(grid, runs)
    n_grid, n_runs = grid.count(), runs.count()
    halted = runs.filter(~F.col("is_complete")).count()
    assert pend.filter("status = 'halted'").count() == halted
    assert pend.filter("status = 'never started'").count() == n_grid - n_runs

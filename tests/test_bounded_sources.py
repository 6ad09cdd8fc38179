"""Sources and statistics whose work grows no faster than the table: derived tables worked out once, bounded tasks and file counts."""
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from warmstart.operators import matching as mt
from warmstart.operators import splits, stats
from warmstart.plans import catalog
from warmstart.sources import fixtures as fx
from warmstart.sources import readers as rd
from warmstart.sources import writers as wr


@pytest.mark.parametrize("name", ["S3_read_predefined_folds", "X3_load_split_halves", "S5_read_many", "A1_fold_stats"])
def test_ratings_are_worked_out_once(spark, rat, monkeypatch, name):
    rows, seen = rat.count(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(fx, "ratings", lambda s, d: rat.mapInArrow(counted, rat.schema))
    catalog.QUERIES[name](spark, SF).count()
    assert seen.value == rows


def test_fold_stats_equal_the_long_form(spark):
    df = splits.kfold(spark.createDataFrame([(u % 7, (u * u) % 5) for u in range(40)] + [(None, 1), (1, None)], "user_id long, item_id long"), 5, 1)
    want = (splits.fold_long(df, 5).groupBy("fold", "split")
            .agg(F.countDistinct("user_id").alias("u"), F.countDistinct("item_id").alias("i"), F.count(F.lit(1)).alias("n")).collect())
    assert sorted(map(tuple, stats.fold_stats(df, 5).collect())) == sorted(map(tuple, want))


def test_sections_of_a_larger_table_come_in_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "SECTION_LINES", 100)
    rat = spark.createDataFrame([(u, u % 200, 3.0) for u in range(1000)], "user_id long, item_id long, rating double").withColumn("ts", F.lit("2000-01-02").cast("date"))
    catalog.write_sectioned(rat, str(tmp_path / "s"), n_files=1)
    files = sorted((tmp_path / "s").glob("part-*"))
    assert len(files) > 5
    back = rd.read_sectioned_ratings(spark, str(tmp_path / "s")).select("user_id", "item_id", "rating")
    assert back.exceptAll(rat.select("user_id", "item_id", "rating")).count() == 0 and back.count() == 1000


def test_run_configs_share_files(spark, tmp_path):
    runs = (spark.range(500, numPartitions=2)
            .select(F.col("id").alias("run"), F.lit("ML1M").alias("dataset"), F.lit("svd").alias("method"), F.lit(0.5).alias("limit"),
                    F.lit(1).alias("dataset_split"), (F.col("id") % 2 == 0).alias("is_complete"),
                    F.expr("named_struct('loss', array(0.5D), 'val_loss', array(id + 0.25D))").alias("results")))
    wr.write_run_configs(runs, str(tmp_path / "runs"))
    assert len(list((tmp_path / "runs").rglob("*.json"))) == 2
    back = {int(r["run"]): r["results"]["val_loss"] for r in rd.read_runs(spark, str(tmp_path / "runs"), pattern="*.json").collect()}
    assert back == {k: [k + 0.25] for k in range(0, 500, 2)}


def test_token_table_sorts_no_tokens(spark):
    keys = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, None), (3, ""), (4, "x")], "sid long, key string")
    got = {(r["sid"], r["token"]): (r["cnt"], round(r["w"], 9)) for r in mt.token_table(keys, "sid").collect()}
    assert got == {(1, "a"): (2, round(2 / 3, 9)), (1, "b"): (2, round(2 / 3, 9)), (1, "c"): (1, round(1 / 3, 9)), (4, "x"): (1, 1.0)}
    assert "Window" not in mt.token_table(keys, "sid")._jdf.queryExecution().optimizedPlan().toString()

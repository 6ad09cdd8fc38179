"""Sources and sinks (S1-S9, K1-K6) and the dataset registry."""
import json

import pytest
from pyspark.sql import functions as F

from warmstart.plans import datasets
from warmstart.plans.catalog import write_sectioned
from warmstart.sources import fixtures as fx
from warmstart.sources import readers as rd
from warmstart.sources import writers as wr
from tests.conftest import SF


def test_sectioned_hand_case(spark, tmp_path):
    p = tmp_path / "combined_data_1.txt"
    p.write_text("1:\n7,3,2005-09-06\n2:\n8,4,2005-09-07\n")
    rows = sorted((r["user_id"], r["item_id"], r["rating"]) for r in rd.read_sectioned_ratings(spark, str(p)).collect())
    assert rows == [(7, 1, 3.0), (8, 2, 4.0)]


def test_sectioned_across_file_splits(spark, rat, tmp_path):
    path = str(tmp_path / "sections")
    write_sectioned(rat, path, n_files=2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")  # many splits per file
    try:
        back = rd.read_sectioned_ratings(spark, path)
        assert back.rdd.getNumPartitions() > 4
        got = back.select("user_id", "item_id", "rating").exceptAll(rat.select("user_id", "item_id", "rating"))
        assert got.count() == 0 and back.count() == rat.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_from_triples_checks_scale(spark):
    df = rd.from_triples(spark, [(1, 2, 3.0), (1, 3, 5)])
    assert df.count() == 2
    with pytest.raises(ValueError):
        rd.from_triples(spark, [(1, 2, 6.0)])


def test_write_split_partitions(spark, rat, tmp_path):
    from warmstart.operators import splits

    lab = splits.split_users_disjoint(rat, 500, 42)
    wr.write_split(lab, str(tmp_path / "split"))
    back = spark.read.option("header", True).csv(str(tmp_path / "split"))
    assert back.count() == rat.count()
    assert {r["part"] for r in back.select("part").distinct().collect()} == {"sample", "rest"}


def test_results_csv_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([(0.0, 1.0, 1.1)], "alphas double, rmse_train double, rmse_test double")
    wr.write_results(df, str(tmp_path / "res"))
    assert spark.read.option("header", True).csv(str(tmp_path / "res")).columns == ["alphas", "rmse_train", "rmse_test"]
    m = spark.createDataFrame([(1, 2)], "source_item long, target_item long")
    path = str(tmp_path / "maps")
    assert wr.read_mapping(spark, path, "a", "b") is None
    wr.upsert_mapping(m, path, "a", "b")
    wr.upsert_mapping(m.withColumn("target_item", F.lit(9)), path, "a", "c")
    assert wr.read_mapping(spark, path, "a", "b").first()["target_item"] == 2
    assert wr.read_mapping(spark, path, "a", "c").first()["target_item"] == 9


def test_read_runs_config_json(spark, tmp_path):
    for k, (complete, method) in enumerate([(True, "svd"), (False, "svd"), (True, None)]):
        d = tmp_path / f"run{k}"
        d.mkdir()
        cfg = {"dataset": "ML1M", "dataset_split": 1, "init": "random", "limit": 0.5, "last_epoch": 2,
               "is_complete": complete, "results": {"loss": [1.0, 0.9], "val_loss": [1.1, 1.0]}, "extra": 1}
        if method:
            cfg["method"] = method
        (d / "config.json").write_text(json.dumps(cfg, indent=4))
    runs = rd.read_runs(spark, str(tmp_path))
    rows = runs.collect()
    assert len(rows) == 1 and rows[0]["run"] == "run0" and rows[0]["results"]["val_loss"] == [1.1, 1.0]


def test_dataset_registry(spark, tmp_path):
    root = tmp_path / "ml1m"
    root.mkdir()
    (root / "ratings.dat").write_text("1::10::5::978300760\n2::10::3::978302109\n")
    (root / "movies.dat").write_bytes("10::Amélie (2001)::Comedy\n".encode("latin-1"))
    ratings, items = datasets.load_dataset(spark, "ML1M", str(root))
    assert ratings.count() == 2 and items.first()["title"] == "Amélie (2001)"
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, "ml2m", str(root))


def test_predefined_folds(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"u{k}.base").write_text(f"1\t{k}\t4\t0\n2\t{k}\t3\t0\n")
        (tmp_path / f"u{k}.test").write_text(f"3\t{k}\t5\t0\n")
    df = datasets.predefined_folds(spark, str(tmp_path))
    got = sorted((r["fold"], r["split"]) for r in df.collect())
    assert got == [(1, "test"), (1, "train"), (1, "train"), (2, "test"), (2, "train"), (2, "train")]


def test_loose_titles(spark, tmp_path):
    p = tmp_path / "movie_titles.csv"
    p.write_bytes("1,2003,Dinosaur Planet\n2,NULL,Isle of Man, TT, 2004\n".encode("latin-1"))
    rows = {r["item_id"]: (r["year"], r["title"]) for r in rd.read_titles_loose_csv(spark, str(p)).collect()}
    assert rows == {1: (2003, "Dinosaur Planet"), 2: (0, "Isle of Man, TT, 2004")}


def test_fixture_ratings_shape(spark):
    r = fx.ratings(spark, SF)
    assert r.groupBy("user_id", "item_id").count().filter("count > 1").count() == 0

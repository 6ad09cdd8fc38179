"""Cases that the fixtures do not reach: duplicate and empty keys, budgets, dense users, crash-safe saves, split files."""
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from warmstart.functions import text as tx
from warmstart.operators import factors as fa
from warmstart.operators import implicit as im
from warmstart.operators import matching as mt
from warmstart.operators import mf, splits
from warmstart.plans import datasets as ds
from warmstart.plans import transfer as tr
from warmstart.session import list_folder, path_exists
from warmstart.sources import writers as wr


def catalog(spark, titles, first=1):
    return spark.createDataFrame([(i, t) for i, t in enumerate(titles, first)], "item_id long, title string")


def test_transliteration_of_other_scripts(spark):
    rows = [("ночной дозор", "nochnoi dozor"), ("αθήνα", "athena"), ("ｆｕｌｌ", "full"), ("ṩ ḿ", "s m"), ("ßæø", "ssaeo"), ("東京", "東京")]
    got = spark.createDataFrame(rows, "a string, b string").select(tx.unaccent(F.col("a")).alias("u"), "b").collect()
    assert all(r["u"] == r["b"] for r in got)


def test_titles_without_a_key_never_match(spark):
    a = catalog(spark, ["東京 (1999)", "北京 (2000)", "Солярис (1972)", "", None])
    b = catalog(spark, ["上海 (1999)", "Solyaris", "Солярис (1975)", "", None], 100)
    m, left_a, left_b = mt.match_raw_title(a, b)
    assert [(r["source_item"], r["target_item"]) for r in m.collect()] == [(3, 102)]
    assert left_a.count() == 4 and left_b.count() == 4
    m, left_a, _ = mt.match_exact(a, b)
    assert m.count() == 0 and left_a.count() == 5


def test_shared_titles_make_no_pairs(spark):
    a, b = catalog(spark, ["Same"] * 300 + ["Other"]), catalog(spark, ["Same"] * 300, 1000)
    m, left_a, left_b = mt.match_exact(a, b)
    assert m.count() == 300 and {r["target_item"] for r in m.collect()} == {1000}
    assert left_a.count() == 1 and left_b.count() == 0
    assert "CartesianProduct" not in m._jdf.queryExecution().toString()


def test_transfer_budget_counts_usable_pairs(spark):
    mapping = spark.createDataFrame([(i, 100 + i, 1) for i in range(1, 5)], "source_item long, target_item long, stage int")
    vec = lambda ids, v: spark.createDataFrame([(i, [v, v], 0.0) for i in ids], "id long, vec array<double>, bias double")
    out, n = fa.transfer_items(vec(range(101, 105), 0.0), vec([3, 4], 9.0), mapping, 4, 0.5)
    assert n == 2 and {r["id"] for r in out.collect() if r["transferred"]} == {103, 104}


def test_split_at_or_above_the_table_raises(spark):
    rat = spark.createDataFrame([(u, i) for u in range(5) for i in range(4)], "user_id long, item_id long")
    with pytest.raises(ValueError):
        splits.split_users_disjoint(rat, 20)


def test_dense_users_draw_from_their_complement(spark):
    train = spark.createDataFrame([(1, i) for i in range(97)] + [(2, i) for i in range(100)] + [(3, 5)], "user_id long, item_id long")
    test = spark.createDataFrame([(1, 97), (2, 100), (3, 7)], "user_id long, item_id long")
    neg = im.negative_sample(test, train, 20, 1).collect()
    by = {}
    for r in neg:
        by.setdefault(r["user_id"], []).append(r["neg_item"])
    assert set(by) == {1, 3} and len(by[1]) == len(by[3]) == 20  # user 2 has no allowed item
    assert set(by[1]) <= {98, 99} and len(set(by[1])) == 2 and not set(by[3]) & {5, 7}


def test_implicit_folds_equal_single_folds(spark):
    df = spark.createDataFrame([(u, (u * 7 + k * 3) % 31, 1) for u in range(12) for k in range(6)], "user_id long, item_id long, n long")
    folds, meta, neg = im.implicit_dataset(df, 3, 5, 10)
    for f in (1, 2, 3):
        one = im.leave_one_out(df, 5, 1, fold=f).select("user_id", "item_id", "split")
        many = folds.filter(F.col("fold") == f).select("user_id", "item_id", "split")
        assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    assert meta.count() == 3
    test = folds.filter("split = 'test'").select("fold", "user_id").distinct().count()
    assert neg.count() == 10 * test
    hit = neg.join(folds, (neg.fold == folds.fold) & (neg.user_id == folds.user_id) & (neg.neg_item == folds.item_id))
    assert hit.count() == 0


def _tiny(spark):
    train = spark.createDataFrame([(u, i, float((u + i) % 5 + 1)) for u in range(8) for i in range(6)],
                                  "user_id long, item_id long, rating double")
    u = fa.init_random(train.select(F.col("user_id").alias("id")), 4, 0.1, seed=1, side="user")
    i = fa.init_random(train.select(F.col("item_id").alias("id")), 4, 0.1, seed=1, side="item")
    return train, u, i


def test_crash_in_save_keeps_the_last_epoch(spark, tmp_path, monkeypatch):
    train, u, i = _tiny(spark)
    path = str(tmp_path / "state")
    mf.fit(train, u, i, None, epochs=3, lr=0.01, blocks=2, path=path, checkpoint_every=1, max_epochs_this_run=1)

    def lost(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(mf, "json", SimpleNamespace(dumps=lost, loads=json.loads))
    with pytest.raises(RuntimeError):  # the factors of epoch 1 are out, its config is not
        mf.fit(train, u, i, None, epochs=3, lr=0.01, blocks=2, path=path, checkpoint_every=1, max_epochs_this_run=1)
    monkeypatch.setattr(mf, "json", json)
    _, meta = mf.load_checkpoint(spark, path)
    assert meta["last_epoch"] == 0 and path_exists(spark, f"{path}/epoch=1/factors")
    resumed = mf.fit(train, u, i, None, epochs=3, lr=0.01, path=path, checkpoint_every=1)  # keeps the saved blocks
    full = mf.fit(train, u, i, None, epochs=3, lr=0.01, blocks=2)
    assert [round(x, 9) for x in resumed.loss] == [round(x, 9) for x in full.loss]
    assert [p.rpartition("/")[2] for p in list_folder(spark, path)] == ["epoch=2"]
    with pytest.raises(ValueError):
        mf.fit(train, u, i, None, epochs=3, lr=0.01, blocks=3, path=path)


def test_ratings_without_factors_are_an_error(spark):
    train, u, i = _tiny(spark)
    with pytest.raises(ValueError):
        mf.fit(train, u.filter("id > 0"), i, None, epochs=1, blocks=2)


def test_blocks_follow_the_data(spark):
    _, u, i = _tiny(spark)
    assert mf.default_blocks(u, i) == mf.MIN_BLOCKS and mf.default_blocks(u, i, block_rows=0.5) == 16


def test_split_files_are_read_apart(spark, tmp_path):
    rat = spark.createDataFrame([(u, i, 3.0, 5) for u in range(6) for i in range(4)], "user_id long, item_id long, rating double, ts long")
    lab = tr.user_disjoint_sets(rat, 10, out=str(tmp_path), min_ratings=0)
    (tmp_path / "movies.csv").write_text('item_id,title\n0,"A ""quoted"", title (1998)"\n1,Plain\n')
    halves = {p: ds.load_dataset(spark, f"split_{p}", str(tmp_path)) for p in ("sample", "rest")}
    for p, (r, items) in halves.items():
        assert r.count() == lab.filter(F.col("part") == p).count()
        assert items.orderBy("item_id").first()["title"] == 'A "quoted", title (1998)'
    assert not ({r["user_id"] for r in halves["sample"][0].collect()} & {r["user_id"] for r in halves["rest"][0].collect()})
    (tmp_path / "negative_ml1m.csv").write_text("user_id,item_id,rating,timestamp\n7,1,4.0,9\n")
    one, _ = ds.load_dataset(spark, "split_csv", str(tmp_path), ratings_file="negative_ml1m")
    assert [tuple(r) for r in one.collect()] == [(7, 1, 4.0, 9)]
    with pytest.raises(ValueError):
        ds.load_dataset(spark, "split_csv", str(tmp_path))


def test_analysis_and_landscape_jobs(spark, tmp_path):
    train, u, i = _tiny(spark)
    both = train.withColumn("split", F.when(F.col("user_id") < 6, "train").otherwise("test"))
    out = tr.landscape(both, (u, i), (u, i), 3.0, n=5, out=str(tmp_path / "land"))
    rows = out.orderBy("k").collect()
    assert [round(r["alphas"], 2) for r in rows] == [0, 0.25, 0.5, 0.75, 1] and len({round(r["rmse_test"], 9) for r in rows}) == 1
    base = tmp_path / "runs"
    for k in range(4):
        (base / f"r{k}").mkdir(parents=True)
        (base / f"r{k}" / "config.json").write_text(json.dumps({
            "dataset": "ML1M", "dataset_split": k % 2 + 1, "method": "Pretrained from src", "init": "random", "limit": 0.5,
            "last_epoch": 2, "is_complete": True, "results": {"loss": [1.0, 0.9, 0.8], "val_loss": [1.0, 0.9 + k / 100, 0.8 + k / 100]}}))
    res = tr.analyze(spark, str(base), str(tmp_path / "res"))
    assert res.count() == 1 and res.first()["count"] == 2


def test_mapping_errors_are_not_taken_for_absence(spark, tmp_path):
    assert wr.read_mapping(spark, str(tmp_path / "none"), "a", "b") is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        wr.read_mapping(spark, str(tmp_path / "bad"), "a", "b")

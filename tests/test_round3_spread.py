"""Work that grows with the rows: not repeated below a distinct, not tied to the input's files, no Python object a value."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from warmstart.operators import implicit as im
from warmstart.operators import matching as mt
from warmstart.operators.factors import init_random
from warmstart.plans import catalog


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def tables(spark, tmp_path):
    """One-file tables of 40 parts and their orders."""
    k = spark.range(40)
    k.select(F.col("id").alias("p_partkey"), F.lit("steel anvil").alias("p_name"), F.lit("Brand#1").alias("p_brand"),
             F.lit("SMALL TIN").alias("p_type"), (F.col("id") % 9).alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    n = spark.range(4000)
    n.select((F.col("id") % 200).alias("l_orderkey"), (F.col("id") % 40).alias("l_partkey"), (F.col("id") % 50 + 1).alias("l_quantity")
             ).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(200).select(F.col("id").alias("o_orderkey"), (F.col("id") % 97).alias("o_custkey"), F.lit("1995-01-01").alias("o_orderdate")
                            ).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(7).select(F.col("id").alias("vec_id"), F.array_repeat(F.col("id").cast("float"), 64).alias("embedding")
                          ).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_vectors_are_not_worked_out_below_the_distinct(spark):
    ids = spark.range(100).select((F.col("id") % 7).alias("id"))
    rows = init_random(ids, 4).select("id", catalog._posexplode("vec"))
    assert not [line for line in optimized(rows).splitlines() if "Filter" in line and "md5" in line]
    got = {(r["id"], r["k"]): r["v"] for r in rows.collect()}
    want = {(r["id"], k): v for r in init_random(ids, 4).collect() for k, v in enumerate(r["vec"])}
    assert got == want and len(got) == 28


def test_draws_are_placed_without_objects():
    rows, n, width = 10_000, 99, 10
    draws = np.tile(np.arange(n), rows)
    k = pa.ListArray.from_arrays(np.arange(0, rows * n + 1, n, dtype=np.int32), draws)
    one = lambda x: pa.array([x] * rows)
    tracemalloc.start()
    at = im._locate.func(k, one([0, 3]), one([2, 1]), pa.array([width] * rows, pa.int32()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    taken = {0: [1, 4], 3: [5]}
    free = [p for p in range(n + 3) if p % width not in taken.get(p // width, [])]
    got = at[rows - 1].as_py()
    local = pa.array([taken.get(x["c"]) for x in got], pa.list_(pa.int32()))
    place = im._select.func(pa.array([[x["r"]] for x in got]), local).to_pylist()
    assert [x["c"] * width + p[0] for x, p in zip(got, place)] == free[:n]


def test_pairs_are_spread_over_the_tasks(spark, tables):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = catalog._pairs(spark, tables)
        assert pairs.rdd.getNumPartitions() > 1
        assert pairs.count() == 40
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_catalogs_are_spread_before_their_titles_are_cleaned(spark, tables):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        a, b = catalog._cats(spark, tables)
        got = mt.match_items(a, b, fuzzy=False)
        assert "Relation" not in optimized(got)
        assert got.rdd.getNumPartitions() > 2  # of two stages
        assert got.filter("stage = 1").count() == 10
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_transfer_works_the_ratings_out_once(spark, tables):
    got = catalog.QUERIES["J9_transfer_items"](spark, tables)
    assert "l_partkey" not in optimized(got)
    assert got.select("id").distinct().count() == 40

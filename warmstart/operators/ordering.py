"""Global positions and prefix sums without a single-partition window.

A ``row_number() over (order by k)`` moves every row to one task. Instead the
rows are range partitioned and sorted inside each partition; each row's position
is its position inside the partition plus the number of rows in all earlier
partitions. The per-partition counts are one row per partition, so the small
table that passes through the driver is bounded by the partition count, never by
the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warmstart.session import cut_lineage


def global_index(df: DataFrame, order_cols: list[str], name: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Add a dense 0-based position in ``order_cols`` order (ties must be broken by the caller)."""
    spark = df.sparkSession
    ranged = (df.repartitionByRange(num_partitions, *order_cols) if num_partitions
              else df.repartitionByRange(*order_cols))
    tagged = (ranged.sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mono", F.monotonically_increasing_id()))
    # Range boundaries come from a sample; pin them (and the positions) so a retried
    # task or a second action sees the same layout.
    tagged = cut_lineage(tagged)
    counts = (tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mono").alias("_first"))
              .orderBy("_pid").collect())  # one row per partition
    before = np.concatenate([[0], np.cumsum([r["_cnt"] for r in counts])[:-1]]) if counts else []
    shifts = [(int(r["_pid"]), int(b) - int(r["_first"])) for r, b in zip(counts, before)]
    shift_df = spark.createDataFrame(shifts, "_pid int, _shift long")
    return (tagged.join(F.broadcast(shift_df), "_pid")
            .withColumn(name, F.col("_mono") + F.col("_shift"))
            .drop("_pid", "_mono", "_shift"))


def hashed_prefix_sum(df: DataFrame, hash_col: str, tie_col: str, weight_col: str,
                      out: str = "before", bucket_bits: int = 16) -> DataFrame:
    """Exclusive running sum of ``weight_col`` in ``(hash_col, tie_col)`` order.

    ``hash_col`` must be a uniform unsigned 32-bit hash (see ``functions.seeded``),
    so its top ``bucket_bits`` bits split the rows into evenly sized buckets with no
    sampling. Bucket totals (at most ``2**bucket_bits`` rows) are prefix-summed on the
    driver; the running sum inside a bucket is a window partitioned by bucket.
    """
    spark = df.sparkSession
    b = F.shiftright(F.col(hash_col), 32 - bucket_bits)
    keyed = df.withColumn("_b", b)
    totals = keyed.groupBy("_b").agg(F.sum(weight_col).alias("_tot")).orderBy("_b").collect()
    offs, acc = [], 0
    for r in totals:
        offs.append((int(r["_b"]), int(acc)))
        acc += r["_tot"]
    off_df = spark.createDataFrame(offs, "_b long, _off long")
    from pyspark.sql import Window

    w = Window.partitionBy("_b").orderBy(hash_col, tie_col).rowsBetween(Window.unboundedPreceding, -1)
    return (keyed.join(F.broadcast(off_df), "_b")
            .withColumn(out, F.col("_off") + F.coalesce(F.sum(weight_col).over(w), F.lit(0)))
            .drop("_b", "_off"))


def positions_within(df: DataFrame, key: str, order_cols: list[str], name: str = "pos") -> DataFrame:
    """0-based position of each row inside its ``key`` group in ``order_cols`` order.

    Global position in ``(key, order...)`` order minus the position of the group's
    first row: a group holding a third of all rows is spread over many range
    partitions instead of being sorted by one task."""
    g = global_index(df, [key] + list(order_cols), "_g")
    first = g.groupBy(key).agg(F.min("_g").alias("_f"))
    return g.join(first, key).withColumn(name, F.col("_g") - F.col("_f")).drop("_g", "_f")

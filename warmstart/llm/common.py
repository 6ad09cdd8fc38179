"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warmstart.session import scratch_path

# Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows no model may learn from (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), 0)), F.lit(0)).cast("long")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` does not use (Spark names ignore case)."""
    used, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in used:
            n = "_" + n
        used.add(n.lower())
        out.append(n)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once: an expression named inside a lambda is worked out at every call."""
    return F.transform(F.array(value), lambda v: body(v))[0]


#: Rows of ids (16 bytes each) up to which a table is broadcast; it is counted first.
MAX_BROADCAST_ROWS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint if it has at most MAX_BROADCAST_ROWS rows; else as it is, for a shuffled join."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_ROWS else ids


#: Ranges of the hash among which the cut of a bounded sample is looked for.
SAMPLE_RANGES = 4096


def bounded_sample(rows: DataFrame, id_col: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` of the rows (distinct ids): all of them, or those of the smallest id hashes.

    A first threshold leaves about 1.5 * ``max_rows`` rows, counts per range of the hash (``SAMPLE_RANGES`` at most reach the
    driver) tell how many ranges fit; nothing is sorted and no list of rows is gathered."""
    rows = store(rows.withColumn("__place", F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string")), 11) / F.lit(float(2**53))), "ids")
    total = rows.count()
    if total <= max_rows:
        return rows.drop("__place")
    share = min(1.0, 1.5 * max_rows / total)
    ranged = rows.filter(F.col("__place") < share).withColumn("__range", F.floor(F.col("__place") / share * SAMPLE_RANGES))
    kept, fits = 0, 0
    for r in sorted(ranged.groupBy("__range").count().collect()):
        kept += r["count"]
        if kept > max_rows:
            break
        fits = r["__range"] + 1
    return ranged.filter(F.col("__range") < fits).drop("__place", "__range")


@contextmanager
def arrow_batches(spark: SparkSession, max_bytes: int) -> Iterator[None]:
    """Jobs run inside hand rows to Python in batches of at most ``max_bytes`` (or one row); the setting before returns after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max_bytes))
    try:
        yield
    finally:
        spark.conf.set(name, before)

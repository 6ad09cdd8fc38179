"""Readers for the rating-dump layouts.

All readers take explicit schemas (no inference) and read a whole path, glob or
list of paths in one scan, so Spark splits files across tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warmstart.functions.text import clean_year, parse_date

RATING_COLS = ("user_id", "item_id", "rating", "ts")


def ratings_schema(id_type: T.DataType = T.LongType(), ts_type: T.DataType = T.LongType()) -> T.StructType:
    return T.StructType([T.StructField("user_id", id_type), T.StructField("item_id", id_type),
                         T.StructField("rating", T.DoubleType()), T.StructField("ts", ts_type)])


def read_ratings(spark: SparkSession, path, sep: str = "\t", header: bool = False,
                 schema: T.StructType | None = None) -> DataFrame:
    """Delimited ``user, item, rating, timestamp`` (separators ``\\t``, ``::``, ``,``)."""
    return (spark.read.schema(schema or ratings_schema()).option("sep", sep).option("header", header)
            .option("mode", "FAILFAST").csv(path))


def read_items(spark: SparkSession, path, sep: str = "|", header: bool = False, encoding: str = "ISO-8859-1",
               with_year: bool = False) -> DataFrame:
    """Item catalog ``(item_id, title[, year])``; extra columns are ignored, a null year is 0."""
    fields = [T.StructField("item_id", T.LongType())]
    if with_year:
        fields.append(T.StructField("year", T.StringType()))
    fields.append(T.StructField("title", T.StringType()))
    df = (spark.read.schema(T.StructType(fields)).option("sep", sep).option("header", header)
          .option("encoding", encoding).option("escape", '"').csv(path))  # a quote in a title is doubled
    if with_year:
        df = df.withColumn("year", clean_year(F.col("year")))
    return df


def read_predefined_folds(spark: SparkSession, path_glob: str, sep: str = "\t") -> DataFrame:
    """S3: pre-made ``u{k}.base`` / ``u{k}.test`` files in one scan; ``fold``/``split`` from the file name."""
    df = (spark.read.schema(ratings_schema()).option("sep", sep).csv(path_glob)
          .withColumn("_f", F.col("_metadata.file_path")))
    name = r"u(\d+)\.(base|test)(?:/[^/]*)?$"  # a file, or a folder of part files
    return (df.withColumn("fold", F.regexp_extract("_f", name, 1).cast("int"))
            .withColumn("split", F.when(F.regexp_extract("_f", name, 2) == "base", "train").otherwise("test"))
            .drop("_f"))


def _ffill_chunks(batches):
    """Within each (file, split) chunk, in scan order: carry the last ``<id>:`` header forward."""
    last: dict = {}
    for pdf in batches:
        if len(pdf) == 0:
            yield pdf.assign(movie=pd.Series([], dtype="float64"))
            continue
        hdr = pdf["value"].str.extract(r"^\s*(\d+):\s*$")[0]
        hdr = pd.to_numeric(hdr, errors="coerce")
        key = pdf["_file"].astype(str) + "#" + pdf["_start"].astype(str)
        out = []
        for k, h in zip(key.tolist(), hdr.tolist()):
            if h == h:  # not NaN: a header line
                last[k] = h
            out.append(last.get(k, float("nan")))
        yield pdf.assign(movie=out)


def read_sectioned_ratings(spark: SparkSession, paths, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """S4 + S5: files of ``<item>:`` header lines, each followed by ``user,rating,date`` lines.

    Forward fill without a single-partition window: each file split is filled in
    scan order inside its task; the rows before a split's first header take the
    last header of the previous splits of the same file, from a table with one
    row per split.
    """
    raw = (spark.read.text(paths)
           .select("value", F.col("_metadata.file_path").alias("_file"),
                   F.col("_metadata.file_block_start").alias("_start"))
           .withColumn("_pos", F.monotonically_increasing_id()))
    filled = raw.mapInPandas(_ffill_chunks,
                             "value string, _file string, _start long, _pos long, movie double")
    # header of each split's last line, then carried across the splits of a file
    chunk_last = filled.groupBy("_file", "_start").agg(F.max_by("movie", "_pos").alias("_last"))
    w = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunk_last.withColumn("_carry", F.last("_last", ignorenulls=True).over(w)).select("_file", "_start", "_carry")
    data = filled.filter(~F.col("value").rlike(r"^\s*\d+:\s*$") & (F.length(F.trim("value")) > 0))
    parts = F.split(F.col("value"), ",")
    # one row per split: small, and a join on the split would sort all its lines in one task
    return (data.join(F.broadcast(carry), ["_file", "_start"])
            .select(parts.getItem(0).cast("long").alias("user_id"),
                    F.coalesce(F.col("movie"), F.col("_carry")).cast("long").alias("item_id"),
                    parts.getItem(1).cast("double").alias("rating"),
                    parse_date(parts.getItem(2), date_format).alias("ts")))


def read_titles_loose_csv(spark: SparkSession, path, n_split: int = 2, encoding: str = "ISO-8859-1") -> DataFrame:
    """``item,year,title`` where only the first ``n_split`` commas separate (titles keep theirs)."""
    lines = (spark.read.schema("value string").option("sep", "\u0001").option("quote", "\u0000")
             .option("encoding", encoding).csv(path))
    p = F.split(F.col("value"), ",", n_split + 1)
    return lines.select(p.getItem(0).cast("long").alias("item_id"), clean_year(p.getItem(1)).alias("year"),
                        p.getItem(2).alias("title"))


def from_triples(spark: SparkSession, rows, id_type: T.DataType = T.LongType(),
                 rating_scale: tuple[float, float] = (1.0, 5.0)) -> DataFrame:
    """An in-memory list of ``(user, item, rating)`` as a ratings frame (ratings checked against the scale)."""
    lo, hi = rating_scale
    for r in rows:
        if not lo <= float(r[2]) <= hi:
            raise ValueError(f"rating {r[2]} outside {rating_scale}")
    schema = T.StructType([T.StructField("user_id", id_type), T.StructField("item_id", id_type),
                           T.StructField("rating", T.DoubleType())])
    return spark.createDataFrame([(r[0], r[1], float(r[2])) for r in rows], schema)


def read_ratings_list(spark: SparkSession, path, sep: str = "\t") -> DataFrame:
    """``user item rating`` triples written by K1."""
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("item_id", T.LongType()),
                           T.StructField("rating", T.DoubleType())])
    return spark.read.schema(schema).option("sep", sep).csv(path)


def read_negatives(spark: SparkSession, path) -> DataFrame:
    """Negatives lines: ``('u', 'i')`` then the sampled items -> ``(user_id, pos_item, j, neg_item)``."""
    lines = spark.read.text(path)
    cells = F.split(F.col("value"), "\t")
    head = F.regexp_extract(cells.getItem(0), r"^\('([^']*)', '([^']*)'\)$", 1)
    pos = F.regexp_extract(cells.getItem(0), r"^\('([^']*)', '([^']*)'\)$", 2)
    rest = F.slice(cells, 2, F.size(cells) - 1)
    return (lines.select(head.cast("long").alias("user_id"), pos.cast("long").alias("pos_item"),
                         F.posexplode(rest).alias("j", "neg"))
            .select("user_id", "pos_item", F.col("j").cast("int").alias("j"), F.col("neg").cast("long").alias("neg_item")))


RUN_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("dataset_split", T.IntegerType()),
    T.StructField("method", T.StringType()), T.StructField("init", T.StringType()),
    T.StructField("limit", T.DoubleType()), T.StructField("last_epoch", T.IntegerType()),
    T.StructField("rmse", T.DoubleType()), T.StructField("n_emb", T.DoubleType()),
    T.StructField("is_complete", T.BooleanType()),
    T.StructField("results", T.StructType([T.StructField("loss", T.ArrayType(T.DoubleType())),
                                           T.StructField("val_loss", T.ArrayType(T.DoubleType()))])),
])


def read_runs(spark: SparkSession, path: str, complete_only: bool = True, pattern: str = "*/config.json") -> DataFrame:
    """Every ``<path>/<run>/config.json``; the kept columns only; runs without a method and
    incomplete runs dropped. ``run`` = folder name; columns renamed to ``lim``/``split``.

    A ``pattern`` without a folder names files of JSON lines instead, a run each, that carry their ``run``."""
    files = f"{path.rstrip('/')}/{pattern}"
    if "/" in pattern:
        df = (spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(files)
              .withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)))
    else:
        df = spark.read.schema(T.StructType([*RUN_SCHEMA.fields, T.StructField("run", T.StringType())])).json(files)
    df = df.filter(F.col("method").isNotNull())
    if complete_only:
        df = df.filter(F.coalesce(F.col("is_complete"), F.lit(True)))
    return df.withColumnRenamed("limit", "lim").withColumnRenamed("dataset_split", "split")

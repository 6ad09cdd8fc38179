"""A corpus pipeline: documents go in, a mix of clean, distinct documents comes out.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents; the last adds what the mix takes. Models are learned from the stage's own input, the labels table and the
benchmark table, from rows that are not held out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warmstart.llm import decontaminate, langid, mixing, near_dedup, quality_rules
from warmstart.llm.common import held_out, n_words, store, table

#: Documents whose most likely language is less certain than this go.
MIN_LANGUAGE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents of a known language."""
    return langid.keep_languages(docs, ~held_out(F.col("doc_id")), MIN_LANGUAGE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base rules and the learned decision list."""
    return quality_rules.drop_junk(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return near_dedup.drop_near_duplicates(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that leak no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken words of every remaining document."""
    out = mixing.mix(docs, n_words(F.col("text")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "copies", "taken")


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates),
          ("contamination", contamination), ("mixture", mixture)]

#: No SQL: language and quality are learned models. Tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

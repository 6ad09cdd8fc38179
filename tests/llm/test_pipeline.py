import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import SF
from tests.llm.brute import components
from warmstart.llm.common import table


def test_stages_in_turn(spark):
    docs = table(spark, SF, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == table(spark, SF, "documents").columns
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        assert rows.items() <= before.items() and len(rows) > 0.7 * len(before)
        if name == "near_duplicates":
            want = components(before)
            assert set(rows) == {i for i, (n, c) in want.items() if n == 0 or c == i}
        docs, before = spark.createDataFrame(out.collect(), out.schema), rows
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.collect()} == set(before)


def test_stages_on_odd_rows(spark):
    schema = table(spark, SF, "documents").schema
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "word " * 30_000, None, "s", None)]
    docs = spark.createDataFrame(rows, schema).withColumn("score", F.lit(1)).withColumn("size", F.lit(2))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()
        stage(spark, docs.limit(0), SF).collect()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13

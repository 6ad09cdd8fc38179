"""Stream-static scoring equals batch scoring."""
from pyspark.sql import functions as F

from warmstart.operators import factors as fa
from warmstart.sources import fixtures as fx
from warmstart.streaming import scoring
from tests.conftest import SF


def test_stream_scoring_matches_batch(spark, rat, tmp_path):
    src = str(tmp_path / "ratings")
    rat.select("user_id", "item_id", "rating").repartition(3).write.parquet(src)
    users, items = fx.factors(spark, SF, "user", 0, rat), fx.factors(spark, SF, "item", 0, rat)
    stream = spark.readStream.schema("user_id long, item_id long, rating double").option("maxFilesPerTrigger", 1).parquet(src)
    q = (scoring.score_stream(stream, users, items, 3.0).select("user_id", "item_id", "est")
         .writeStream.format("memory").queryName("scored").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("scored")
    want = fa.predict(rat, users, items, 3.0).select("user_id", "item_id", "est")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
    b = scoring.binarize_stream(stream, 3.0)
    assert b.isStreaming and "rating" in b.columns and F is not None

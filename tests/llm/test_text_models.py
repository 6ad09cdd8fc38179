"""Language ID, quality classifier, quality rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from tests.llm.brute import statistics
from warmstart.llm import arrowtext, langid, quality_model, quality_rules
from warmstart.llm.common import held_out, table
from warmstart.llm.queries import QUERIES

EDGE = [None, "", " \t\n", "a", "1 2 3", "\n\n\n", "a b c d e a b c d e", "a b c d e f a b c d e", "é ü ß\né ü ß\n", "x" * 100_000,
        "# ## $%&", "A B   C", "same line\nsame line\n\nsame line", "😀 😀 😀 😀 😀 😀", "\x1c a \x0b b"]


def docs(spark, extra=""):
    rows = [(i, t) for i, t in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_words_and_windows_of_buffers():
    import pyarrow as pa

    texts = ["one two  three", None, "", "a", " b ", "x y z u v w x y z u v"]
    for i, j, buf, offs in arrowtext.slices(pa.array(texts), limit=8):
        starts, ends, row = arrowtext.words(buf, offs)
        got = [[] for _ in range(i, j)]
        for s, e, r in zip(starts, ends, row):
            got[r].append(bytes(buf[s:e]).decode())
        assert got == [(t or "").split() for t in texts[i:j]]
    i, j, buf, offs = next(arrowtext.slices(pa.array(["p q p q"])))
    h = arrowtext.hashes(buf, *arrowtext.words(buf, offs)[:2])
    assert h[0] == h[2] != h[1] == h[3]


def test_language_held_out_accuracy(spark):
    got = QUERIES["op7_language"](spark, SF01).join(table(spark, SF01, "documents").select("doc_id", "lang"), "doc_id")
    r = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert r > 0.97


def test_language_counts_equal_brute_force(spark):
    rows = [("en", "the cat"), ("en", "a hat"), ("fr", "le chat"), (None, "x"), ("fr", None)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    assert model.langs == ["en", "fr"]
    grams = {"en": 0, "fr": 0}
    for lang, t in rows[:3]:
        grams[lang] += sum(max(0, len(t) - n + 1) for n in langid.ORDERS)
    p = np.exp(model.logp[:-1].astype(float))
    assert np.allclose(p.sum(axis=0), 1, atol=1e-4)
    smallest = langid.SMOOTHING / (np.array([grams["en"], grams["fr"]]) + langid.SMOOTHING * langid.BUCKETS)
    assert np.allclose(p.min(axis=0), smallest, rtol=1e-4)


def test_language_edges(spark):
    model = langid.train(spark.createDataFrame([("en", "the cat sat"), ("fr", "le chat")], "lang string, text string"))
    d = docs(spark).withColumn("score", F.lit("clash")).withColumn("__low", F.lit(1))
    got = {r["doc_id"]: r for r in langid.predict(d, model, lang_out="p", score_out="s").collect()}
    for i, t in enumerate(EDGE):
        assert (got[i]["p"] == "und") == (not any(c.isalpha() for c in t or ""))
        assert 0 <= got[i]["s"] <= 1 and got[i]["score"] == "clash"
    none = langid.train(spark.createDataFrame([], "lang string, text string"))
    assert {r["lang_pred"] for r in langid.predict(docs(spark), none).collect()} == {"und"}
    assert langid.keep_languages(docs(spark).withColumn("lang", F.lit("en")).limit(0), F.lit(True), 0.5).count() == 0


def test_language_does_not_depend_on_partitions(spark):
    d = table(spark, SF01, "documents")
    model = langid.train(d)
    one = langid.predict(d.select("doc_id", "text").coalesce(1), model)
    many = langid.predict(d.select("doc_id", "text").repartition(7), model)
    assert one.exceptAll(many).count() == 0


def test_statistics_equal_brute_force(spark):
    rng = random.Random(4)
    rows = list(EDGE) + [" ".join(rng.choice("ab\n c") + rng.choice("xy") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality_rules.with_statistics(d, F.col("text"), "st").select("doc_id", *(f"st.{n}" for n in names)).collect()
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got} == {i: statistics(t) for i, t in enumerate(rows)}


def test_rules_learned_and_applied(spark):
    got = QUERIES["op8_quality_rules"](spark, SF01).join(table(spark, SF01, "labels"), "doc_id")
    r = got.filter(held_out(F.col("doc_id"))).agg(
        F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("double"))), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("double")))).first()
    assert r[0] > 0.9 and r[1] < 0.3


def test_rules_without_labels_keep_all_but_base(spark):
    d = docs(spark).withColumn("stats", F.lit("clash"))
    labels = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality_rules.drop_junk(d, labels, F.lit(True)).collect()}
    want = {i for i, t in enumerate(EDGE) for n, *_, rep in [statistics(t)] if n >= 10 and 100 * rep <= 20 * n}
    assert kept == want
    assert quality_rules.drop_junk(d.limit(0), labels, F.lit(True)).columns == d.columns


def test_ordered_expression(spark):
    rules = [[("words", ">", 2.0)], [("symbols_per_word", ">", 0.5), ("words", "<=", 2.0)]]
    d = spark.createDataFrame([(0, "a b c"), (1, "# #"), (2, "a")], "doc_id long, text string")
    got = quality_rules.judge(d, rules).select("doc_id", "stats_verdict.rule").collect()
    assert sorted((r[0], r[1]) for r in got) == [(0, 1), (1, 2), (2, 0)]


def test_quality_model_held_out(spark):
    got = QUERIES["op2_quality_model"](spark, SF01).join(table(spark, SF01, "labels"), "doc_id").filter("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.9 and 0 <= r[1] <= r[2] <= 1


def test_quality_model_edges(spark):
    d = docs(spark).unionByName(docs(spark).limit(2))
    labels = spark.createDataFrame([(1, 1), (3, None)], "doc_id long, quality int")
    got = quality_model.quality_scores(d, labels, F.lit(True)).collect()
    assert len(got) == len(EDGE) + 2 and all(0 <= r["score"] <= 1 for r in got)
    assert quality_model.quality_scores(d.limit(0), labels, F.lit(True)).count() == 0


def test_word_vectors_equal_brute_force(spark):
    texts = ["a b c", "b a!", None, ""]
    got = quality_model.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    import pyarrow as pa

    ids = {}
    for _, _, word, _ in quality_model._buckets(pa.array(["a b c !"])):
        ids = dict(zip("abc!", word))
    want = np.zeros((quality_model.BUCKETS, quality_model.DIM))
    for toks in (["a", "b", "c"], ["b", "a", "!"]):
        for i, w in enumerate(toks):
            for j, v in enumerate(toks):
                if 0 < abs(i - j) <= quality_model.REACH:
                    want[ids[w], quality_model._PLACE[ids[v]]] += quality_model._SIGN
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.maximum(norm, 1e-12), atol=1e-6)


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_network_of_one_class_gives_its_share(share):
    net = quality_model.fit(np.ones((20, 3)), np.full(20, share))
    assert abs(net.score(np.ones((2, 3)))[0] - share) < 1e-5


@pytest.mark.parametrize("n", [0, 5, 100, 3000])
def test_bounded_sample(spark, n):
    from warmstart.llm.common import bounded_sample

    rows = spark.range(n).withColumn("label", F.col("id") % 2)
    got = {r["id"] for r in bounded_sample(rows, "id", 200).collect()}
    assert len(got) == n if n <= 200 else 150 <= len(got) <= 200
    assert got == {r["id"] for r in bounded_sample(rows.repartition(5), "id", 200).collect()}

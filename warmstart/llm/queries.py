"""Registered queries: thin views of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warmstart.llm import (conversations, decontaminate, langid, licenses, mixing, near_dedup, periodic, quality_model,
                           quality_rules, simhash, token_counts, url_filter, warc)
from warmstart.llm.common import WORD, held_out, let, n_words, table
from warmstart.llm.oracle import ORACLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: The list rules of the URL query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]
MIN_QUALITY, TOKEN_LIMIT = 0.3, 4096
TOKENIZER = "piece_bpe_32k.model"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def url_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, label): a page was made from the document whose number is in its path; its quality label decides."""
    doc = F.regexp_extract(url_filter.path(F.col("url")), "/([0-9]{1,18})", 1)
    lab = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    return (pages.select("url", doc.alias("doc")).filter("doc <> ''")
            .select("url", F.col("doc").cast("long").alias("doc_id")).join(lab, "doc_id")
            .select("url", F.when(F.col("q") == 0, "block").otherwise("allow").alias("label")))


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_filter.mine_rules(url_labels(pages, table(spark, sf_dir, "labels")))
    return url_filter.judge(pages, URL_RULES, rules).select("page_id", "judged.*")


@query
def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_model.quality_scores(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
                      (F.col("score") >= MIN_QUALITY).cast("int").alias("predicted"))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document and benchmark item that it leaks."""
    out = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "item_id", "coverage", "windows", "slots", "exact")


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "scan.*")


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~held_out(F.col("doc_id"))))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = quality_rules.labelled_statistics(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    rules = quality_rules.learn(sample.toPandas())
    out = quality_rules.judge(docs, rules, out="stats")
    return out.select("doc_id", *(F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                      "stats_verdict.base_failed", "stats_verdict.kept")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), n_words(F.col("text")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults: by crc32(``conv_id:turn``) % 20, 0 drops a row, 1 empties its text, 2 removes its ends of
    sentences, 3 repeats it, 4 makes it the user's; nulls are one space."""
    given = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat_ws(":", given["conv_id"], given["turn"])) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(given["text"], "[.!?]", "")).otherwise(given["text"])
    return (rows.withColumn("fault", fault).filter("fault <> 0")
            .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(given["role"]).alias("role"), text.alias("text"),
                    F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


@query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.summaries(damaged(rows), rows.select("conv_id"))


def made_periodic(docs: DataFrame) -> DataFrame:
    """With h = crc32(doc_id) and g = h div 10: where h % 10 = 0, each word i >= a of the n becomes word a + (i - a) % p, with
    a = g % n and p = 1 + (n - a) div (3 + g % 8); rows without id or words stay."""
    def periodic_words(w, g):
        n = F.size(w).cast("long")
        a = g % n
        return let(F.struct(n.alias("n"), a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), lambda s: F.concat(
            F.slice(w, F.lit(1), s["a"].cast("int")),
            F.transform(F.sequence(s["a"], s["n"] - 1), lambda i: w[(s["a"] + (i - s["a"]) % s["p"]).cast("int")])))

    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    text = let(words, lambda w: F.when(F.size(w) > 0, F.array_join(periodic_words(w, F.floor(h / 10)), " ")).otherwise(F.lit("")))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), text).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.find_runs(made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"),
                    F.when(F.size("runs") > 0, "\n").otherwise(""))
    return out.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "strongest.*",
                      F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
                      F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in QUERIES}

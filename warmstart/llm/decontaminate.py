"""Benchmark decontamination by template canonicalisation.

Text becomes template words: white-space words with outer marks stripped and lower-cased, numbers, units after
a number and names (capitalised words inside a sentence) replaced by typed placeholders. Benchmark
templates are cut into windows of ``WINDOW`` words (an item with fewer words is one window); those with fewer than
``MIN_LITERAL`` words that are no placeholder (all words, if the window is shorter) say too little and are
left out. Beside them every window is kept as its plain lower-cased words, so a verbatim copy is found whatever
its case, its blanks and its share of placeholders. Windows of all documents meet both by a hash join. Matches of one document
and item on one diagonal (same distance between the two positions) are compared word by word: a slot
conflicts if its value is neither the benchmark's own nor the one that stands for this benchmark value most often.
Windows with a conflicting slot are left out, and each conflicting slot counts against the coverage by
one word. A document leaks an item if the other windows cover at least ``MIN_COVER`` of the item's
words; ``exact`` says that all slot values are the benchmark's own, else the item was re-parameterised.

Documents are scanned once; only the windows that match go on, with their words, so no text is shuffled.
Every benchmark window has an anchor, its longest literal word; only windows of documents that hold an
anchor of some window are hashed, which loses none. Beyond ``MAX_ANCHORS`` anchors all windows are hashed.
The hashes of the benchmark are broadcast while there are at most ``MAX_BROADCAST`` of them (16 bytes
each, counted first), beyond that both sides are shuffled by hash.

Defined results: null and empty texts (documents or items) match nothing; a row is known by its id and text, so
null ids are fine, repeated rows are reported once and all of them are dropped; repeated items are
reported by each item_id; empty tables give an empty report; very long texts are taken whole, their windows being arrays in one
row, so memory grows with the longest text; other columns are ignored by the report and kept by the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmstart.llm.common import fresh, let, store

WINDOW, MIN_LITERAL, MIN_COVER = 8, 4, 0.5
MAX_BROADCAST = 2_000_000
MAX_ANCHORS = 5_000
#: Placeholders: private-use characters, so that no word of a text is taken for one.
NUMBER, UNIT, NAME = "\uE000", "\uE001", "\uE002"
#: Units that may follow a number.
UNITS = ("km|m|cm|mm|miles?|inch(?:es)?|feet|foot|ft|yards?|kg|g|mg|grams?|kilograms?|pounds?|lbs?|ounces?|oz|tons?|l|ml|lit(?:er|re)s?|"
         "gallons?|s|ms|sec(?:ond)?s?|min(?:ute)?s?|h|hours?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|"
         "degrees?|kmh|mph|watts?|volts?|joules?|newtons?")
# A run of marks at the end or the start of a word; a word of marks alone goes altogether.
_EDGE = r"(?=[\p{P}\p{S}])(?:[\p{P}\p{S}]++(?=\s|$)|(?<!\S)[\p{P}\p{S}]+)"
_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """White-space words without the marks at their ends."""
    return F.filter(F.split(F.regexp_replace(text, _EDGE, ""), _GAP), lambda w: w != "")


def template_text(text: Column) -> Column:
    """``text`` in lower case with placeholders; ``words_of`` it and ``words_of`` the lower-cased text are in step."""
    taken = text.contains(NUMBER) | text.contains(UNIT) | text.contains(NAME)
    clean = F.when(taken, F.regexp_replace(text, f"[{NUMBER}{UNIT}{NAME}]", "?")).otherwise(text)
    digits = F.regexp_replace(clean, r"(?<![\p{L}\p{N}])[0-9]+(?:[.,:/][0-9]+)*", NUMBER)
    units = F.regexp_replace(digits, rf"({NUMBER}\s?)(?i:{UNITS})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}")
    numbers = F.when(text.rlike("[0-9]"), units).otherwise(clean)
    # the capital first: the look-behind is tried at capitals only
    names = F.regexp_replace(
        numbers, rf"(?=\p{{Lu}})(?<=[\p{{L}}\p{{N}},;{NUMBER}{UNIT}]\s{{1,2}})\p{{Lu}}[\p{{Ll}}'’-]+(?![\p{{L}}\p{{N}}])", NAME)
    return F.lower(names)


def template(text: Column) -> Column:
    """Template words of ``text``."""
    return words_of(template_text(text))


def _is_slot(word: Column) -> Column:
    return word.contains(NUMBER) | word.contains(UNIT) | word.contains(NAME)


def _windows(words: Column, plain: Column, size: int, anchors: list[str] | None) -> Column:
    """(at, h, tw, ow): place, hash, template words and words of the windows of ``size`` words that hold an anchor; of
    all windows if anchors is None."""
    none = F.array().cast("array<int>")

    def placed(v: Column) -> Column:
        ws = v["w"]
        last = F.size(ws) - size
        starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        if anchors is not None:
            at = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())
            around = F.transform(at, lambda i: F.when(F.greatest(i - (size - 1), F.lit(0)) <= F.least(i, last), F.sequence(
                F.greatest(i - (size - 1), F.lit(0)), F.least(i, last))))
            starts = F.array_distinct(F.flatten(F.filter(around, lambda x: x.isNotNull())))
        return F.transform(F.when(last >= 0, starts).otherwise(none), lambda i: F.struct(
            i.alias("at"), F.xxhash64(F.slice(ws, i + 1, size)).alias("h"), F.slice(ws, i + 1, size).alias("tw"),
            F.slice(v["o"], i + 1, size).alias("ow")))

    return let(F.struct(words.alias("w"), plain.alias("o")), placed)


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, size, item_id, place, n, bw, bo, anchor) of every usable window: its place in an item of n words, its template
    words and words, and its longest literal word; then every window with bw = bo, its words alone."""
    items = benchmark_items(benchmark, id_col, text_col)
    size = F.least(F.lit(WINDOW), F.size("bt"))
    rows = items.withColumn("size", size).withColumn("place", F.explode(F.sequence(F.lit(0), F.size("bt") - F.col("size"))))
    rows = rows.select("size", "item_id", "place", F.size("bt").alias("n"),
                       F.slice("bt", F.col("place") + 1, F.col("size")).alias("bw"),
                       F.slice("bo", F.col("place") + 1, F.col("size")).alias("bo"))
    plain = F.filter("bw", lambda w: ~_is_slot(w))
    # the longest word that is no placeholder, if there is one
    best = F.array_max(F.zip_with("bw", "bo", lambda t, o: F.struct((~_is_slot(t)).alias("l"), F.length(o).alias("n"), o.alias("w"))))
    longest = F.array_max(F.transform(plain, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    template_rows = rows.filter(F.size(plain) >= F.least(F.lit(MIN_LITERAL), F.col("size"))).withColumn("anchor", longest)
    plain_rows = rows.withColumn("anchor", best["w"]).withColumn("bw", F.col("bo"))
    both = template_rows.filter("bw <> bo").unionByName(plain_rows)
    return both.select(F.xxhash64("bw").alias("h"), "size", "item_id", "place", "n", "bw", "bo", "anchor")


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, bt, bo): template words and words of every item with a word."""
    text = F.col(text_col).cast("string")
    return (benchmark.select(F.col(id_col).alias("item_id"), text.alias("t")).distinct()
            .select("item_id", template(F.col("t")).alias("bt"), F.lower(F.col("t")).alias("t"))
            .withColumn("bo", words_of(F.col("t"))).filter("size(bt) > 0").select("item_id", "bt", "bo"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, item_id, coverage, windows, slots, exact) for every leaked item of every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    win = store(benchmark_windows(benchmark), "windows")
    marks = win.select("h").distinct()
    sizes = sorted(r[0] for r in win.select("size").distinct().collect())  # WINDOW values at most
    if win.count() <= MAX_BROADCAST:
        marks = F.broadcast(marks)
    # every window of the benchmark holds its anchor: windows without any anchor cannot match
    anchors = [r[0] for r in win.select("anchor").distinct().limit(MAX_ANCHORS + 1).collect()]
    if len(anchors) > MAX_ANCHORS or None in anchors:
        anchors = None
    marked = rows.select("id", F.xxhash64("text").alias("text_hash"), "text", template_text(F.col("text")).alias("masked"))
    slotted = F.col("masked").contains(NUMBER) | F.col("masked").contains(UNIT) | F.col("masked").contains(NAME)
    words = marked.select("id", "text_hash", words_of(F.col("masked")).alias("dt"),
                          F.when(slotted, words_of(F.lower("text"))).alias("do"))
    plain = F.coalesce("do", "dt")  # without placeholders the template words are the words
    none = F.array().cast("array<struct<at:int,h:bigint,tw:array<string>,ow:array<string>>>")
    own = F.coalesce("do", F.array().cast("array<string>"))  # windows of plain words, where they are not the template's
    every = F.concat(none, *(_windows(F.col("dt"), plain, s, anchors) for s in sizes), *(_windows(own, own, s, anchors) for s in sizes))
    hits = (words.select("id", "text_hash", F.explode(every).alias("w"))
            .select("id", "text_hash", "w.at", "w.h", "w.tw", "w.ow"))
    # the windows that meet the benchmark are all that goes on
    hits = store(hits.join(marks, "h", "left_semi"), "hits")
    slot = F.filter(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda j: F.struct(
        (F.col("place") + j).alias("p"), F.get("bw", j).alias("t"), F.get("bo", j).alias("b"), F.get("ow", j).alias("d"))), lambda x: _is_slot(x["t"]))
    same = (hits.join(win, "h").filter("tw = bw")  # a hash may collide
            .select("id", "text_hash", "item_id", "n", (F.col("at") - F.col("place")).alias("shift"), "place",
                    F.sequence("place", F.col("place") + F.col("size") - 1).alias("covers"), slot.alias("slots")))
    # a diagonal has twice as many windows as the item has words at most
    diagonal = (same.groupBy("id", "text_hash", "item_id", "n", "shift")
                .agg(F.collect_set(F.struct("place", "covers", "slots")).alias("w"))
                .withColumn("slots", F.array_distinct(F.flatten(F.transform("w", lambda w: w["slots"])))))
    values = F.size(F.array_distinct(F.transform("slots", lambda s: s["b"])))
    pairs = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["b"], s["d"]))))
    exact = F.forall("slots", lambda s: s["b"].eqNullSafe(s["d"]))

    def times(s: Column) -> Column:
        return F.size(F.filter("slots", lambda x: (x["b"] == s["b"]) & (x["d"] == s["d"])))

    def conflicts(s: Column) -> Column:
        return (s["d"] != s["b"]) & F.exists("slots", lambda x: (x["b"] == s["b"]) & (x["d"] != s["d"]) & (times(x) >= times(s)))

    bad = F.when(pairs > values, F.transform(F.filter("slots", conflicts), lambda s: s["p"])).otherwise(F.array().cast("array<int>"))
    kept = F.filter("w", lambda w: ~F.exists(w["slots"], lambda s: F.array_contains(F.col("bad"), s["p"])))
    diagonal = (diagonal.withColumn("values", values).withColumn("exact", exact).withColumn("bad", F.array_distinct(bad))
                .withColumn("w", kept).filter("size(w) > 0")
                .select("id", "text_hash", "item_id", "n", "values", "exact", "bad",
                        F.array_distinct(F.flatten(F.transform("w", lambda w: w["covers"]))).alias("covered"),
                        F.size(F.array_distinct(F.transform("w", lambda w: w["place"]))).alias("windows")))
    covered = F.array_distinct(F.flatten(F.collect_set("covered")))
    # a slot that another diagonal has right is no conflict of the document
    lost = F.array_except(F.array_distinct(F.flatten(F.collect_set("bad"))), covered)
    return (diagonal.groupBy("id", "text_hash", "item_id", "n")
            .agg((F.size(covered) - F.size(lost)).alias("c"), F.sum("windows").alias("windows"),
                 F.sum("values").alias("slots"), F.every("exact").alias("exact"))
            .withColumn("coverage", F.col("c") / F.col("n")).filter(F.col("coverage") >= MIN_COVER)
            .select("id", "text_hash", "item_id", "coverage", "windows", "slots", "exact"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (same columns) without the documents that leak a benchmark item."""
    i, h = fresh(docs, "__id", "__hash")
    bad = leaks(docs, benchmark, id_col, text_col).select(F.col("id").alias(i), F.col("text_hash").alias(h)).distinct()
    text_hash = F.xxhash64(F.col(text_col).cast("string"))
    return docs.join(bad, docs[id_col].eqNullSafe(F.col(i)) & (text_hash == F.col(h)), "left_anti").select(*docs.columns)

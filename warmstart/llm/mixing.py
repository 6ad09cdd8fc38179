"""Mixing sources to target weights by Pareto order sampling.

Sources get shares of ``budget`` times all words by weight; a target stops at ``cap`` times the source's
own words and the excess is shared among the others by weight until none is above. A source's target over its words
has a whole part, copies that every document gets for certain, and a fraction ``f``, the share of its words to draw once
more. Inclusion is unequal, longer documents are likelier: ``p = f + min(f, 1 - f) * (h - mean of h)``
with ``h = size / (size + mean size)`` and its mean weighted by size, so the expected words are those needed. Documents are
ranked by their random odds divided by their inclusion odds, ``(u / (1 - u)) / (p / (1 - p))`` (Pareto order sampling, Rosen
1997), and each source takes the first ones until the words it still needs are reached (to half a document). ``u`` is a hash
of the seed, the id and the size, so reruns agree.

A source is never ranked in one task: the ratio q of odds, as ``v = q / (1 + q)``, is cut into ``BINS`` x ``BINS``
ranges, word sums per range find the range in which the cut falls, and only the documents of that range are ordered. The source table (one row a source) is the only thing that
is numbered as a whole, by ``global_index``.

Defined results: null texts count 0 words and take 0; a null source is a source of its own, after all others;
null ids are hashed as such; equal rows have equal ranks and are ordered by id and size, so one of
them may be taken when the other is not; an empty table, or one without words, gives targets of 0; of a text, however long, only
its size counts; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warmstart.llm.common import store
from warmstart.operators.ordering import global_index

WEIGHTS = (3, 1, 2)
BUDGET, CAP, BINS, SEED = 1.5, 2.0, 1024, 17


def random_unit(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) with 52 random bits from the MD5 of the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET,
                   cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size) rows; weights repeat over the sources in
    code-point order, null last."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("last", F.col("source").isNull().cast("int"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    src = store(global_index(per, ["last", "source"], "place").withColumn("weight", weight)
                .withColumn("most", F.col("source_size") * F.lit(float(cap))).drop("last"), "sources")
    total = src.agg(F.sum("source_size")).first()[0] or 0
    # water-filling: the level is a scalar, each round sums the source table once
    level, capped = 0.0, -1
    while True:
        above = F.col("most") <= F.lit(level) * F.col("weight")
        n, fixed, open_weight = src.agg(F.sum(above.cast("int")), F.sum(F.when(above, F.col("most"))),
                                        F.sum(F.when(~above, F.col("weight")))).first()
        if (n or 0) == capped or not open_weight:
            break
        capped, level = n or 0, (budget * total - (fixed or 0.0)) / open_weight
    return src.select("source", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def _ranked(rows: DataFrame, targets: DataFrame, u: Column) -> DataFrame:
    """``rows`` (id, source, size) with their rank v in (0, 1): the ratio q of random to inclusion odds as q / (1 + q).

    Where a source has nothing left to draw v is u."""
    per = (rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
           .select(F.col("source").alias("s"), "words", (F.col("words") / F.col("docs")).alias("mean")))
    h = F.when(F.col("words") > 0, F.col("size") / (F.col("size") + F.col("mean"))).otherwise(0.0)
    same = F.col("source").eqNullSafe(F.col("s"))
    sized = rows.join(per, same).withColumn("h", h)
    centre = (sized.groupBy("s", "words").agg(F.sum(F.col("size") * F.col("h")).alias("sum"))
              .select(F.col("s").alias("c"), F.when(F.col("words") > 0, F.round(F.col("sum") / F.col("words"), 9)).otherwise(0.0).alias("centre")))
    fraction = targets.select(F.col("source").alias("t"), "f")
    sized = (sized.join(centre, F.col("s").eqNullSafe(F.col("c"))).join(fraction, F.col("s").eqNullSafe(F.col("t"))).withColumn("u", u))
    p = F.when(F.col("f") > 0, F.col("f") + F.least(F.col("f"), 1 - F.col("f")) * (F.col("h") - F.col("centre"))).otherwise(0.5)
    sized = sized.withColumn("p", p)
    drawn, included = F.col("u") * (1 - F.col("p")), F.col("p") * (1 - F.col("u"))
    return sized.select("id", "source", "size", (drawn / (drawn + included)).alias("v"))


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED,
        weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(id, size, source_size, target, copies, taken), a row for every row of ``docs``."""
    rows = store(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size")),
                 "sizes")
    tgt = store(source_targets(rows, weights, budget, cap)
                .withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
                .withColumn("whole", F.floor("copies")).withColumn("f", F.col("copies") - F.col("whole"))
                .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    rows = store(_ranked(rows, tgt, random_unit(seed, F.col("id"), F.col("size"))), "ranked")
    t = tgt.withColumnRenamed("source", "s")
    # ranges of v: words in each, and the range in which the cut of a source falls
    fine = F.floor(F.col("v") * BINS * BINS)
    per = rows.groupBy("source", fine.alias("fine")).agg(F.sum("size").alias("n")).withColumn("bin", F.floor(F.col("fine") / BINS))

    def crossing(sums: DataFrame, keys: list[str], by: str, before: str) -> DataFrame:
        """The first ``by`` of each source at which the running sum passes ``need``, with the sum before it."""
        w = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = sums.withColumn("run", F.sum("n").over(w) + F.col(before))
        return (run.filter(F.col("run") > F.col("need")).groupBy("source", "need")
                .agg(F.min(F.struct(F.col(by), (F.col("run") - F.col("n")).alias("b"))).alias("c"))
                .select("source", "need", F.col(f"c.{by}").alias(f"cut_{by}"), F.col("c.b").alias("start")))

    need = t.select("s", "need", F.lit(0).cast("long").alias("zero"))
    same = F.col("source").eqNullSafe(F.col("s"))
    per = store(per, "ranges")
    coarse = per.groupBy("source", "bin").agg(F.sum("n").alias("n")).join(need, same).drop("s")
    first = crossing(coarse, ["source"], "bin", "zero").withColumnRenamed("source", "s")
    inner = per.join(first, same & (F.col("bin") == F.col("cut_bin"))).select("source", "fine", "n", "need", "start")
    cut = store(t.join(crossing(inner, ["source"], "fine", "start").select(F.col("source").alias("cs"), "cut_fine",
                                                                          F.col("start").alias("before")),
                       F.col("s").eqNullSafe(F.col("cs")), "left").drop("cs"), "cuts")
    joined = rows.withColumn("fine", fine).join(cut, same).drop("s")
    clear = joined.filter("cut_fine is null or fine <> cut_fine").withColumn(
        "extra", (F.col("cut_fine").isNull() | (F.col("fine") < F.col("cut_fine"))) & (F.col("need") > 0))
    w = Window.partitionBy("source").orderBy("v", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    close = (joined.filter("fine = cut_fine")
             .withColumn("extra", F.col("before") + F.coalesce(F.sum("size").over(w), F.lit(0)) + F.col("size") / 2 <= F.col("need")))
    out = clear.unionByName(close)
    copies = F.col("whole") + F.col("extra").cast("long")
    return out.select("id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))

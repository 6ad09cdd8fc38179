"""Cross-catalog item matching by title.

The cascade: exact title equi-join, then an equi-join on the cleaned title
without year, then a fuzzy match on the cleaned title with year for what is left.

Fuzzy stage (J4). For each leftover source the reference scores *every* leftover
target with ``sum(w_i * sim_i) / sum(w)``, where Indel and Levenshtein are
min-max scaled per source over all targets, takes the argmax (first target on
ties) and accepts it when ``round(score, 4) > threshold``.

* Candidates. The scaled terms are at most 1, so an accepted target needs
  ``cos >= (threshold * sum(w) - sum(w_other)) / w_cos`` (0.583 for the shipped
  weights 3/1/0/0/1). Candidate pairs come from a *prefix-filtered* token join
  (Bayardo et al. 2007; Vernica et al. 2010): tokens are ordered by ascending document frequency, and two titles meet under the first tokens
  they share, as many as it takes until a key is no longer crowded, if these and what follows carry enough of the
  norm of both (``candidate_pairs``). No accepted match is lost, and frequent
  tokens (a year, "the") do not produce all pairs.
* Statistics. The scaled terms need each source's smallest and greatest similarity over all leftover targets. The match
  itself (``stats="certified"``) works out only what decides it. A pair's score is bounded from above with 0 for the smallest
  value and the candidates' own greatest value; sources without a pair above the threshold are rejected. For the others the greatest values are
  made exact: characters in common bound both similarities, one matrix product per block of targets, and only
  pairs that the bound leaves open are evaluated (``similarity.greatest``). A pair that has both greatest values has scaled
  terms of exactly 1, whatever the smallest values are (they need only be smaller, which the fewest common characters
  show); the smallest values are searched only for the sources that are still undecided. Accepted
  pairs and their scores are those of the full definition. ``stats="all"`` works out both ends for every source that has a candidate (W7),
  ``stats="candidates"`` is the approximate mode (min/max over candidate pairs only).
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmstart.functions import similarity as sim
from warmstart.functions.seeded import hash_int
from warmstart.functions.text import WORD_PATTERN, raw_title, raw_title_year
from warmstart.session import cut_lineage

# Weights and threshold of the fuzzy score.
DEFAULT_WEIGHTS = (3.0, 1.0, 0.0, 0.0, 1.0)  # cosine, indel, jaro, jaro_winkler, levenshtein
DEFAULT_THRESHOLD = 0.75
# Target strings per block of the all-options statistics, and their bytes.
BLOCK_ROWS = 20000
BLOCK_BYTES = 4 * 1024 * 1024
# Sources per task of the statistics over all targets (bounds one task's work), and chunks of sources at least.
SOURCES_PER_TASK = 4096
MIN_CHUNKS = 32
# The same where bounds decide most pairs: counting a block's characters is what a task of few sources spends its time on.
BOUNDED_PER_TASK, BOUNDED_CHUNKS = 16384, 12
# Partitions of the (block, chunk) pairs at most; a partition goes through its pairs one after another.
MAX_PARTITIONS = 1024

# Beyond any LCS or similarity.
FAR = 1 << 40
# One target in so many is looked at first, where the targets are more than one block.
FIRST = 8

MAPPING_COLS = ["source_item", "target_item", "stage", "score"]


# ---------------------------------------------------------------- exact stages
def match_on_key(a: DataFrame, b: DataFrame, key_a, key_b, stage: int):
    """Equi-join two catalogs ``(item_id, title)`` on a derived key.

    Returns ``(mapping, left_a, left_b)``. A source matching several targets keeps
    the smallest target id (Q13). Every source and target whose key occurs on the
    other side is removed from the leftovers, as in the reference. The target side is
    reduced to one row per key first, so a key shared by n sources and m targets makes
    n rows, not n x m. Rows with a null or empty key (a title without any letter that
    can be transliterated) match nothing and stay.
    """
    ka = a.withColumn("_k", key_a)
    kb = b.withColumn("_k", key_b)
    real = F.col("_k") != ""
    per_key = kb.filter(real).groupBy("_k").agg(F.min("item_id").alias("target_item"))
    mapping = (ka.filter(real).select(F.col("item_id").alias("source_item"), "_k").join(per_key, "_k")
               .groupBy("source_item").agg(F.min("target_item").alias("target_item"))
               .select("source_item", "target_item", F.lit(stage).alias("stage"),
                       F.lit(None).cast("double").alias("score")))
    left_a = ka.join(per_key.select("_k"), "_k", "left_anti").select(*a.columns)
    left_b = kb.join(ka.filter(real).select("_k").distinct(), "_k", "left_anti").select(*b.columns)
    return mapping, left_a, left_b


def match_exact(a: DataFrame, b: DataFrame):
    """Stage 1, identical titles."""
    return match_on_key(a, b, F.col("title"), F.col("title"), 1)


def match_raw_title(a: DataFrame, b: DataFrame):
    """Stage 2, cleaned title without the year."""
    return match_on_key(a, b, raw_title(F.col("title")), raw_title(F.col("title")), 2)


def unmatched(a: DataFrame, b: DataFrame, mapping: DataFrame):
    """Rows of each side not in a mapping."""
    return (a.join(mapping.select(F.col("source_item").alias("item_id")), "item_id", "left_anti"),
            b.join(mapping.select(F.col("target_item").alias("item_id")), "item_id", "left_anti"))


# ---------------------------------------------------------------- tokens and cosine
def token_table(keys: DataFrame, id_col: str) -> DataFrame:
    """``(id, token, cnt, w)`` with ``w = cnt / ||counts||`` (unit-norm weight)."""
    # counted inside the row of an id: one row an id is shuffled and none is sorted per token
    words = (keys.select(id_col, F.regexp_extract_all("key", F.lit(WORD_PATTERN), 0).alias("_t")).groupBy(id_col)
             .agg(F.flatten(F.collect_list("_t")).alias("_t")))
    counts = F.transform(F.array_distinct("_t"), lambda x: F.struct(
        x.alias("token"), F.size(F.filter("_t", lambda y: y == x)).cast("long").alias("cnt")))
    norm = F.sqrt(F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x["cnt"] * x["cnt"]))
    return (words.withColumn("_c", counts).select(id_col, norm.alias("_n"), F.explode("_c").alias("_x"))
            .select(id_col, "_x.token", "_x.cnt", (F.col("_x.cnt") / F.col("_n")).alias("w")))


def token_lists(toks: DataFrame, freq: DataFrame, id_col: str) -> DataFrame:
    """One row per title, (id, l): its tokens by ascending document frequency as structs (token, w), ``w`` the unit weight. Tokens are
    hashes here: two that share one can only make more candidates."""
    listed = (toks.withColumn("token", F.xxhash64("token")).join(freq, "token").groupBy(F.col(id_col).alias("id"))
              .agg(F.sort_array(F.collect_list(F.struct("df", "token", "w"))).alias("_l")))
    return listed.select("id", F.transform("_l", lambda x: F.struct(x["token"].alias("token"), x["w"].alias("w"))).alias("l"))


def _square(w: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x * x)


def _one_more(rows: DataFrame, theta: float) -> DataFrame:
    """``rows`` (side, id, key, w, rest), once for every token of ``rest`` as the next one that a title shares: ``key`` and the weights ``w`` take
    it in, ``rest`` is what comes after and ``tail`` its norm. Only where these weights and the rest have a norm of ``theta``."""
    after = F.slice("rest", F.col("_i") + 2, F.size("rest"))
    longer = (rows.select("side", "id", "key", "w", "rest", F.posexplode("rest").alias("_i", "_x"))
              .select("side", "id", F.xxhash64("key", "_x.token").alias("key"), F.concat("w", F.array("_x.w")).alias("w"), after.alias("rest"),
                      F.sqrt(_square(F.transform(after, lambda x: x["w"]))).alias("tail")))
    return longer.filter(_square(F.col("w")) + F.col("tail") * F.col("tail") >= F.lit(theta * theta - 1e-9))


def token_maps(toks: DataFrame, id_col: str) -> DataFrame:
    """One row per title: ``map<token, unit weight>`` (bounded by the title's token count)."""
    return toks.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("m"))


def cosine_pairs(pairs: DataFrame, tok_s: DataFrame, tok_t: DataFrame) -> DataFrame:
    """Exact bag-of-words cosine of ``(sid, tid)`` pairs: a map lookup per target token,
    evaluated on the joined pair row (no per-token explosion of the pairs)."""
    ms = token_maps(tok_s, "sid").withColumnRenamed("m", "ms")
    mt_ = token_maps(tok_t, "tid").withColumnRenamed("m", "mt")
    dot = F.aggregate(F.map_entries("mt"), F.lit(0.0),
                      lambda acc, e: acc + e["value"] * F.coalesce(F.element_at("ms", e["key"]), F.lit(0.0)))
    j = pairs.join(ms, "sid", "left").join(mt_, "tid", "left")
    return j.select(*pairs.columns, F.when(F.col("ms").isNull() | F.col("mt").isNull(), F.lit(0.0))
                    .otherwise(dot).alias("cosine"))


#: Buckets of the norm bounds in the join keys.
LEVELS = 8


def _bounded_join(x: DataFrame, y: DataFrame, on: list[str], bound: str, theta: float) -> DataFrame:
    """Rows of x and y with equal ``on`` whose ``bound`` columns can have a product of ``theta ** 2``: y is bucketed by its bound
    and x probes only the buckets that reach, so a frequent key is split and pairs only rows that carry enough."""
    level = lambda c: F.least(F.floor(c * LEVELS), F.lit(LEVELS - 1)).cast("int")
    lo = F.least(level(F.lit(theta * theta - 1e-9) / F.col(bound)), F.lit(LEVELS - 1))
    x = x.withColumn("_lvl", F.explode(F.sequence(lo, F.lit(LEVELS - 1))))
    return x.alias("x").join(y.withColumn("_lvl", level(F.col(bound))).alias("y"), [*on, "_lvl"])


#: A key of n source and m target rows is crowded if n * m is over so many times n + m; tokens of a key at most.
CROWDED, DEPTH = 16, 6


def candidate_pairs(tok_s: DataFrame, tok_t: DataFrame, theta: float, crowded: int = CROWDED) -> DataFrame:
    """Pairs that may reach cosine ``theta``; a superset of all such pairs.

    Tokens are ordered by ascending document frequency. Let t1, ..., tk be the first k tokens that two titles share. All others come after tk
    in both, so ``cos <= w_x(t1) w_y(t1) + ... + w_x(tk) w_y(tk) + tail_x(tk) tail_y(tk)``. Titles meet under t1. Where a token is crowded (its
    pairs are many times its rows), titles meet under their first two shared tokens instead, under three where these are crowded, and so
    on: a frequent token, a year or "the", pairs nothing by itself, nor do frequent tokens together. Titles that share a crowded key and nothing
    more need ``w_x(t1) w_y(t1) + ... >= theta``, so only rows whose own weights have that norm are joined on it.
    """
    freq = (tok_s.select("token").unionAll(tok_t.select("token"))
            .groupBy(F.xxhash64("token").alias("token")).agg(F.count(F.lit(1)).alias("df")))
    rows = [token_lists(t, freq, c).select(F.lit(k).alias("side"), "id", F.lit(0).cast("long").alias("key"), F.array().cast("array<double>").alias("w"),
                                           F.col("l").alias("rest")) for k, (t, c) in enumerate(((tok_s, "sid"), (tok_t, "tid")))]
    rows, out = cut_lineage(rows[0].unionByName(rows[1])), []
    met = lambda j: j.select(F.col("x.id").alias("sid"), F.col("y.id").alias("tid"))
    for depth in range(1, DEPTH + 1):
        level = _one_more(rows, theta)
        n = level.groupBy("key").agg(F.sum(F.lit(1) - F.col("side")).alias("a"), F.sum("side").alias("b")).filter((F.col("a") > 0) & (F.col("b") > 0))
        over = (F.col("a") * F.col("b") > crowded * (F.col("a") + F.col("b"))) if depth < DEPTH else F.lit(False)
        level = cut_lineage(level.join(n.select("key", over.alias("crowded")), "key"))
        common = sum((F.col("x.w")[i] * F.col("y.w")[i] for i in range(depth)), F.lit(0.0))
        x, y = (level.filter(~F.col("crowded") & (F.col("side") == k)).select("id", "key", "w", "tail") for k in (0, 1))
        out.append(met(x.alias("x").join(y.alias("y"), "key").filter(common + F.col("x.tail") * F.col("y.tail") >= F.lit(theta - 1e-9))))
        rows = level.filter("crowded")
        if not rows.head(1):
            break
        heavy = rows.withColumn("bound", _square(F.col("w"))).filter(F.col("bound") >= F.lit(theta * theta - 1e-9))
        x, y = (heavy.filter(F.col("side") == k).select("id", "key", "w", "bound") for k in (0, 1))
        out.append(met(_bounded_join(x, y, ["key"], "bound", theta).filter(common >= F.lit(theta - 1e-9))))
    return reduce(DataFrame.unionByName, out).distinct()


# ---------------------------------------------------------------- min-max statistics
_STATS = "sid long, lev_min long, lev_max long, ind_min long, ind_max long"
_GREATEST = "sid long, lev_max long, ind_max long, fewest long"
_LEAST = "sid long, lev_min long, ind_min long"


def _by_blocks(src: DataFrame, tgt_keys: DataFrame, kernel, schema: str, block_rows: int, per_task: int = SOURCES_PER_TASK,
               min_chunks: int = MIN_CHUNKS) -> DataFrame:
    """``kernel(sources, target keys)`` for every chunk of ``src`` (sid, key, ...) and block of targets (tid, key).

    Targets are hashed into blocks of about ``block_rows`` strings or ``BLOCK_BYTES`` bytes, sources into at least
    ``min_chunks`` chunks of at most ``per_task``; every (block, chunk) pair is one cogrouped task, so a target
    is shuffled once per chunk. No string passes through the driver."""
    spark = src.sparkSession
    n_t, t_bytes = tgt_keys.agg(F.count(F.lit(1)), F.sum(F.octet_length("key"))).first()
    n_s = src.count()
    if n_t == 0 or n_s == 0:
        return spark.createDataFrame([], schema)
    n_blocks = max(1, math.ceil(n_t / block_rows), math.ceil((t_bytes or 0) / BLOCK_BYTES))
    n_chunks = max(math.ceil(n_s / per_task), min(min_chunks, math.ceil(n_s / 64)))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    tgt = (tgt_keys.select("key", F.pmod(hash_int(7, "tid"), F.lit(n_blocks)).cast("int").alias("blk"))
           .select("key", "blk", each(n_chunks, "chunk")))
    chunked = (src.withColumn("chunk", F.pmod(hash_int(7, "sid"), F.lit(n_chunks)).cast("int"))
               .select("*", each(n_blocks, "blk")))
    names = [f.split()[0] for f in schema.split(", ")]

    def work(sp: pd.DataFrame, tp: pd.DataFrame) -> pd.DataFrame:
        if not len(sp) or not len(tp):
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in names})
        return kernel(sp, tp["key"])[names]

    # the pairs are dear to work on and small to move: many partitions, which are not coalesced by their bytes
    n = min(n_blocks * n_chunks, MAX_PARTITIONS)
    chunked, tgt = (t.repartition(n, "blk", "chunk") for t in (chunked, tgt))
    return chunked.groupBy("blk", "chunk").cogroup(tgt.groupBy("blk", "chunk")).applyInPandas(work, schema)


def all_target_stats(src_keys: DataFrame, tgt_keys: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """W7 statistics over *all* targets: per source (sid, key) min/max of Levenshtein and Indel similarity."""
    def kernel(sp: pd.DataFrame, keys: pd.Series) -> pd.DataFrame:
        lcs_min, lcs_max, lev_min, lev_max = sim.extremes(sim.Strings(sp["key"]), sim.Block(keys))
        return pd.DataFrame({"sid": sp["sid"].to_numpy(), "lev_min": lev_min, "lev_max": lev_max,
                             "ind_min": 2 * lcs_min, "ind_max": 2 * lcs_max})

    return _by_blocks(src_keys.select("sid", "key"), tgt_keys, kernel, _STATS, block_rows).groupBy("sid").agg(
        F.min("lev_min").alias("lev_min"), F.max("lev_max").alias("lev_max"),
        F.min("ind_min").alias("ind_min"), F.max("ind_max").alias("ind_max"))


def greatest_stats(src: DataFrame, tgt_keys: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(sid, lev_max, ind_max, fewest) over all targets for sources (sid, key, lev, ind, lev_limit, ind_limit); ``lev`` and ``ind`` are values
    that some target reaches, ``fewest`` the fewest characters in common with some of the targets. A source with a value above its limit is
    not looked at any further: its values are reached, but need not be the greatest."""
    def kernel(sp: pd.DataFrame, keys: pd.Series) -> pd.DataFrame:
        s = sim.Strings(sp["key"])
        lcs_max, lev_max, fewest = sim.greatest(s, sim.Block(keys), sp["ind"].to_numpy() // 2, sp["lev"].to_numpy(), sp["ind_limit"].to_numpy() // 2,
                                                sp["lev_limit"].to_numpy())
        return pd.DataFrame({"sid": sp["sid"].to_numpy(), "lev_max": lev_max, "ind_max": 2 * lcs_max, "fewest": fewest})

    return _by_blocks(src.select("sid", "key", "lev", "ind", "lev_limit", "ind_limit"), tgt_keys, kernel, _GREATEST, block_rows, BOUNDED_PER_TASK, BOUNDED_CHUNKS).groupBy("sid").agg(
        F.max("lev_max").alias("lev_max"), F.max("ind_max").alias("ind_max"), F.min("fewest").alias("fewest"))


def least_stats(src_keys: DataFrame, tgt_keys: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(sid, lev_min, ind_min) over all targets for sources (sid, key)."""
    def kernel(sp: pd.DataFrame, keys: pd.Series) -> pd.DataFrame:
        lcs_min, lev_min = sim.least(sim.Strings(sp["key"]), sim.Block(keys))
        return pd.DataFrame({"sid": sp["sid"].to_numpy(), "lev_min": lev_min, "ind_min": 2 * lcs_min})

    return _by_blocks(src_keys.select("sid", "key"), tgt_keys, kernel, _LEAST, block_rows).groupBy("sid").agg(
        F.min("lev_min").alias("lev_min"), F.min("ind_min").alias("ind_min"))


def _scaled(x, lo, hi):
    """MinMax scaling of one metric for a source; a constant metric scales to 0."""
    return F.when(F.col(hi) > F.col(lo), (x - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- fuzzy stage
def cosine_bound(weights, threshold: float) -> float:
    w = dict(zip(sim.METRICS, weights))
    total = sum(w.values())
    if w["cosine"] <= 0:
        return 0.0
    return (threshold * total - (total - w["cosine"])) / w["cosine"]


def _linear(pairs: DataFrame, weights) -> DataFrame:
    """``pairs`` (with the metrics and the statistics of their source) with their ``score``; metrics are scaled."""
    w = dict(zip(sim.METRICS, [float(x) for x in weights]))
    sims = {m: F.col(m) for m in ("cosine", "jaro", "jaro_winkler") if w[m]}
    if w["indel"]:
        sims["indel"] = _scaled(F.col("indel"), "ind_min", "ind_max")
    if w["levenshtein"]:
        sims["levenshtein"] = _scaled(F.col("levenshtein"), "lev_min", "lev_max")
    return pairs.withColumn("score", sim.weighted_score(sims, w))


def _candidates_scored(src: DataFrame, tgt: DataFrame, weights, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys of the sources (sid, key) and targets (tid, key), and the candidate pairs with the metrics of a positive weight."""
    w = dict(zip(sim.METRICS, [float(x) for x in weights]))
    bound = cosine_bound(weights, threshold)
    if bound <= 0:
        raise ValueError("these weights allow a match without any shared token; the fuzzy stage "
                         "needs a positive cosine weight that bounds the candidates")
    theta = bound - 1e-6
    # the keys feed every job of the stage: the exact stages and the cleaning before them run once a side
    sk = cut_lineage(src.select(F.col("item_id").alias("sid"), raw_title_year(F.col("title")).alias("key")))
    tk = cut_lineage(tgt.select(F.col("item_id").alias("tid"), raw_title_year(F.col("title")).alias("key")))
    tok_s, tok_t = token_table(sk, "sid"), token_table(tk, "tid")
    cands = cosine_pairs(candidate_pairs(tok_s, tok_t, theta), tok_s, tok_t).filter(F.col("cosine") >= theta)
    pairs = (cands.join(sk.withColumnRenamed("key", "s_key"), "sid")
             .join(tk.withColumnRenamed("key", "t_key"), "tid"))
    for name in ("indel", "jaro", "jaro_winkler", "levenshtein"):
        if w[name]:
            pairs = pairs.withColumn(name, sim.metric(name)(F.col("s_key"), F.col("t_key")))
    return sk, tk, pairs


def score_pairs(src: DataFrame, tgt: DataFrame, weights=DEFAULT_WEIGHTS, threshold: float = DEFAULT_THRESHOLD,
                stats: str = "all") -> DataFrame:
    """Candidate pairs ``(sid, tid, cosine, ..., score)`` of the fuzzy stage, all with their exact score."""
    sk, tk, pairs = _candidates_scored(src, tgt, weights, threshold)
    if weights[1] or weights[4]:
        if stats == "all":
            # Only a source with a candidate can be accepted, and its statistics only
            # scale its own candidates: the all-targets pass runs for those sources.
            pairs = cut_lineage(pairs)
            st = all_target_stats(sk.join(pairs.select("sid").distinct(), "sid", "left_semi"), tk)
        elif stats == "candidates":
            st = (pairs.withColumn("_lev", sim.levenshtein_similarity(F.col("s_key"), F.col("t_key")))
                  .withColumn("_ind", sim.indel_similarity(F.col("s_key"), F.col("t_key")))
                  .groupBy("sid").agg(F.min("_lev").alias("lev_min"), F.max("_lev").alias("lev_max"),
                                      F.min("_ind").alias("ind_min"), F.max("_ind").alias("ind_max")))
        else:
            raise ValueError("stats must be 'all' or 'candidates'")
        pairs = pairs.join(st, "sid")
    return _linear(pairs, weights)


def certified_pairs(src: DataFrame, tgt: DataFrame, weights=DEFAULT_WEIGHTS, threshold: float = DEFAULT_THRESHOLD,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The candidate pairs that can be their source's best above ``threshold``, with exact scores, from as few statistics as decide them.

    No other pair of the source can be accepted and be its best. ``decided`` is true where no smallest
    value over all targets was needed."""
    _, tk, pairs = _candidates_scored(src, tgt, weights, threshold)
    w_ind, w_lev = weights[1], weights[4]
    for name in ("indel", "levenshtein"):
        if name not in pairs.columns:
            pairs = pairs.withColumn(name, F.lit(0.0))
    pairs = cut_lineage(pairs)
    least_zero = {"lev_min": F.lit(0), "ind_min": F.lit(0)}

    def open_pairs(p: DataFrame, stats: DataFrame) -> DataFrame:
        """Pairs whose score with 0 for the smallest values, its upper bound, is above the threshold."""
        bounded = _linear(p.join(stats, "sid").withColumns(least_zero), weights)
        return bounded.filter(F.col("score") > threshold - 1e-9).select(*p.columns, *(c for c in stats.columns if c != "sid"), F.col("score").alias("_most"))

    def ask(p: DataFrame) -> DataFrame:
        """What ``greatest_stats`` takes for the sources of open pairs (with statistics so far and ``_most``). A value above the limit leaves no
        pair open: with the other terms as they are, the metric's term of no pair is enough then."""
        total, limits = float(sum(weights)), {}
        for name, top, weight in (("levenshtein", "lev_max", w_lev), ("indel", "ind_max", w_ind)):
            short = F.lit((threshold - 1e-9) * total) - (F.col("_most") * total - weight * F.when(F.col(top) > 0, F.col(name) / F.col(top)).otherwise(F.lit(0.0)))
            limits[top] = F.max(F.when((short > 1e-9) & (F.col(name) * weight < FAR * short), F.ceil(F.col(name) * weight / short + 1e-6)).otherwise(F.lit(2 * FAR))).cast("long")
        asked = p.groupBy("sid").agg(F.first("s_key").alias("key"), F.max("lev_max").alias("lev"), F.max("ind_max").alias("ind"),
                                     limits["lev_max"].alias("lev_limit"), limits["ind_max"].alias("ind_limit"))
        # a metric without weight asks for nothing: its greatest value is set beyond all
        if not w_ind:
            asked = asked.withColumns({c: F.lit(2 * FAR).cast("long") for c in ("ind", "ind_limit")})
        if not w_lev:
            asked = asked.withColumns({c: F.lit(FAR).cast("long") for c in ("lev", "lev_limit")})
        return asked

    own = pairs.groupBy("sid").agg(F.max("levenshtein").cast("long").alias("lev_max"), F.max("indel").cast("long").alias("ind_max"))
    first = open_pairs(pairs, own)
    if not (w_ind or w_lev):
        return _linear(first.drop("_most").withColumns(least_zero).withColumn("decided", F.lit(True)), weights)
    first = cut_lineage(first)
    if tk.count() > block_rows:  # a part of the targets shows most sources that have no match
        some = tk.filter(F.pmod(hash_int(8, "tid"), F.lit(FIRST)) == 0)
        first = cut_lineage(open_pairs(first.drop("lev_max", "ind_max", "_most"), greatest_stats(ask(first), some, block_rows).drop("fewest")))
    second = open_pairs(first.drop("lev_max", "ind_max", "_most"), greatest_stats(ask(first), tk, block_rows))
    reaches = F.lit(True)
    if w_ind:
        reaches &= (F.col("indel") == F.col("ind_max")) & (2 * F.col("fewest") < F.col("ind_max"))
    if w_lev:
        reaches &= (F.col("levenshtein") == F.col("lev_max")) & (F.col("fewest") < F.col("lev_max"))
    second = cut_lineage(second.withColumn("_reaches", reaches))
    # a pair that has both greatest values scores its bound: what is bound to score less is not the best
    best = second.filter("_reaches").groupBy("sid").agg(F.max("_most").alias("_best"))
    second = second.join(best, "sid", "left").filter(F.col("_best").isNull() | (F.col("_most") >= F.col("_best") - 1e-9)).drop("_best", "_most")
    status = second.groupBy("sid").agg(F.min("_reaches").alias("decided"), F.first("s_key").alias("key"))
    rest = least_stats(status.filter(~F.col("decided")).select("sid", "key"), tk, block_rows)
    return _linear(second.join(status.select("sid", "decided"), "sid").join(rest, "sid", "left")
                   .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("lev_min", "ind_min")}).drop("_reaches", "fewest"), weights)


def best_match(scored: DataFrame) -> DataFrame:
    """Argmax per source; ties go to the smallest target id. An aggregate, not a sort."""
    best = scored.groupBy("sid").agg(
        F.max_by(F.struct("tid", "score"), F.struct(F.col("score"), -F.col("tid"))).alias("b"))
    return best.select("sid", F.col("b.tid").alias("tid"), F.col("b.score").alias("score"))


def match_fuzzy(src: DataFrame, tgt: DataFrame, weights=DEFAULT_WEIGHTS, threshold: float = DEFAULT_THRESHOLD,
                stats: str = "certified", one_to_one: bool = False) -> DataFrame:
    """Stage 3 mapping ``(source_item, target_item, stage=3, score)``.

    A target may be the best match of several sources (Q12); with ``one_to_one`` only
    the highest-scoring of them keeps it (ties: smallest source id)."""
    scored = (certified_pairs(src, tgt, weights, threshold) if stats == "certified"
              else score_pairs(src, tgt, weights, threshold, stats))
    best = best_match(scored)
    out = (best.filter(F.round("score", 4) > threshold)
           .select(F.col("sid").alias("source_item"), F.col("tid").alias("target_item"),
                   F.lit(3).alias("stage"), "score"))
    if one_to_one:
        keep = out.groupBy("target_item").agg(
            F.max_by("source_item", F.struct(F.col("score"), -F.col("source_item"))).alias("source_item"))
        out = out.join(keep, ["target_item", "source_item"], "left_semi")
    return out


def match_items(a: DataFrame, b: DataFrame, previous: DataFrame | None = None, weights=DEFAULT_WEIGHTS,
                threshold: float = DEFAULT_THRESHOLD, stats: str = "certified", fuzzy: bool = True,
                one_to_one: bool = False) -> DataFrame:
    """The whole cascade. ``previous`` pairs are kept (stage 0) and their items skipped."""
    # titles are short and dear to clean: spread over the tasks by item, not by the files they came from, and pinned, as
    # the filter on the cleaned title would move below the exchange
    a, b = (cut_lineage(t.select("item_id", "title").repartition("item_id")) for t in (a, b))
    stages = []
    if previous is not None:
        prev = previous.select("source_item", "target_item")
        a = a.join(prev.select(F.col("source_item").alias("item_id")), "item_id", "left_anti")
        b = b.join(prev.select(F.col("target_item").alias("item_id")), "item_id", "left_anti")
        stages.append(prev.select("source_item", "target_item", F.lit(0).alias("stage"),
                                  F.lit(None).cast("double").alias("score")))
    m1, a1, b1 = match_exact(a, b)
    m2, a2, b2 = match_raw_title(a1, b1)
    stages += [m1, m2]
    if fuzzy:
        # The leftovers feed several jobs of the fuzzy stage: pin both sides in one job.
        left = cut_lineage(a2.withColumn("_side", F.lit(0)).unionByName(b2.withColumn("_side", F.lit(1))))
        a2 = left.filter(F.col("_side") == 0).drop("_side")
        b2 = left.filter(F.col("_side") == 1).drop("_side")
        stages.append(match_fuzzy(a2, b2, weights, threshold, stats, one_to_one))
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out


# ---------------------------------------------------------------- mapping helpers
def merge_mapping(prev: DataFrame, new: DataFrame) -> DataFrame:
    """Dict merge, the new mapping wins on a shared source."""
    keep = prev.join(new.select("source_item"), "source_item", "left_anti")
    return new.unionByName(keep.select(*new.columns))


def solve_mapping(mapping: DataFrame, src_index: DataFrame, tgt_index: DataFrame) -> DataFrame:
    """Raw ids -> inner ids ``(source_idx, target_idx)``; pairs missing on either side are dropped.

    ``*_index`` are ``(item_id, idx)`` tables (W1)."""
    s = src_index.select(F.col("item_id").alias("source_item"), F.col("idx").alias("source_idx"))
    t = tgt_index.select(F.col("item_id").alias("target_item"), F.col("idx").alias("target_idx"))
    return mapping.join(s, "source_item").join(t, "target_item")


def mapping_coverage(mapping: DataFrame, target_items: DataFrame) -> DataFrame:
    """``round(distinct mapped targets / n_items, 2) * 100`` over a target catalog ``(item_id, ...)``."""
    mapped = mapping.select(F.col("target_item").alias("item_id")).distinct().withColumn("_m", F.lit(1))
    cov = (target_items.select("item_id").join(mapped, "item_id", "left")
           .agg(F.count(F.lit(1)).alias("n_items"), F.count("_m").alias("n_mapped")))
    return cov.select("n_mapped", "n_items",
                      (F.round(F.col("n_mapped") / F.col("n_items"), 2) * 100).alias("coverage"))


def transfer_rank(mapping: DataFrame) -> DataFrame:
    """Order in which mapped items use the transfer budget: by stage, then source id."""
    from warmstart.operators.ordering import global_index

    return global_index(mapping, ["stage", "source_item"], name="rank")


__all__ = ["match_exact", "match_raw_title", "match_fuzzy", "match_items", "merge_mapping", "solve_mapping",
           "mapping_coverage", "transfer_rank", "unmatched", "cosine_pairs", "token_table", "best_match",
           "all_target_stats", "greatest_stats", "least_stats", "score_pairs", "certified_pairs"]

"""Registry of named queries: one Spark job per operator, plus its DuckDB oracle.

Every query reads the given tables (through ``sources.fixtures``) over their full
extent. Floats that are computed are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warmstart.functions.seeded import hash_int, sql_hash_int
from warmstart.operators import filters, splits, stats
from warmstart.sources import fixtures as fx
from warmstart.sources.fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SEED = 42
# The target set of a split holds a third of the interactions.
SPLIT_SQL = "(select count(*) // 3 from core)"


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


def _epoch_seconds(ts):
    """Seconds since 1970-01-01 of a TIMESTAMP_NTZ, independent of the session time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts).cast("long")


H_USER = sql_hash_int(SEED, "user_id")


def split_target(rat: DataFrame) -> int:
    return rat.count() // 3


# ---------------------------------------------------------------- flagship
def user_split_stats(spark: SparkSession, sf_dir: str, target_n: int | None = None) -> DataFrame:
    rat = filters.core_users(fx.ratings(spark, sf_dir), 20)
    labelled = splits.split_users_disjoint(rat, target_n or split_target(rat), seed=SEED)
    st = stats.dataset_stats(labelled, by=["part"])
    return st.select("part", "n_users", "n_items", "n_ratings", r6(F.col("sparsity")).alias("sparsity"))


query("J10_split_users_disjoint", with_views(f"""
select part, count(distinct user_id) as n_users, count(distinct item_id) as n_items, count(*) as n_ratings,
       round(1 - count(*) / (count(distinct item_id) * count(distinct user_id)), 6) as sparsity
from (select c.*, case when s.user_id is not null then 'sample' else 'rest' end as part
      from core c left join sel s using (user_id)) t
group by part
""", "RAT", extra=f"""
core as (select * from RAT where user_id in (select user_id from RAT group by user_id having count(*) >= 20)),
cnt as (select user_id, count(*) as n, {H_USER} as h from core group by user_id),
run as (select user_id, sum(n) over (order by h, user_id rows between unbounded preceding and current row) - n as before from cnt),
sel as (select user_id from run where before < {SPLIT_SQL})
"""))(user_split_stats)


# ---------------------------------------------------------------- filters P1-P6
@query("P1_core_users", with_views("""
select user_id, item_id, rating from RAT
where user_id in (select user_id from RAT group by user_id having count(*) >= 20)
""", "RAT"))
def q_core_users(spark, sf_dir):
    return filters.core_users(fx.ratings(spark, sf_dir), 20).select("user_id", "item_id", "rating")


@query("P2_core_items", with_views("""
select user_id, item_id, rating from RAT
where item_id in (select item_id from RAT group by item_id having count(*) >= 20)
""", "RAT"))
def q_core_items(spark, sf_dir):
    return filters.core_items(fx.ratings(spark, sf_dir), 20).select("user_id", "item_id", "rating")


@query("P3_core_both", with_views("""
select user_id, item_id, rating from RAT
where user_id in (select user_id from RAT group by user_id having count(*) >= 30)
  and item_id in (select item_id from RAT group by item_id having count(*) >= 30)
""", "RAT"))
def q_core_both(spark, sf_dir):
    return filters.core_both(fx.ratings(spark, sf_dir), 30).select("user_id", "item_id", "rating")


@query("P4_items_present", with_views("""
select item_id, title, year from CAT_A
where item_id in (select item_id from RAT where user_id in (select user_id from RAT group by user_id having count(*) >= 20))
""", "RAT", "CAT_A"))
def q_items_present(spark, sf_dir):
    rat = filters.core_users(fx.ratings(spark, sf_dir), 20)
    return filters.items_present(fx.catalog_a(spark, sf_dir), rat)


@query("P6_binarize", with_views("""
select user_id, item_id, case when rating > 3 then 1.0 else 0.0 end as rating from RAT
""", "RAT"))
def q_binarize(spark, sf_dir):
    return filters.binarize(fx.ratings(spark, sf_dir), 3.0).select("user_id", "item_id", "rating")


# ---------------------------------------------------------------- stats A1-A4
@query("A1_dataset_stats", with_views("""
select count(distinct user_id) as n_users, count(distinct item_id) as n_items, count(*) as n_ratings,
       round(1 - count(*) / (count(distinct item_id) * count(distinct user_id)), 6) as sparsity,
       round(avg(rating), 6) as global_mean
from RAT
""", "RAT"))
def q_dataset_stats(spark, sf_dir):
    st = stats.dataset_stats(fx.ratings(spark, sf_dir), extra=[F.avg("rating").alias("global_mean")])
    return st.select("n_users", "n_items", "n_ratings", r6(F.col("sparsity")).alias("sparsity"),
                     r6(F.col("global_mean")).alias("global_mean"))


@query("A4_item_counts", with_views("""
select item_id, count(*) as n from RAT group by item_id
""", "RAT"))
def q_item_counts(spark, sf_dir):
    return stats.group_counts(fx.ratings(spark, sf_dir), "item_id")


@query("A1_fold_stats", with_views(f"""
select fold, split, count(distinct user_id) as n_users, count(distinct item_id) as n_items, count(*) as n_ratings
from (select r.user_id, r.item_id, f.fold,
             case when f.fold = (({sql_hash_int(SEED, 'r.user_id', 'r.item_id')}) % 5) + 1 then 'test' else 'train' end as split
      from RAT r, range(1, 6) f(fold)) t
group by fold, split
""", "RAT"))
def q_fold_stats(spark, sf_dir):
    folds = stats.fold_stats(splits.kfold(fx.ratings(spark, sf_dir), 5, SEED), 5)
    return folds.select(F.col("fold").cast("long").alias("fold"), "split", "n_users", "n_items", "n_ratings")


# ---------------------------------------------------------------- splits / windows
@query("W4_running_user_total", with_views(f"""
select user_id, n, cast(sum(n) over (order by h, user_id rows between unbounded preceding and current row) - n as bigint) as before
from (select user_id, count(*) as n, {H_USER} as h from RAT group by user_id) c
""", "RAT"))
def q_running_total(spark, sf_dir):
    return splits.user_running_totals(fx.ratings(spark, sf_dir), SEED).select("user_id", "n", "before")


@query("W1_build_index", with_views("""
select item_id, row_number() over (order by item_id) - 1 as idx from (select distinct item_id from RAT) d
""", "RAT"))
def q_build_index(spark, sf_dir):
    return splits.build_index(fx.ratings(spark, sf_dir), "item_id")


@query("W12_round_robin", with_views("""
select user_id, (row_number() over (order by user_id) - 1) % 4 as batch from (select distinct user_id from RAT) d
""", "RAT"))
def q_round_robin(spark, sf_dir):
    idx = splits.build_index(fx.ratings(spark, sf_dir), "user_id")
    return splits.round_robin(idx, 4).select("user_id", F.col("batch").cast("long").alias("batch"))


@query("J7_restrict_test", with_views(f"""
select user_id, item_id, rating from fo
where fold = 1
  and user_id in (select user_id from fo where fold <> 1)
  and item_id in (select item_id from fo where fold <> 1)
""", "RAT", extra=f"""
fo as (select user_id, item_id, rating, ({sql_hash_int(SEED, 'user_id', 'item_id')}) % 5 + 1 as fold
       from RAT where item_id in (select item_id from RAT group by item_id having count(*) >= 25))
"""))
def q_restrict_test(spark, sf_dir):
    rat = filters.core_items(fx.ratings(spark, sf_dir), 25)
    train, test = splits.get_fold(splits.kfold(rat, 5, SEED), 1)
    return splits.restrict_test(train, test).select("user_id", "item_id", "rating")


@query("U4_distinct_users", with_views("select distinct user_id from RAT", "RAT"))
def q_distinct_users(spark, sf_dir):
    return splits.distinct_ids(fx.ratings(spark, sf_dir), "user_id")


# ---------------------------------------------------------------- titles and matching
from warmstart.functions import similarity as sim  # noqa: E402
from warmstart.functions import text as tx  # noqa: E402
from warmstart.operators import matching as mt  # noqa: E402

_STAGE1 = "select a.item_id as source_item, b.item_id as target_item from CAT_A a join CAT_B b on a.title = b.title"
_LEFT_CTES = f"""
p1 as ({_STAGE1}),
a1 as (select * from CAT_A where item_id not in (select source_item from p1)),
b1 as (select * from CAT_B where item_id not in (select target_item from p1)),
p2 as (select a.item_id as source_item, b.item_id as target_item from a1 a join b1 b
       on {tx.sql_raw_title('a.title')} = {tx.sql_raw_title('b.title')}),
a2 as (select * from a1 where item_id not in (select source_item from p2)),
b2 as (select * from b1 where item_id not in (select target_item from p2)),
sk as (select item_id as sid, {tx.sql_raw_title_year('title')} as key from a2),
tk as (select item_id as tid, {tx.sql_raw_title_year('title')} as key from b2)
"""
_PAIR_CTES = """
ts as (select sid, tok, count(*) as c from (select sid, unnest(regexp_extract_all(key, '[\\p{L}\\p{N}_]+')) as tok from sk) x group by sid, tok),
tt as (select tid, tok, count(*) as c from (select tid, unnest(regexp_extract_all(key, '[\\p{L}\\p{N}_]+')) as tok from tk) x group by tid, tok),
ns as (select sid, sqrt(sum(c * c)) as n from ts group by sid),
nt as (select tid, sqrt(sum(c * c)) as n from tt group by tid),
dots as (select sid, tid, sum(ts.c * tt.c) as d from ts join tt using (tok) group by sid, tid),
allp as (select sk.sid, tk.tid, sk.key as s_key, tk.key as t_key from sk cross join tk),
sc as (select p.sid, p.tid, coalesce(d.d / (ns.n * nt.n), 0) as cosine,
              greatest(length(s_key), length(t_key)) - levenshtein(s_key, t_key) as lev
       from allp p left join dots d using (sid, tid) left join ns using (sid) left join nt using (tid)),
mm as (select sid, min(lev) as lev_min, max(lev) as lev_max from sc group by sid)
"""


def _cats(spark, sf_dir):
    return fx.catalog_a(spark, sf_dir), fx.catalog_b(spark, sf_dir)


def _left(spark, sf_dir):
    """What the exact stages leave of both catalogs. As in the cascade, titles are spread over the tasks by item before they are cleaned, and pinned."""
    a, b = (cut_lineage(t.select("item_id", "title").repartition("item_id")) for t in _cats(spark, sf_dir))
    _, a1, b1 = mt.match_exact(a, b)
    return mt.match_raw_title(a1, b1)[1:]


@query("C3_C5_title_keys", with_views(f"""
select item_id, {tx.sql_preprocess_title('title')} as clean, {tx.sql_raw_title('title')} as raw,
       {tx.sql_raw_title_year('title')} as raw_year
from (select item_id, title from CAT_A union all select item_id, title from CAT_B) t
""", "CAT_A", "CAT_B"))
def q_title_keys(spark, sf_dir):
    a, b = _cats(spark, sf_dir)
    t = a.select("item_id", "title").unionByName(b.select("item_id", "title"))
    c = F.col("title")
    return t.select("item_id", tx.preprocess_title(c).alias("clean"), tx.raw_title(c).alias("raw"),
                    tx.raw_title_year(c).alias("raw_year"))


@query("C1_unaccent_documents", f"""
select doc_id, md5({tx.sql_unaccent('lower(text)')}) as h, length({tx.sql_unaccent('lower(text)')}) as n
from documents
""")
def q_unaccent(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    u = tx.unaccent(F.lower(F.col("text")))
    return d.select("doc_id", F.md5(u).alias("h"), F.length(u).cast("long").alias("n"))


@query("J1_match_exact", with_views(f"""
select source_item, min(target_item) as target_item from p1 group by source_item
""", "CAT_A", "CAT_B", extra=f"p1 as ({_STAGE1})"))
def q_match_exact(spark, sf_dir):
    a, b = _cats(spark, sf_dir)
    m, _, _ = mt.match_exact(a, b)
    return m.select("source_item", "target_item")


@query("J2_unmatched", with_views("""
select 'source' as side, item_id from a1 union all select 'target' as side, item_id from b1
""", "CAT_A", "CAT_B", extra=_LEFT_CTES))
def q_unmatched(spark, sf_dir):
    a, b = _cats(spark, sf_dir)
    _, a1, b1 = mt.match_exact(a, b)
    return (a1.select(F.lit("source").alias("side"), "item_id")
            .unionByName(b1.select(F.lit("target").alias("side"), "item_id")))


@query("J3_match_raw_title", with_views("""
select source_item, min(target_item) as target_item from p2 group by source_item
""", "CAT_A", "CAT_B", extra=_LEFT_CTES))
def q_match_raw(spark, sf_dir):
    a, b = _cats(spark, sf_dir)
    _, a1, b1 = mt.match_exact(a, b)
    m, _, _ = mt.match_raw_title(a1, b1)
    return m.select("source_item", "target_item")


@query("W7_minmax_by_source", with_views("""
select sid as source_item, lev_min, lev_max from mm
""", "CAT_A", "CAT_B", extra=_LEFT_CTES + "," + _PAIR_CTES))
def q_minmax(spark, sf_dir):
    a2, b2 = _left(spark, sf_dir)
    sk = a2.select(F.col("item_id").alias("sid"), tx.raw_title_year(F.col("title")).alias("key"))
    tk = b2.select(F.col("item_id").alias("tid"), tx.raw_title_year(F.col("title")).alias("key"))
    st = mt.all_target_stats(sk, tk)
    return st.select(F.col("sid").alias("source_item"), "lev_min", "lev_max")


COS_LEV = (3.0, 0.0, 0.0, 0.0, 2.0)


@query("J4_match_fuzzy_cos_lev", with_views("""
select sid as source_item, tid as target_item, round(score, 6) as score from (
  select sc.sid, sc.tid,
         (3 * cosine + 2 * (case when lev_max > lev_min then (lev - lev_min) / (lev_max - lev_min) else 0 end)) / 5 as score,
         row_number() over (partition by sc.sid order by
           (3 * cosine + 2 * (case when lev_max > lev_min then (lev - lev_min) / (lev_max - lev_min) else 0 end)) / 5 desc,
           sc.tid) as rn
  from sc join mm using (sid)) x
where rn = 1 and round(score, 4) > 0.75
""", "CAT_A", "CAT_B", extra=_LEFT_CTES + "," + _PAIR_CTES))
def q_fuzzy_cos_lev(spark, sf_dir):
    a2, b2 = _left(spark, sf_dir)
    m = mt.match_fuzzy(a2, b2, weights=COS_LEV)
    return m.select("source_item", "target_item", r6(F.col("score")).alias("score"))


@query("J5_match_items_cos_lev", with_views("""
select source_item, min(target_item) as target_item, 1 as stage, null::double as score from p1 group by source_item
union all
select source_item, min(target_item) as target_item, 2 as stage, null::double as score from p2 group by source_item
union all
select sid, tid, 3 as stage, round(score, 6) from (
  select sc.sid, sc.tid,
         (3 * cosine + 2 * (case when lev_max > lev_min then (lev - lev_min) / (lev_max - lev_min) else 0 end)) / 5 as score,
         row_number() over (partition by sc.sid order by
           (3 * cosine + 2 * (case when lev_max > lev_min then (lev - lev_min) / (lev_max - lev_min) else 0 end)) / 5 desc,
           sc.tid) as rn
  from sc join mm using (sid)) x
where rn = 1 and round(score, 4) > 0.75
""", "CAT_A", "CAT_B", extra=_LEFT_CTES + "," + _PAIR_CTES))
def q_match_items_cos_lev(spark, sf_dir):
    a, b = _cats(spark, sf_dir)
    m = mt.match_items(a, b, weights=COS_LEV)
    return m.select("source_item", "target_item", "stage", r6(F.col("score")).alias("score"))


@query("J5_match_items")
def q_match_items(spark, sf_dir):
    a, b = _cats(spark, sf_dir)
    m = mt.match_items(a, b)
    return m.select("source_item", "target_item", "stage", r6(F.col("score")).alias("score"))


@query("A8_mapping_coverage", with_views("""
select count(distinct target_item) as n_mapped, (select count(*) from CAT_B) as n_items,
       round(count(distinct target_item) / (select count(*) from CAT_B), 2) * 100 as coverage
from (select source_item, target_item from p1 union all select source_item, target_item from p2) m
""", "CAT_A", "CAT_B", extra=_LEFT_CTES))
def q_coverage(spark, sf_dir):
    a, b = _cats(spark, sf_dir)
    m = mt.match_items(a, b, fuzzy=False)
    return mt.mapping_coverage(m, b)


@query("U2_merge_mapping", with_views("""
select source_item, target_item from new_m
union all
select source_item, target_item from old_m where source_item not in (select source_item from new_m)
""", "CAT_A", "CAT_B", extra=_LEFT_CTES + """,
old_m as (select source_item, min(target_item) as target_item from p1 group by source_item),
new_m as (select source_item, min(target_item) + 1 as target_item from p1
          where source_item in (select item_id from CAT_A where year >= 2005) group by source_item)
"""))
def q_merge_mapping(spark, sf_dir):
    a, b = _cats(spark, sf_dir)
    m, _, _ = mt.match_exact(a, b)
    old = m.select("source_item", "target_item")
    late = a.filter(F.col("year") >= 2005).select(F.col("item_id").alias("source_item"))
    new = old.join(late, "source_item", "left_semi").select("source_item", (F.col("target_item") + 1).alias("target_item"))
    return mt.merge_mapping(old, new)


@query("J6_solve_mapping", with_views("""
select source_item, target_item, s.idx as source_idx, t.idx as target_idx
from (select source_item, min(target_item) as target_item from p1 group by source_item) m
join (select item_id, row_number() over (order by item_id) - 1 as idx from RAT_I) s on s.item_id = m.source_item
join (select item_id, row_number() over (order by item_id) - 1 as idx from CAT_B) t on t.item_id = m.target_item
""", "RAT", "CAT_A", "CAT_B", extra=_LEFT_CTES + """,
RAT_I as (select item_id from RAT group by item_id having count(*) >= 20)
"""))
def q_solve_mapping(spark, sf_dir):
    a, b = _cats(spark, sf_dir)
    m, _, _ = mt.match_exact(a, b)
    rat = filters.core_items(fx.ratings(spark, sf_dir), 20)
    s_idx = splits.build_index(rat, "item_id")
    t_idx = splits.build_index(b, "item_id")
    return mt.solve_mapping(m.select("source_item", "target_item"), s_idx, t_idx)


_PAIRS_SQL = f"""
pr as (select a.item_id as sid, b.item_id as tid, {tx.sql_raw_title_year('a.title')} as s_key,
              {tx.sql_raw_title_year('b.title')} as t_key
       from CAT_A a join CAT_B b on b.item_id = a.item_id + 1000000)
"""


def _pairs(spark, sf_dir):
    # titles are short and dear to clean and to compare: spread over the tasks by the key of the join, not by the files
    a, b = _cats(spark, sf_dir)
    a = a.select(F.col("item_id").alias("sid"), "title").repartition("sid")
    b = b.select((F.col("item_id") - 1000000).alias("sid"), F.col("item_id").alias("tid"), "title").repartition("sid")
    return (a.select("sid", tx.raw_title_year(F.col("title")).alias("s_key"))
            .join(b.select("sid", "tid", tx.raw_title_year(F.col("title")).alias("t_key")), "sid"))


@query("C7_C9_pair_similarity", with_views("""
select sid, tid, greatest(length(s_key), length(t_key)) - levenshtein(s_key, t_key) as lev,
       round(jaro_similarity(s_key, t_key), 6) as jaro, round(jaro_winkler_similarity(s_key, t_key), 6) as jaro_winkler
from pr
""", "CAT_A", "CAT_B", extra=_PAIRS_SQL))
def q_pair_similarity(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    s, t = F.col("s_key"), F.col("t_key")
    return p.select("sid", "tid", sim.levenshtein_similarity(s, t).alias("lev"),
                    r6(sim.jaro(s, t)).alias("jaro"), r6(sim.jaro_winkler(s, t)).alias("jaro_winkler"))


# LCS row by row: a cell is the greatest of the cells so far of "the one above" and "the diagonal one plus a match".
_LCS_SQL = """
step(sid, tid, s_key, t_key, i, row) as (
  select sid, tid, s_key, t_key, 0, [0 for x in range(0, length(t_key) + 1)] from pr
  union all
  select sid, tid, s_key, t_key, i + 1,
         list_reduce([[greatest(row[j], case when j > 1 and s_key[i + 1] = t_key[j - 1] then row[j - 1] + 1 else 0 end)]
                      for j in range(1, length(t_key) + 2)],
                     lambda done, cell: list_append(done, greatest(done[-1], cell[1])))
  from step where i < length(s_key)
)
"""


@query("C8_indel_similarity", with_views("""
select sid, tid, 2 * row[-1]::bigint as indel from step where i = length(s_key)
""", "CAT_A", "CAT_B", extra=_PAIRS_SQL + "," + _LCS_SQL).replace("with ", "with recursive ", 1))
def q_indel(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("sid", "tid", sim.indel_similarity(F.col("s_key"), F.col("t_key")).alias("indel"))


@query("C6_cosine", with_views("""
select pr.sid, pr.tid, round(coalesce(d.d / (ns.n * nt.n), 0), 6) as cosine
from pr left join dots d using (sid, tid) left join ns using (sid) left join nt using (tid)
""", "CAT_A", "CAT_B", extra=_PAIRS_SQL + """,
sk as (select sid, s_key as key from pr), tk as (select tid, t_key as key from pr),
ts as (select sid, tok, count(*) as c from (select sid, unnest(regexp_extract_all(key, '[\\p{L}\\p{N}_]+')) as tok from sk) x group by sid, tok),
tt as (select tid, tok, count(*) as c from (select tid, unnest(regexp_extract_all(key, '[\\p{L}\\p{N}_]+')) as tok from tk) x group by tid, tok),
ns as (select sid, sqrt(sum(c * c)) as n from ts group by sid),
nt as (select tid, sqrt(sum(c * c)) as n from tt group by tid),
dots as (select sid, tid, sum(ts.c * tt.c) as d from pr join ts using (sid) join tt using (tid, tok) group by sid, tid)
"""))
def q_cosine(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    tok_s = mt.token_table(p.select("sid", F.col("s_key").alias("key")), "sid")
    tok_t = mt.token_table(p.select("tid", F.col("t_key").alias("key")), "tid")
    c = mt.cosine_pairs(p.select("sid", "tid"), tok_s, tok_t)
    return c.select("sid", "tid", r6(F.col("cosine")).alias("cosine"))


# ---------------------------------------------------------------- runs analytics
from warmstart.operators import runs as ru  # noqa: E402

_NESTED_CTES = """
vl as (select run_id, list(val_loss order by epoch) as val_loss from RUN_METRICS group by run_id),
r0 as (select RUNS.*, vl.val_loss from RUNS left join vl using (run_id)
       where method is not null and coalesce(is_complete, true)),
r1 as (select run_id,
              case when dataset = 'ExplicitML100kLeakage' then 'ExplicitMLTransfer' else dataset end as dataset,
              case when method like 'Pretrained%' and instr(method, '_') > 0
                   then 'Pretrained from ' || split_part(method, '_', 2) else method end as method,
              init, lim, split, last_epoch, is_complete, val_loss from r0),
r2 as (select * exclude (rn) from (select *, row_number() over (partition by dataset, method, lim, init, split order by run_id) as rn from r1) d where rn = 1),
r3 as (select * replace (case when method = 'Pretrained from ML100kNegativeLeakage'
                              then 'Pretrained from ML100kNegativeLeakage_random' else method end as method) from r2),
r4 as (select *, case when dataset in ('ML100k', 'ML1M') then min(last_epoch) over (partition by dataset, method, lim, init)
                      else min(last_epoch) over (partition by dataset, method, lim) end as last_epoch2 from r3),
r5 as (select *, case when last_epoch2 >= 1 and last_epoch2 <= len(val_loss) then val_loss[last_epoch2] else val_loss[-1] end as rmse2 from r4),
summ as (select dataset, method, init, lim, avg(rmse2) as rmse_mean, stddev_samp(rmse2) as rmse_std, count(rmse2) as count,
                case init when 'random' then 0 when 'pca' then 1 when 'word2vec' then 2 end as init_order
         from r5 group by dataset, method, init, lim
         having lim in (0.0::double, 0.1::double, 0.2::double, 0.3::double, 0.4::double, 0.5::double, 0.6::double,
                        0.7::double, 0.8::double, 0.9::double, 1.0::double) and init is not null)
"""


def _nested_runs(spark, sf_dir):
    m = fx.run_metrics(spark, sf_dir)
    return ru.with_results(fx.runs(spark, sf_dir, m), m)


def _r6_cols(df, cols):
    for c in cols:
        df = df.withColumn(c, r6(F.col(c)))
    return df


@query("M11_analyze_runs", with_views("""
select dataset, method, init, lim, round(rmse_mean, 6) as rmse_mean, round(rmse_std, 6) as rmse_std, count, init_order from summ
""", "RUNS", extra=_NESTED_CTES))
def q_analyze_runs(spark, sf_dir):
    out = ru.analyze_runs(_nested_runs(spark, sf_dir))
    return _r6_cols(out, ["rmse_mean", "rmse_std"])


@query("P7_normalize_run_labels", with_views("""
select run_id, dataset, method from r1
""", "RUNS", extra=_NESTED_CTES))
def q_normalize(spark, sf_dir):
    r = ru.normalize_run_labels(ru.complete_runs(fx.runs(spark, sf_dir)))
    return r.select("run_id", "dataset", "method")


@query("W8_dedupe_runs", with_views("""
select run_id from (select run_id, row_number() over (partition by method, init, lim order by run_id) as rn from r1) d where rn = 1
""", "RUNS", extra=_NESTED_CTES))
def q_dedupe(spark, sf_dir):
    r = ru.normalize_run_labels(ru.complete_runs(fx.runs(spark, sf_dir)))
    return ru.dedupe_runs(r, key=["method", "init", "lim"]).select("run_id")


@query("J11_align_epoch", with_views("""
select run_id, last_epoch2, round(rmse2, 6) as rmse2 from r5
""", "RUNS", extra=_NESTED_CTES))
def q_align(spark, sf_dir):
    r = ru.dedupe_runs(ru.normalize_run_labels(ru.complete_runs(_nested_runs(spark, sf_dir))))
    out = ru.align_epoch(r)
    return out.select("run_id", "last_epoch2", r6(F.col("rmse2")).alias("rmse2"))


@query("A9_min_epoch", with_views("""
select dataset, method, lim, init, min(last_epoch) as min_epoch, grouping(dataset, method, lim, init) as level
from RUNS group by grouping sets ((dataset, method, lim, init), (dataset, method, lim))
""", "RUNS"))
def q_min_epoch(spark, sf_dir):
    return ru.min_epochs(fx.runs(spark, sf_dir)).select("dataset", "method", "lim", "init", "min_epoch",
                                                          F.col("level").cast("long").alias("level"))


@query("W9_early_stop_epoch", with_views("""
select run_id, coalesce(min(case when stale >= 6 then epoch end), -1) as stop_epoch, count(*) as n_epochs from (
  select *, row_number() over (partition by run_id, grp order by epoch) - 1 as stale from (
    select *, sum(imp) over (partition by run_id order by epoch rows between unbounded preceding and current row) as grp from (
      select *, case when best is null or val_loss < best then 1 else 0 end as imp from (
        select run_id, epoch, val_loss,
               min(val_loss) over (partition by run_id order by epoch rows between unbounded preceding and 1 preceding) as best
        from RUN_METRICS) a) b) c) d
group by run_id
""", "RUN_METRICS"))
def q_early_stop(spark, sf_dir):
    out = ru.early_stop_epoch(fx.run_metrics(spark, sf_dir), patience=5)
    return out.select("run_id", F.coalesce(F.col("stop_epoch"), F.lit(-1)).alias("stop_epoch"), "n_epochs")


@query("W11_final_metrics", with_views("""
select run_id, round(arg_max(val_loss, epoch), 6) as final_rmse, round(min(val_loss), 6) as best_rmse,
       first(epoch order by val_loss, epoch) as best_epoch
from RUN_METRICS group by run_id
""", "RUN_METRICS"))
def q_final(spark, sf_dir):
    return _r6_cols(ru.final_metrics(fx.run_metrics(spark, sf_dir)), ["final_rmse", "best_rmse"])


def _results_with_source(spark, sf_dir):
    out = ru.analyze_runs(_nested_runs(spark, sf_dir))
    return out.withColumn("source", F.regexp_extract("method", "^Pretrained from (.*)$", 1))


@query("P9_report_scenarios", with_views("""
select dataset, scenario, source, init, lim, round(rmse_mean, 6) as rmse_mean from (
  select *, case when source <> 'Baseline' then source || ' to ' || upper(init[1]) || lower(init[2:]) else source end as scenario from (
    select dataset, method, 'Baseline' as init, lim, rmse_mean, 'Baseline' as source from sr
    where source = 'random' and lim = 0 and init = 'random'
    union all
    select dataset, method, init, lim, rmse_mean,
           case source when 'random' then 'Random' when 'pca' then 'PCA' when 'word2vec' then 'Word2vec' else source end as source
    from sr where lim = 1) u) v
where init = 'random' or init = 'Baseline'
""", "RUNS", extra=_NESTED_CTES + ", sr as (select *, regexp_extract(method, '^Pretrained from (.*)$', 1) as source from summ)"))
def q_report(spark, sf_dir):
    out = ru.report_scenarios(_results_with_source(spark, sf_dir))
    return out.select("dataset", "scenario", "source", "init", "lim", r6(F.col("rmse_mean")).alias("rmse_mean"))


@query("U1_union_results", with_views("""
select case source when 'random' then 'Pretrained with Random' when 'pca' then 'Pretrained with PCA'
                   when 'word2vec' then 'Pretrained with Word2Vec' end as method,
       dataset, init, lim, round(rmse_mean, 6) as rmse_mean
from sr
""", "RUNS", extra=_NESTED_CTES + ", sr as (select *, regexp_extract(method, '^Pretrained from (.*)$', 1) as source from summ)"))
def q_union(spark, sf_dir):
    res = _results_with_source(spark, sf_dir)
    tables = {s: res.filter(F.col("source") == s) for s in ru.INIT_LEVELS}
    out = ru.union_results(tables)
    return out.select("method", "dataset", "init", "lim", r6(F.col("rmse_mean")).alias("rmse_mean"))


@query("A11_build_catalog", with_views("""
select dataset as "group", init, method, lim, split, coalesce(is_complete, true) as is_complete,
       concat_ws(chr(9), coalesce(cast(init as varchar), 'None'), coalesce(method, 'None'), cast(lim as varchar),
                 cast(split as varchar)) as key
from RUNS
""", "RUNS"))
def q_catalog(spark, sf_dir):
    return ru.build_catalog(fx.runs(spark, sf_dir))


@query("A11_catalog_summary", with_views("""
select dataset as "group", count(*) as n_runs from RUNS group by dataset
""", "RUNS"))
def q_catalog_summary(spark, sf_dir):
    return ru.catalog_summary(ru.build_catalog(fx.runs(spark, sf_dir)))


_GRID_SQL = """
grid as (select k.dataset, k.method, i.init, l.lim_i, s.split
         from (select distinct dataset, method from RUNS) k,
              (values ('random'), ('pca'), ('word2vec')) i(init), range(0, 11) l(lim_i), range(1, 6) s(split))
"""


def _grid(spark, sf_dir):
    keys = fx.runs(spark, sf_dir).select("dataset", "method").distinct()
    return ru.experiment_grid(keys)


@query("J12_experiment_grid", with_views("""
select dataset, method, init, lim_i, split from grid
""", "RUNS", extra=_GRID_SQL))
def q_grid(spark, sf_dir):
    return _grid(spark, sf_dir).select("dataset", "method", "init", F.col("lim_i").cast("long").alias("lim_i"),
                                       F.col("split").cast("long").alias("split"))


@query("J13_pending_runs", with_views("""
select g.dataset, g.method, g.init, g.lim_i, g.split,
       case when r.done is null then 'never started' else 'halted' end as status,
       case when r.done is null then -1 else r.halted_run end as halted_run
from grid g left join (select dataset, method, init, cast(round(lim * 10) as bigint) as lim_i, split,
                              max(cast(coalesce(is_complete, true) as int)) as done, min(run_id) as halted_run
                       from RUNS group by all) r
  on g.dataset = r.dataset and g.method = r.method and g.init = r.init and g.lim_i = r.lim_i and g.split = r.split
where coalesce(r.done, 0) = 0
""", "RUNS", extra=_GRID_SQL))
def q_pending(spark, sf_dir):
    p = ru.pending_runs(_grid(spark, sf_dir), fx.runs(spark, sf_dir))
    return p.select("dataset", "method", "init", F.col("lim_i").cast("long").alias("lim_i"),
                    F.col("split").cast("long").alias("split"), "status",
                    F.coalesce(F.col("halted_run"), F.lit(-1)).alias("halted_run"))


@query("J14_find_run", with_views("""
select run_id, dataset, lim, split from RUNS where init = 'pca' and split = 3 and method = 'Pretrained from src_word2vec'
""", "RUNS"))
def q_find(spark, sf_dir):
    r = ru.find_run(fx.runs(spark, sf_dir), init="pca", split=3, method="Pretrained from src_word2vec")
    return r.select("run_id", "dataset", "lim", "split")


@query("J15_eligible_groups", with_views("""
select method || '/' || init as "group" from RUNS where coalesce(is_complete, true) group by method || '/' || init
having max(case when lim = 0 and split = 1 and dataset = 'ML1M' then 1 else 0 end) = 1
   and max(case when lim > 0 then 1 else 0 end) = 1
""", "RUNS"))
def q_eligible(spark, sf_dir):
    r = (ru.complete_runs(fx.runs(spark, sf_dir))
         .select(F.concat_ws("/", "method", "init").alias("group"),
                 F.when((F.col("lim") == 0) & (F.col("split") == 1) & (F.col("dataset") == "ML1M"), "source")
                 .when(F.col("lim") > 0, "target").otherwise("other").alias("kind")))
    return ru.eligible_groups(r)


@query("O1_sort_runs", with_views("""
select run_id, dataset, split, init, row_number() over (order by dataset, split, init, run_id) - 1 as pos from RUNS
""", "RUNS"))
def q_sort_runs(spark, sf_dir):
    # the row's place in the sorted result, so that an unsorted one does not pass
    out = ru.sort_runs(fx.runs(spark, sf_dir)).select("run_id", "dataset", "split", "init")
    return ru.with_position(out)


# ---------------------------------------------------------------- factor models
from warmstart.operators import factors as fa  # noqa: E402
from warmstart.session import pinned  # noqa: E402

_TWO32 = "4294967296.0"


def _sql_unit(key_expr: str) -> str:
    return f"((('0x' || substr(md5({key_expr}), 1, 8))::BIGINT + 0.5) / {_TWO32})"


def _sql_normal(prefix: str, sigma: float) -> str:
    u1 = _sql_unit(f"{prefix} || ':a'")
    u2 = _sql_unit(f"{prefix} || ':b'")
    return f"(sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2}) * {sigma})"


def _posexplode(vec: str):
    """``posexplode`` as (k, v). Of a bare column Spark infers a filter on its size, which it moves down to the input of whatever
    made the column, so that a vector worked out after a distinct is worked out before it as well, for every row there."""
    return F.posexplode(F.slice(F.col(vec), 1, F.size(vec))).alias("k", "v")


@query("M1_init_random", with_views(f"""
select id, k, round({_sql_normal("'42:item:' || cast(id as varchar) || ':' || cast(k as varchar)", 0.1)}, 6) as v
from (select distinct item_id as id from RAT) d, range(0, 16) t(k)
""", "RAT"))
def q_init_random(spark, sf_dir):
    ids = fx.ratings(spark, sf_dir).select(F.col("item_id").alias("id"))
    emb = fa.init_random(ids, 16, stddev=0.1, seed=SEED, side="item")
    return emb.select("id", _posexplode("vec")).select(
        "id", F.col("k").cast("long").alias("k"), r6(F.col("v")).alias("v"))


def _elements(df, *keys):
    """One row per vector element: a permuted vector is another result."""
    return (df.select(*keys, "bias", _posexplode("vec"))
            .select(*keys, F.col("k").cast("long").alias("k"), (r6(F.col("v").cast("double")) + 0.0).alias("v"), r6(F.col("bias")).alias("bias")))


def _fac(spark, sf_dir, rat=None):
    rat = rat if rat is not None else fx.ratings(spark, sf_dir)
    return {(s, m): fx.factors(spark, sf_dir, s, m, rat) for s in ("user", "item") for m in (0, 1)}


_PRED_CTE = """
mu as (select avg(rating) as mu from RAT),
pred as (select r.user_id, r.item_id, r.rating, u.vec::DOUBLE[] as pu, u.bias as bu, i.vec::DOUBLE[] as qi, i.bias as bi,
                (select mu from mu) + u.bias + i.bias + list_inner_product(u.vec::DOUBLE[], i.vec::DOUBLE[]) as est
         from RAT r join FAC0_USER u on u.id = r.user_id join FAC0_ITEM i on i.id = r.item_id)
"""


def _rated(spark, sf_dir, *more):
    """The ratings, worked out once for the ids, the mean and the ratings themselves."""
    return pinned(fx.ratings(spark, sf_dir).select("user_id", "item_id", "rating", *more), "ratings")


def _pred(spark, sf_dir):
    rat = _rated(spark, sf_dir)
    f = _fac(spark, sf_dir, rat)
    mu = rat.agg(F.avg("rating")).first()[0]
    return fa.predict(rat, f[("user", 0)], f[("item", 0)], mu)


@query("J8_predict", with_views("select user_id, item_id, round(est, 6) as est from pred",
                                "RAT", "FAC0_USER", "FAC0_ITEM", extra=_PRED_CTE))
def q_predict(spark, sf_dir):
    return _pred(spark, sf_dir).select("user_id", "item_id", r6(F.col("est")).alias("est"))


@query("A5_rmse_by_fold", with_views(f"""
select ({sql_hash_int(SEED, 'user_id', 'item_id')}) % 5 + 1 as fold, round(sqrt(avg(pow(rating - est, 2))), 6) as rmse
from pred group by 1
""", "RAT", "FAC0_USER", "FAC0_ITEM", extra=_PRED_CTE))
def q_rmse(spark, sf_dir):
    p = splits.kfold(_pred(spark, sf_dir), 5, SEED)
    return stats.rmse(p, by=["fold"]).select(F.col("fold").cast("long").alias("fold"), r6(F.col("rmse")).alias("rmse"))


@query("A6_regularized_loss", with_views("""
select round(sum(pow(rating - est, 2) + 0.04 * (bu * bu + bi * bi + list_inner_product(pu, pu) + list_inner_product(qi, qi))), 4) as loss
from pred
""", "RAT", "FAC0_USER", "FAC0_ITEM", extra=_PRED_CTE))
def q_loss(spark, sf_dir):
    return fa.regularized_loss(_pred(spark, sf_dir), 0.04).select(F.round("loss", 4).alias("loss"))


@query("M12_interpolate_params", with_views("""
select 'item' as side, a.id, t.k - 1 as k, round(0.7 * a.vec[t.k]::DOUBLE + 0.3 * b.vec[t.k]::DOUBLE, 6) + 0.0 as v,
       round(0.7 * a.bias + 0.3 * b.bias, 6) as bias
from FAC0_ITEM a join FAC1_ITEM b on a.id = b.id cross join range(1, 65) t(k)
union all
select 'user' as side, a.id, t.k - 1 as k, round(0.7 * a.vec[t.k]::DOUBLE + 0.3 * b.vec[t.k]::DOUBLE, 6) + 0.0 as v,
       round(0.7 * a.bias + 0.3 * b.bias, 6) as bias
from FAC0_USER a join FAC1_USER b on a.id = b.id cross join range(1, 65) t(k)
""", "RAT", "FAC0_ITEM", "FAC1_ITEM", "FAC0_USER", "FAC1_USER"))
def q_interp_params(spark, sf_dir):
    f = _fac(spark, sf_dir)
    both = [fa.interpolate_params(f[(s, 0)], f[(s, 1)], 0.3).withColumn("side", F.lit(s)) for s in ("item", "user")]
    return _elements(both[0].unionByName(both[1]), "side", "id")


@query("A14_interpolate_rmse", with_views(f"""
select split, k, round(alpha, 6) as alpha, round(sqrt(avg(pow(rating - est, 2))), 6) as rmse from (
  select r.split, g.k, g.alpha, r.rating,
         (select mu from mu) + (1 - g.alpha) * (u0.bias + i0.bias) + g.alpha * (u1.bias + i1.bias)
         + list_inner_product(
             list_transform(list_zip(u0.vec::DOUBLE[], u1.vec::DOUBLE[]), lambda x: (1 - g.alpha) * x[1] + g.alpha * x[2]),
             list_transform(list_zip(i0.vec::DOUBLE[], i1.vec::DOUBLE[]), lambda x: (1 - g.alpha) * x[1] + g.alpha * x[2])) as est
  from rs r
  join FAC0_USER u0 on u0.id = r.user_id join FAC0_ITEM i0 on i0.id = r.item_id
  join FAC1_USER u1 on u1.id = r.user_id join FAC1_ITEM i1 on i1.id = r.item_id,
  (select k, k / 49.0 as alpha from range(0, 50) t(k)) g) x
group by split, k, alpha
""", "RAT", "FAC0_USER", "FAC0_ITEM", "FAC1_USER", "FAC1_ITEM", extra=f"""
rs as (select *, case when ({sql_hash_int(SEED, 'user_id', 'item_id')}) % 5 + 1 = 1 then 'test' else 'train' end as split from RAT),
mu as (select avg(rating) as mu from rs where split = 'train')
"""))
def q_interp_rmse(spark, sf_dir):
    rat = _rated(spark, sf_dir)
    f = _fac(spark, sf_dir, rat)
    rs = splits.kfold(rat, 5, SEED).withColumn("split", F.when(F.col("fold") == 1, "test").otherwise("train"))
    mu = rs.filter(F.col("split") == "train").agg(F.avg("rating")).first()[0]
    out = fa.interpolate_rmse(rs, f[("user", 0)], f[("item", 0)], f[("user", 1)], f[("item", 1)], mu, n=50)
    return out.select("split", F.col("k").cast("long").alias("k"), r6(F.col("alpha")).alias("alpha"),
                      r6(F.col("rmse")).alias("rmse"))


# The vectors are laid out once, an element a row; errors meet the other side's elements and are summed per id and element.
_GRAD_CTE = _PRED_CTE + """,
e as materialized (select user_id, item_id, rating - est as err, bu, bi from pred),
ul as materialized (select id, unnest(vec)::double as v, unnest(range(1, 65)) as k from FAC0_USER),
il as materialized (select id, unnest(vec)::double as v, unnest(range(1, 65)) as k from FAC0_ITEM),
gb_u as (select user_id as id, sum(err - 0.04 * bu) as gb, count(*) as n from e group by user_id),
gv_u as (select e.user_id as id, il.k, sum(e.err * il.v) as g from e join il on il.id = e.item_id group by e.user_id, il.k),
gb_i as (select item_id as id, sum(err - 0.04 * bi) as gb, count(*) as n from e group by item_id),
gv_i as (select e.item_id as id, ul.k, sum(e.err * ul.v) as g from e join ul on ul.id = e.user_id group by e.item_id, ul.k)
"""


def _grad_sql(side: str) -> str:
    t, elements, s = ("FAC0_USER", "ul", "u") if side == "user" else ("FAC0_ITEM", "il", "i")
    return f"""
select l.id, l.k - 1 as k, round(l.v + 0.001 * coalesce(g.g - 0.04 * b.n * l.v, 0), 6) + 0.0 as v,
       round(f.bias + 0.001 * coalesce(b.gb, 0), 6) as bias
from {elements} l join {t} f on f.id = l.id
left join gv_{s} g on g.id = l.id and g.k = l.k
left join gb_{s} b on b.id = l.id
"""


def _grad(spark, sf_dir):
    rat = _rated(spark, sf_dir)
    f = _fac(spark, sf_dir, rat)
    mu = rat.agg(F.avg("rating")).first()[0]
    return fa.gradient_step(rat, f[("user", 0)], f[("item", 0)], mu, lr=0.001, reg=0.04)



@query("M6_gradient_step_users", with_views(_grad_sql("user"), "RAT", "FAC0_USER", "FAC0_ITEM", extra=_GRAD_CTE))
def q_grad_users(spark, sf_dir):
    return _elements(_grad(spark, sf_dir)[0], "id")


@query("M6_gradient_step_items", with_views(_grad_sql("item"), "RAT", "FAC0_USER", "FAC0_ITEM", extra=_GRAD_CTE))
def q_grad_items(spark, sf_dir):
    return _elements(_grad(spark, sf_dir)[1], "id")


@query("J9_transfer_items", with_views("""
select t.id, s.svec is not null as transferred, g.k - 1 as k, round(coalesce(s.svec, t.vec::DOUBLE[])[g.k], 6) + 0.0 as v
from tgt t cross join range(1, 65) g(k) left join (
  select u.target_item, f.vec::DOUBLE[] as svec from (
    select target_item, arg_max(source_item, rk) as source_item from (
      select source_item, target_item, row_number() over (order by stage, source_item) - 1 as rk from mp
      where source_item in (select id from src) and target_item in (select id from tgt)) r
    where rk < (select ceil(count(*) * 0.5) from tgt) group by target_item) u
  join src f on f.id = u.source_item) s on s.target_item = t.id
""", "RAT", "CAT_A", "CAT_B", "FAC0_ITEM", "FAC1_ITEM", extra=_LEFT_CTES + """,
mp as (select source_item, min(target_item) as target_item, 1 as stage from p1 group by source_item
       union all select source_item, min(target_item) as target_item, 2 as stage from p2 group by source_item),
src as (select f.* from FAC0_ITEM f where id in (select item_id from RAT group by item_id having count(*) >= 30)),
tgt as (select id + 1000000 as id, vec from FAC1_ITEM)
"""))
def q_transfer(spark, sf_dir):
    a, b = _cats(spark, sf_dir)
    rat = _rated(spark, sf_dir)
    f = _fac(spark, sf_dir, rat)
    mapping = mt.match_items(a, b, fuzzy=False)
    tgt = f[("item", 1)].withColumn("id", F.col("id") + 1000000)
    n_items = tgt.count()
    # some mapped source items have no vector: they use up no budget
    trained = filters.core_items(rat, 30).select(F.col("item_id").alias("id")).distinct()
    out, _ = fa.transfer_items(tgt, f[("item", 0)].join(trained, "id", "left_semi"), mapping, n_items, 0.5)
    return _elements(out, "id", "transferred").drop("bias")


# ---------------------------------------------------------------- implicit feedback
from warmstart.operators import implicit as im  # noqa: E402


def _loo_sql(fold: int) -> str:
    h = sql_hash_int(SEED, f"'{fold}'", "user_id", "item_id")
    return f"""
select user_id, item_id, n, case when rn = 1 then 'test' else 'train' end as split, {fold} as fold from (
  select *, row_number() over (partition by user_id order by {h}, item_id) as rn,
         count(*) over (partition by user_id) as cnt from IMPL) x
where cnt > 1"""


_NEG_CTE = f"""
loo as ({_loo_sql(1)}),
tr as (select user_id, item_id from loo where split = 'train'),
te as (select user_id, item_id as pos_item from loo where split = 'test'),
idx as (select item_id, row_number() over (order by item_id) - 1 as idx from (select distinct item_id from tr) d),
nitems as (select count(*) as n from idx),
-- the allowed items of a test row in the order of the index; draw j takes the (hash mod their number)-th
allowed as (select te.user_id, te.pos_item, i.item_id, row_number() over (partition by te.user_id, te.pos_item order by i.idx) - 1 as k,
                   count(*) over (partition by te.user_id, te.pos_item) as n
            from te, idx i where i.item_id <> te.pos_item
              and not exists (select 1 from tr where tr.user_id = te.user_id and tr.item_id = i.item_id)),
sizes as (select distinct user_id, pos_item, n from allowed),
neg as (select s.user_id, s.pos_item, s.j, a.item_id as neg_item from (
          select user_id, pos_item, g.j, ({sql_hash_int(SEED, 'user_id', 'pos_item', 'g.j')}) % n as k from sizes, range(0, 99) g(j)) s
        join allowed a on a.user_id = s.user_id and a.pos_item = s.pos_item and a.k = s.k)
"""


def _impl_fold1(spark, sf_dir):
    loo = im.leave_one_out(fx.implicit(spark, sf_dir), SEED, 1, fold=1)
    return loo.filter(F.col("split") == "train"), loo.filter(F.col("split") == "test")


@query("W3_leave_one_out", with_views(f"select user_id, item_id, split from ({_loo_sql(1)}) l", "IMPL"))
def q_loo(spark, sf_dir):
    return im.leave_one_out(fx.implicit(spark, sf_dir), SEED, 1, fold=1).select("user_id", "item_id", "split")


@query("M13_implicit_fold_stats", with_views(
    "select fold, count(distinct user_id) as n_users, count(distinct item_id) as n_items, count(*) as n_ratings from ("
    + " union all ".join(f"select * from ({_loo_sql(f)}) l{f}" for f in range(1, 6))
    + ") x where split = 'train' group by fold", "IMPL"))
def q_impl_stats(spark, sf_dir):
    folds = im.loo_folds(fx.implicit(spark, sf_dir), 5, SEED, 1)
    st = stats.dataset_stats(folds.filter(F.col("split") == "train"), by=["fold"])
    return st.select(F.col("fold").cast("int").alias("fold"), "n_users", "n_items", "n_ratings")


@query("U3_item_difference", with_views("""
select te.user_id, te.pos_item, (select n from nitems) - coalesce(p.np, 0)
       - case when exists (select 1 from tr where tr.user_id = te.user_id and tr.item_id = te.pos_item) then 0 else 1 end as n_allowed
from te left join (select user_id, count(distinct item_id) as np from tr group by user_id) p using (user_id)
""", "IMPL", extra=_NEG_CTE))
def q_allowed(spark, sf_dir):
    train, test = _impl_fold1(spark, sf_dir)
    n_items = train.select("item_id").distinct().count()
    return im.allowed_counts(test, train, n_items).select("user_id", "pos_item", F.col("n_allowed").cast("long"))


@query("M13_implicit_negatives", with_views("select fold, user_id, pos_item, j, neg_item from neg_f", "IMPL",
       extra="loo_f as (" + " union all ".join(f"select * from ({_loo_sql(f)}) l{f}" for f in range(1, 6)) + f"""),
tr_f as (select fold, user_id, item_id from loo_f where split = 'train'),
te_f as (select fold, user_id, item_id as pos_item from loo_f where split = 'test'),
idx_f as (select fold, item_id, row_number() over (partition by fold order by item_id) - 1 as idx
          from (select distinct fold, item_id from tr_f) d),
allowed_f as (select te_f.fold, te_f.user_id, te_f.pos_item, i.item_id,
                     row_number() over (partition by te_f.fold, te_f.user_id, te_f.pos_item order by i.idx) - 1 as k,
                     count(*) over (partition by te_f.fold, te_f.user_id, te_f.pos_item) as n
              from te_f join idx_f i using (fold) where i.item_id <> te_f.pos_item and not exists (
                select 1 from tr_f where tr_f.fold = te_f.fold and tr_f.user_id = te_f.user_id and tr_f.item_id = i.item_id)),
sizes_f as (select distinct fold, user_id, pos_item, n from allowed_f),
neg_f as (select s.fold, s.user_id, s.pos_item, s.j, a.item_id as neg_item from (
            select fold, user_id, pos_item, g.j, ({sql_hash_int(SEED, 'fold', 'user_id', 'pos_item', 'g.j')}) % n as k
            from sizes_f, range(0, 20) g(j)) s
          join allowed_f a on a.fold = s.fold and a.user_id = s.user_id and a.pos_item = s.pos_item and a.k = s.k)
"""))
def q_implicit_negatives(spark, sf_dir):
    _, _, neg = im.implicit_dataset(fx.implicit(spark, sf_dir), 5, SEED, 20)
    return neg.select(F.col("fold").cast("int").alias("fold"), "user_id", "pos_item", F.col("j").cast("long").alias("j"), "neg_item")


@query("W10_negative_sample", with_views("select user_id, pos_item, j, neg_item from neg", "IMPL", extra=_NEG_CTE))
def q_negatives(spark, sf_dir):
    train, test = _impl_fold1(spark, sf_dir)
    neg = im.negative_sample(test, train, 99, SEED)
    return neg.select("user_id", "pos_item", F.col("j").cast("long").alias("j"), "neg_item")


@query("K2_negatives_lines", with_views("""
select user_id, pos_item, '(''' || user_id || ''', ''' || pos_item || ''')' || chr(9) ||
       string_agg(cast(neg_item as varchar), chr(9) order by j) as line
from neg group by user_id, pos_item
""", "IMPL", extra=_NEG_CTE))
def q_negative_lines(spark, sf_dir):
    train, test = _impl_fold1(spark, sf_dir)
    return im.negatives_lines(im.negative_sample(test, train, 99, SEED))


# ---------------------------------------------------------------- sources and sinks (round trips)
from warmstart.session import cut_lineage, scratch_path  # noqa: E402
from warmstart.sources import readers as rd  # noqa: E402
from warmstart.sources import writers as wr  # noqa: E402


@query("S1_read_ratings", with_views("""
select user_id, item_id, rating, cast(epoch(ts) as bigint) as ts from RAT
""", "RAT"))
def q_read_ratings(spark, sf_dir):
    path = scratch_path(spark, "ratings-dat")
    rat = fx.ratings(spark, sf_dir)
    (rat.select("user_id", "item_id", "rating", _epoch_seconds(F.col("ts")).alias("ts"))
     .write.mode("overwrite").option("sep", "::").csv(path))
    return rd.read_ratings(spark, path, sep="::")


@query("S2_read_items", with_views("select item_id, title from CAT_A", "CAT_A"))
def q_read_items(spark, sf_dir):
    path = scratch_path(spark, "u-item")
    a = fx.catalog_a(spark, sf_dir)
    (a.select("item_id", "title", F.lit("01-Jan-1995").alias("release"), F.lit("").alias("url"))
     .write.mode("overwrite").option("sep", "|").option("encoding", "ISO-8859-1").csv(path))
    return rd.read_items(spark, path, sep="|", encoding="ISO-8859-1")


@query("S3_read_predefined_folds", with_views(f"""
select r.user_id, r.item_id, r.rating, cast(epoch(r.ts) as bigint) as ts, f.fold,
       case when ({sql_hash_int(SEED, 'r.user_id', 'r.item_id')}) % 5 + 1 = f.fold then 'test' else 'train' end as split
from RAT r, range(1, 6) f(fold)
""", "RAT"))
def q_read_folds(spark, sf_dir):
    base = scratch_path(spark, "ml100k-folds")
    rat = pinned(fx.ratings(spark, sf_dir).select("user_id", "item_id", "rating", _epoch_seconds(F.col("ts")).alias("ts")), "ratings")
    long = splits.fold_long(splits.kfold(rat, 5, SEED), 5)
    for k in range(1, 6):
        for split, ext in (("train", "base"), ("test", "test")):
            (long.filter((F.col("fold") == k) & (F.col("split") == split)).select("user_id", "item_id", "rating", "ts")
             .write.mode("overwrite").option("sep", "\t").csv(f"{base}/u{k}.{ext}"))
    out = rd.read_predefined_folds(spark, f"{base}/u*.*")
    return out.select("user_id", "item_id", "rating", "ts", F.col("fold").cast("long").alias("fold"), "split")


#: Lines of a file of the sectioned layout, about.
SECTION_LINES = 250_000


def write_sectioned(rat: DataFrame, path: str, n_files: int = 4) -> None:
    """Sectioned layout (``<item>:`` then ``user,rating,date``), complete sections per file; ``n_files`` files at least, more for
    more than ``SECTION_LINES`` lines each, so that no task sorts more as the table grows."""
    n_files = max(n_files, -(-rat.count() // SECTION_LINES))
    lines = (rat.select("item_id", F.lit(1).alias("kind"), "user_id",
                        F.concat_ws(",", F.col("user_id").cast("string"), F.col("rating").cast("int").cast("string"),
                                    F.date_format("ts", "yyyy-MM-dd")).alias("value"))
             .unionByName(rat.select("item_id").distinct()
                          .select("item_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("user_id"),
                                  F.concat(F.col("item_id").cast("string"), F.lit(":")).alias("value"))))
    (lines.repartition(n_files, "item_id").sortWithinPartitions("item_id", "kind", "user_id")
     .select("value").write.mode("overwrite").text(path))


@query("S4_read_sectioned_ratings", with_views("""
select user_id, item_id, rating, strftime(ts, '%Y-%m-%d') as day from RAT
""", "RAT"))
def q_read_sectioned(spark, sf_dir):
    path = scratch_path(spark, "combined-data")
    write_sectioned(_rated(spark, sf_dir, "ts"), path)
    out = rd.read_sectioned_ratings(spark, path)
    return out.select("user_id", "item_id", "rating", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("S6_read_titles_loose_csv", with_views("""
select item_id, year, title || ', part ' || cast(item_id as varchar) || ', vol. ' || cast(year as varchar) as title from CAT_A
""", "CAT_A"))
def q_read_titles(spark, sf_dir):
    path = scratch_path(spark, "movie-titles")
    a = fx.catalog_a(spark, sf_dir)
    line = F.concat_ws(",", F.col("item_id").cast("string"), F.col("year").cast("string"),
                       F.concat(F.col("title"), F.lit(", part "), F.col("item_id").cast("string"),
                                F.lit(", vol. "), F.col("year").cast("string")))
    (a.select(line.alias("value")).write.mode("overwrite").option("sep", "\u0001").option("quote", "")
     .option("escapeQuotes", False).option("encoding", "ISO-8859-1").csv(path))
    out = rd.read_titles_loose_csv(spark, path)
    return out.select("item_id", "year", "title")


@query("S8_K1_triples_round_trip", with_views("select user_id, item_id, rating from RAT", "RAT"))
def q_triples(spark, sf_dir):
    path = scratch_path(spark, "train-rating")
    wr.write_triples(fx.ratings(spark, sf_dir), path)
    return rd.read_ratings_list(spark, path)


@query("S8_K2_negatives_round_trip", with_views("select user_id, pos_item, j, neg_item from neg", "IMPL",
                                               extra=_NEG_CTE))
def q_negatives_rt(spark, sf_dir):
    path = scratch_path(spark, "test-negatives")
    train, test = _impl_fold1(spark, sf_dir)
    wr.write_negatives(im.negatives_lines(im.negative_sample(test, train, 99, SEED)), path)
    return rd.read_negatives(spark, path).select("user_id", "pos_item", F.col("j").cast("long").alias("j"), "neg_item")


@query("S9_read_runs", with_views("""
select run_id, dataset, method, init, lim, split, last_epoch, round(list_sum(vl.val_loss), 6) as vsum
from RUNS join (select run_id, list(val_loss order by epoch) as val_loss from RUN_METRICS group by run_id) vl using (run_id)
where method is not null and coalesce(is_complete, true)
""", "RUNS"))
def q_read_runs(spark, sf_dir):
    path = scratch_path(spark, "runs")
    nested = _nested_runs(spark, sf_dir)
    cfg = nested.select(F.col("run_id").alias("run"), "dataset", F.col("split").alias("dataset_split"), "method",
                        "init", F.col("lim").alias("limit"), "last_epoch", "is_complete", "results")
    wr.write_run_configs(cfg, path)
    out = rd.read_runs(spark, path, pattern="*.json")
    return out.select(F.col("run").cast("int").alias("run_id"), "dataset", "method",
                      "init", "lim", "split", F.col("last_epoch").cast("long").alias("last_epoch"),
                      r6(F.aggregate("results.val_loss", F.lit(0.0), lambda a, v: a + v)).alias("vsum"))


@query("K4_factors_round_trip", with_views("""
select 'item' as side, f.id, t.k - 1 as k, round(f.vec[t.k]::DOUBLE, 6) + 0.0 as v, round(f.bias, 6) as bias from FAC0_ITEM f cross join range(1, 65) t(k)
union all
select 'user' as side, f.id, t.k - 1 as k, round(f.vec[t.k]::DOUBLE, 6) + 0.0 as v, round(f.bias, 6) as bias from FAC0_USER f cross join range(1, 65) t(k)
""", "RAT", "FAC0_ITEM", "FAC0_USER"))
def q_factors_rt(spark, sf_dir):
    path = scratch_path(spark, "models")
    f = _fac(spark, sf_dir)
    wr.save_factors(f[("user", 0)], f[("item", 0)], path, "fac0", {"dim": 64})
    wr.save_factors(f[("user", 1)], f[("item", 1)], path, "fac1", {"dim": 64})
    u, i = wr.load_factors(spark, path, "fac0")
    both = u.withColumn("side", F.lit("user")).unionByName(i.withColumn("side", F.lit("item")))
    return _elements(both, "side", "id")


@query("K5_upsert_mapping", with_views("""
select source_item, target_item from p1 where source_item in (select item_id from CAT_A where year >= 2005)
""", "CAT_A", "CAT_B", extra=_LEFT_CTES))
def q_upsert(spark, sf_dir):
    path = scratch_path(spark, "mappings")
    a, b = _cats(spark, sf_dir)
    m, _, _ = mt.match_exact(a, b)
    m = m.select("source_item", "target_item")
    wr.upsert_mapping(m, path, "cat_a", "cat_b")
    late = a.filter(F.col("year") >= 2005).select(F.col("item_id").alias("source_item"))
    wr.upsert_mapping(m.join(late, "source_item", "left_anti"), path, "cat_a", "cat_c")
    wr.upsert_mapping(m.join(late, "source_item", "left_semi"), path, "cat_a", "cat_b")  # replaces cat_b only
    return wr.read_mapping(spark, path, "cat_a", "cat_b")


# ---------------------------------------------------------------- learning (rows-only checks + tests)
from warmstart.operators import embeddings as em  # noqa: E402
from warmstart.operators import mf  # noqa: E402
from warmstart.plans import transfer as tr  # noqa: E402


def _rat_fold1(spark, sf_dir):
    # several jobs read the fold table (init, training, metrics): pin it once
    rs = cut_lineage(splits.kfold(fx.ratings(spark, sf_dir), 5, SEED))
    return rs.filter(F.col("fold") != 1), rs.filter(F.col("fold") == 1)


_FOLD1 = f"(select * from RAT where ({sql_hash_int(SEED, 'user_id', 'item_id')}) % 5 + 1 <> 1)"


def _shape(df):
    """What a learned table must look like: a row for every id, its length, no NaN or infinity."""
    good = F.forall("vec", lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(1e6)))
    return df.withColumn("dim", F.size("vec").cast("long")).withColumn("finite", good)


def _model_sql(rows: str, dim: int, user: str = "user_id", item: str = "item_id") -> str:
    """A row for every id; training moved its vector, and the train RMSE fell in every epoch."""
    rest = f"{dim}::bigint as dim, true as finite, true as moved, true as falls"
    return (f"select 'user' as side, id, {rest} from (select distinct {user} as id from {rows} a) u "
            f"union all select 'item' as side, id, {rest} from (select distinct {item} as id from {rows} b) i")


def _model_rows(res):
    def side(name, rows, first):
        before = first.select("id", F.col("vec").alias("_before"))
        return rows.join(before, "id", "left").select(F.lit(name).alias("side"), "id", "vec", (~F.col("vec").eqNullSafe(F.col("_before"))).alias("moved"))

    both = side("user", res.users, res.first_users).unionByName(side("item", res.items, res.first_items))
    falls = len(res.loss) > 1 and all(b < a for a, b in zip(res.loss, res.loss[1:]))
    return _shape(both).select("side", "id", "dim", "finite", "moved", F.lit(falls).alias("falls"))


@query("M2_init_svd", with_views(f"""
select id, 16::bigint as dim, true as finite, 1.0::double as norm from (select distinct item_id as id from {_FOLD1} t) d
""", "RAT"))
def q_svd(spark, sf_dir):
    train, _ = _rat_fold1(spark, sf_dir)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    return _shape(em.init_svd(train, 16, side="item", seed=SEED)).select("id", "dim", "finite", r6(norm).alias("norm"))


@query("M3_init_word2vec", with_views(f"""
select id, 16::bigint as dim, true as finite from (select distinct item_id as id from {_FOLD1} t) d
""", "RAT"))
def q_w2v(spark, sf_dir):
    train, _ = _rat_fold1(spark, sf_dir)
    return _shape(em.init_embeddings(train, 16, "word2vec", window_size=5, seed=SEED)).select("id", "dim", "finite")


@query("M4_init_embeddings_dispatch", with_views(f"""
select id, k, round({_sql_normal("'42:user:' || cast(id as varchar) || ':' || cast(k as varchar)", 0.1)}, 6) as v
from (select distinct user_id as id from RAT) d, range(0, 16) t(k)
""", "RAT"))
def q_dispatch(spark, sf_dir):
    rat = fx.ratings(spark, sf_dir)
    emb = em.init_embeddings(rat, 16, "word2vec", side="user", seed=SEED)  # falls back to random users
    return emb.select("id", _posexplode("vec")).select(
        "id", F.col("k").cast("long").alias("k"), r6(F.col("v")).alias("v"))


@query("M7_epoch_metrics", with_views(f"""
select split, round(sqrt(avg(pow(rating - est, 2))), 6) as rmse from (
  select case when ({sql_hash_int(SEED, 'r.user_id', 'r.item_id')}) % 5 + 1 = 1 then 'test' else 'train' end as split,
         r.rating, (select mu from mu) + u.bias + i.bias + list_inner_product(u.vec::DOUBLE[], i.vec::DOUBLE[]) as est
  from RAT r join FAC0_USER u on u.id = r.user_id join FAC0_ITEM i on i.id = r.item_id) x
group by split
""", "RAT", "FAC0_USER", "FAC0_ITEM", extra=f"""
mu as (select avg(rating) as mu from RAT where ({sql_hash_int(SEED, 'user_id', 'item_id')}) % 5 + 1 <> 1)
"""))
def q_epoch_metrics(spark, sf_dir):
    rat = splits.kfold(_rated(spark, sf_dir), 5, SEED)
    train, test = rat.filter(F.col("fold") != 1), rat.filter(F.col("fold") == 1)
    f = _fac(spark, sf_dir, rat)
    mu = train.agg(F.avg("rating")).first()[0]
    out = mf.split_rmse(train, test, f[("user", 0)], f[("item", 0)], mu)
    return out.select("split", r6(F.col("rmse")).alias("rmse"))


@query("M5_fit_mf", with_views(_model_sql(_FOLD1, 16), "RAT"))
def q_fit(spark, sf_dir):
    train, test = _rat_fold1(spark, sf_dir)
    users = fa.init_random(train.select(F.col("user_id").alias("id")), 16, 0.1, seed=SEED, side="user")
    items = fa.init_random(train.select(F.col("item_id").alias("id")), 16, 0.1, seed=SEED, side="item")
    test = splits.restrict_test(train, test)
    res = mf.fit(train, users, items, test, epochs=3, lr=0.005, reg=0.04, blocks=8, seed=SEED)
    return _model_rows(res)


@query("M8_checkpoint_resume", with_views(_model_sql(_FOLD1, 8), "RAT"))
def q_resume(spark, sf_dir):
    train, test = _rat_fold1(spark, sf_dir)
    users = fa.init_random(train.select(F.col("user_id").alias("id")), 8, 0.1, seed=SEED, side="user")
    items = fa.init_random(train.select(F.col("item_id").alias("id")), 8, 0.1, seed=SEED, side="item")
    test = splits.restrict_test(train, test)
    path = scratch_path(spark, "mf-state")
    mf.fit(train, users, items, test, epochs=3, lr=0.005, blocks=4, path=path, checkpoint_every=1,
           max_epochs_this_run=2)
    res = mf.fit(train, users, items, test, epochs=3, lr=0.005, blocks=4, path=path, checkpoint_every=1)
    return _model_rows(res)


_SPLIT_FOLD = f"""
core as (select * from RAT where user_id in (select user_id from RAT group by user_id having count(*) >= 20)),
cnt as (select user_id, count(*) as n, {H_USER} as h from core group by user_id),
run as (select user_id, sum(n) over (order by h, user_id rows between unbounded preceding and current row) - n as before from cnt),
sel as (select user_id from run where before < {SPLIT_SQL}),
rest as (select * from core where user_id not in (select user_id from sel)),
rest1 as (select * from rest where ({sql_hash_int(SEED, 'user_id', 'item_id')}) % 5 + 1 <> 1),
smp as (select user_id, item_id + 1000000 as item_id from core where user_id in (select user_id from sel)),
smp1 as (select * from smp where ({sql_hash_int(SEED, 'user_id', 'item_id')}) % 5 + 1 <> 1)
"""


@query("M9_train_source", with_views(_model_sql("rest1", 16), "RAT", extra=_SPLIT_FOLD))
def q_train_source(spark, sf_dir):
    rat = filters.core_users(fx.ratings(spark, sf_dir), 20)
    rest = splits.split_users_disjoint(rat, split_target(rat), SEED).filter(F.col("part") == "rest").drop("part")
    out = tr.train_source(rest, "pca", fold=1, dim=16, epochs=2, lr=0.005, blocks=8,
                          path=scratch_path(spark, "source-model"))
    return _model_rows(out["result"])


@query("M10_train_target", with_views(_model_sql("smp1", 16), "RAT", extra=_SPLIT_FOLD))
def q_train_target(spark, sf_dir):
    rat = filters.core_users(fx.ratings(spark, sf_dir), 20)
    lab = splits.split_users_disjoint(rat, split_target(rat), SEED)
    rest = lab.filter(F.col("part") == "rest").drop("part")
    sample = (lab.filter(F.col("part") == "sample").drop("part")
              .withColumn("item_id", F.col("item_id") + 1000000))  # target catalog ids
    src = tr.train_source(rest, "random", fold=1, dim=16, epochs=1, lr=0.005, blocks=8)
    a, b = _cats(spark, sf_dir)
    out = tr.train_target(sample, b, a, src["result"].items, "src_random", init="random", limit=0.5, fold=1,
                          dim=16, epochs=2, lr=0.005, blocks=8, mapping_path=scratch_path(spark, "mappings"))
    return _model_rows(out["result"])


@query("M7_training_metrics")
def q_training_metrics(spark, sf_dir):
    """Epoch metrics of a source and a target model, with the number of transferred vectors (learned values: no SQL)."""
    rat = filters.core_users(fx.ratings(spark, sf_dir), 20)
    lab = splits.split_users_disjoint(rat, split_target(rat), SEED)
    src = tr.train_source(lab.filter(F.col("part") == "rest").drop("part"), "random", fold=1, dim=8, epochs=2, lr=0.005, blocks=4)
    sample = lab.filter(F.col("part") == "sample").drop("part").withColumn("item_id", F.col("item_id") + 1000000)
    a, b = _cats(spark, sf_dir)
    tgt = tr.train_target(sample, b, a, src["result"].items, "src_random", init="random", limit=0.5, fold=1, dim=8, epochs=2,
                          lr=0.005, blocks=4)
    rows = mf.run_metrics_table(spark, 0, src["result"]).withColumn("n_emb", F.lit(None).cast("long"))
    return rows.unionByName(mf.run_metrics_table(spark, 1, tgt["result"]).withColumn("n_emb", F.lit(tgt["n_emb"]).cast("long")))


@query("E1_user_disjoint_sets", with_views("""
select user_id, item_id, rating, case when user_id in (select user_id from sel) then 'sample' else 'rest' end as part from core
""", "RAT", extra=_SPLIT_FOLD))
def q_user_disjoint_sets(spark, sf_dir):
    """The whole job: core users, the sample of whole users and its complement, written as two parts and read again."""
    path = scratch_path(spark, "user-sets")
    rat = fx.ratings(spark, sf_dir).select("user_id", "item_id", "rating")
    tr.user_disjoint_sets(rat, split_target(filters.core_users(rat, 20)), SEED, out=path)
    back = spark.read.option("header", True).schema("user_id long, item_id long, rating double, part string").csv(path)
    return back.select("user_id", "item_id", "rating", "part")


@query("E3_analyze", with_views("""
select dataset, method, init, lim, round(rmse_mean, 6) as rmse_mean, round(rmse_std, 6) as rmse_std, count from summ
""", "RUNS", extra=_NESTED_CTES))
def q_analyze_job(spark, sf_dir):
    """The whole job over run configurations in files: read, aligned, summarised."""
    path = scratch_path(spark, "run-configs")
    nested = _nested_runs(spark, sf_dir)
    wr.write_run_configs(nested.select(F.col("run_id").alias("run"), "dataset", F.col("split").alias("dataset_split"), "method",
                                       "init", F.col("lim").alias("limit"), "last_epoch", "is_complete", "results"), path)
    out = tr.analyze(spark, path, pattern="*.json")
    return out.select("dataset", "method", "init", "lim", r6(F.col("rmse_mean")).alias("rmse_mean"),
                      r6(F.col("rmse_std")).alias("rmse_std"), "count")


@query("E4_landscape", "with base as (" + ORACLE["A14_interpolate_rmse"] + """)
select alpha as alphas, max(rmse) filter (split = 'train') as rmse_train, max(rmse) filter (split = 'test') as rmse_test
from base group by alpha
""")
def q_landscape(spark, sf_dir):
    """The whole job: train and test RMSE along the line between two models, one row per step."""
    rat = _rated(spark, sf_dir)
    f = _fac(spark, sf_dir, rat)
    rs = splits.kfold(rat, 5, SEED).withColumn("split", F.when(F.col("fold") == 1, "test").otherwise("train"))
    mu = rs.filter(F.col("split") == "train").agg(F.avg("rating")).first()[0]
    out = tr.landscape(rs, (f[("user", 0)], f[("item", 0)]), (f[("user", 1)], f[("item", 1)]), mu)
    return out.select(r6(F.col("alphas")).alias("alphas"), r6(F.col("rmse_train")).alias("rmse_train"), r6(F.col("rmse_test")).alias("rmse_test"))


# ---------------------------------------------------------------- single-operator entries
from warmstart.plans import datasets as ds  # noqa: E402


@query("S5_read_many", with_views("select user_id, item_id, rating from RAT", "RAT"))
def q_read_many(spark, sf_dir):
    base = scratch_path(spark, "combined-many")
    rat = _rated(spark, sf_dir, "ts")
    for k in range(4):
        write_sectioned(rat.filter(F.col("item_id") % 4 == k), f"{base}/combined_data_{k + 1}", n_files=1)
    paths = [f"{base}/combined_data_{k + 1}" for k in range(4)]
    return rd.read_sectioned_ratings(spark, paths).select("user_id", "item_id", "rating")


_SPLIT_CTES = f"""
core as (select * from RAT where user_id in (select user_id from RAT group by user_id having count(*) >= 20)),
cnt as (select user_id, count(*) as n, {H_USER} as h from core group by user_id),
run as (select user_id, sum(n) over (order by h, user_id rows between unbounded preceding and current row) - n as before from cnt),
sel as (select user_id from run where before < {SPLIT_SQL})
"""


@query("K3_write_split", with_views("""
select c.user_id, c.item_id, case when s.user_id is not null then 'sample' else 'rest' end as part
from core c left join sel s using (user_id)
""", "RAT", extra=_SPLIT_CTES))
def q_write_split(spark, sf_dir):
    path = scratch_path(spark, "leakage-split")
    rat = filters.core_users(fx.ratings(spark, sf_dir), 20)
    wr.write_split(splits.split_users_disjoint(rat, split_target(rat), SEED).select("user_id", "item_id", "part"), path)
    back = spark.read.schema("user_id long, item_id long, part string").option("header", True).csv(path)
    return back.select("user_id", "item_id", "part")


@query("K6_write_results", with_views("""
select dataset, method, init, lim, round(rmse_mean, 6) as rmse_mean, count from summ
""", "RUNS", extra=_NESTED_CTES))
def q_write_results(spark, sf_dir):
    path = scratch_path(spark, "results-csv")
    res = ru.analyze_runs(_nested_runs(spark, sf_dir)).select("dataset", "method", "init", "lim",
                                                               r6(F.col("rmse_mean")).alias("rmse_mean"), "count")
    wr.write_results(res, path)
    return (spark.read.schema("dataset string, method string, init string, lim double, rmse_mean double, count long")
            .option("header", True).csv(path))


@query("P5_mapped_only", with_views("""
select user_id, item_id, rating from RAT where item_id in (select source_item from p1)
""", "RAT", "CAT_A", "CAT_B", extra=_LEFT_CTES))
def q_mapped_only(spark, sf_dir):
    a, b = _cats(spark, sf_dir)
    m, _, _ = mt.match_exact(a, b)
    return filters.mapped_only(fx.ratings(spark, sf_dir), m).select("user_id", "item_id", "rating")


@query("P8_valid_limits", with_views("""
select dataset, method, init, lim2 as lim, count(*) as n from (
  select *, case when run_id % 7 = 0 then lim + 0.05 else lim end as lim2,
            case when run_id % 11 = 0 then null else init end as init2 from RUNS) r
where init2 is not null
group by dataset, method, init, lim2
having lim2 in (0.0::double, 0.1::double, 0.2::double, 0.3::double, 0.4::double, 0.5::double, 0.6::double,
                0.7::double, 0.8::double, 0.9::double, 1.0::double)
""", "RUNS"))
def q_valid_limits(spark, sf_dir):
    r = (fx.runs(spark, sf_dir)
         .withColumn("lim", F.when(F.col("run_id") % 7 == 0, F.col("lim") + 0.05).otherwise(F.col("lim")))
         .withColumn("init", F.when(F.col("run_id") % 11 == 0, F.lit(None)).otherwise(F.col("init"))))
    g = r.groupBy("dataset", "method", "init", "lim").agg(F.count(F.lit(1)).alias("n"))
    return ru.valid_limits(g)


@query("A2_A3_fold_sparsity_mean", with_views(f"""
select fold, round(1 - count(*) / (count(distinct item_id) * count(distinct user_id)), 6) as sparsity,
       round(avg(rating), 6) as global_mean
from (select *, ({sql_hash_int(SEED, 'user_id', 'item_id')}) % 5 + 1 as fold from RAT) r group by fold
""", "RAT"))
def q_sparsity(spark, sf_dir):
    k = splits.kfold(fx.ratings(spark, sf_dir), 5, SEED)
    st = stats.dataset_stats(k, by=["fold"], extra=[F.avg("rating").alias("global_mean")])
    return st.select(F.col("fold").cast("long").alias("fold"), r6(F.col("sparsity")).alias("sparsity"),
                     r6(F.col("global_mean")).alias("global_mean"))


@query("A7_adjacency", with_views("""
select user_id, piece, string_agg(cast(item_id as varchar) || ':' || cast(n as varchar), ',' order by item_id, n) as items
from (select *, cast(floor((row_number() over (partition by user_id order by item_id, n) - 1) / 40) as bigint) as piece
      from IMPL) t
group by user_id, piece
""", "IMPL"))
def q_adjacency(spark, sf_dir):
    adj = stats.adjacency(fx.implicit(spark, sf_dir), "user_id", "item_id", "n", max_len=40)
    return adj.select("user_id", F.col("piece").cast("long").alias("piece"),
                      F.concat_ws(",", F.transform("entries", lambda e: F.concat_ws(
                          ":", e["item_id"].cast("string"), e["n"].cast("string")))).alias("items"))


@query("A12_rating_rows", with_views("""
select user_id, piece, string_agg(cast(item_id as varchar) || '=' || cast(cast(rating as int) as varchar), ',' order by item_id) as cells
from (select *, cast(floor((row_number() over (partition by user_id order by item_id) - 1) / 25) as bigint) as piece
      from RAT) t
group by user_id, piece
""", "RAT"))
def q_rating_rows(spark, sf_dir):
    rows = stats.rating_rows(fx.ratings(spark, sf_dir), max_len=25)
    ent = F.map_entries("cells")
    return rows.select("user_id", F.col("piece").cast("long").alias("piece"),
                       F.concat_ws(",", F.transform(F.array_sort(ent), lambda e: F.concat_ws(
                           "=", e["key"].cast("string"), e["value"].cast("int").cast("string")))).alias("cells"))


@query("A13_row_l2_normalize", with_views("""
select item_id, user_id, round(rating / sqrt(sum(rating * rating) over (partition by item_id)), 6) as value from RAT
""", "RAT"))
def q_l2(spark, sf_dir):
    out = stats.row_l2_normalize(fx.ratings(spark, sf_dir), "item_id", "rating", "value")
    return out.select("item_id", "user_id", r6(F.col("value")).alias("value"))


@query("A15_token_counts", with_views(f"""
select item_id, token, count(*) as cnt from (
  select item_id, unnest(regexp_extract_all({tx.sql_raw_title_year('title')}, '[\\p{{L}}\\p{{N}}_]+')) as token from CAT_A) t
group by item_id, token
""", "CAT_A"))
def q_tokens(spark, sf_dir):
    a = fx.catalog_a(spark, sf_dir).select("item_id", tx.raw_title_year(F.col("title")).alias("key"))
    return stats.token_counts(a, "item_id", "key")


@query("W2_kfold", with_views(f"""
select user_id, item_id, ({sql_hash_int(SEED, 'user_id', 'item_id')}) % 5 + 1 as fold from RAT
""", "RAT"))
def q_kfold(spark, sf_dir):
    k = splits.kfold(fx.ratings(spark, sf_dir), 5, SEED)
    return k.select("user_id", "item_id", F.col("fold").cast("long").alias("fold"))


@query("W5_best_match", with_views("""
select sid as source_item, tid as target_item from (
  select sc.sid, sc.tid, row_number() over (partition by sc.sid order by
           (3 * cosine + 2 * (case when lev_max > lev_min then (lev - lev_min) / (lev_max - lev_min) else 0 end)) / 5 desc,
           sc.tid) as rn
  from sc join mm using (sid)
  where cosine >= 0.5833) x
where rn = 1
""", "CAT_A", "CAT_B", extra=_LEFT_CTES + "," + _PAIR_CTES))
def q_best_match(spark, sf_dir):
    a2, b2 = _left(spark, sf_dir)
    scored = mt.score_pairs(a2, b2, weights=COS_LEV).filter(F.col("cosine") >= 0.5833)
    best = mt.best_match(scored)
    return best.select(F.col("sid").alias("source_item"), F.col("tid").alias("target_item"))


@query("W6_transfer_rank", with_views("""
select source_item, target_item, stage, row_number() over (order by stage, source_item) - 1 as rank from mp
""", "CAT_A", "CAT_B", extra=_LEFT_CTES + """,
mp as (select source_item, min(target_item) as target_item, 1 as stage from p1 group by source_item
       union all select source_item, min(target_item) as target_item, 2 as stage from p2 group by source_item)
"""))
def q_transfer_rank(spark, sf_dir):
    a, b = _cats(spark, sf_dir)
    m = mt.match_items(a, b, fuzzy=False).select("source_item", "target_item", "stage")
    return mt.transfer_rank(m).select("source_item", "target_item", "stage", "rank")


@query("X3_load_dataset", with_views("""
select r.user_id, r.item_id, r.rating, a.title from RAT r join CAT_A a on a.item_id = r.item_id
""", "RAT", "CAT_A"))
def q_load_dataset(spark, sf_dir):
    root = scratch_path(spark, "ml1m-layout")
    rat = fx.ratings(spark, sf_dir)
    (rat.select(F.concat_ws("::", F.col("user_id").cast("string"), F.col("item_id").cast("string"),
                            F.col("rating").cast("int").cast("string"),
                            _epoch_seconds(F.col("ts")).cast("string")).alias("v"))
     .write.mode("overwrite").text(f"{root}/ratings.dat"))
    (fx.catalog_a(spark, sf_dir)
     .select(F.concat_ws("::", F.col("item_id").cast("string"), "title", F.lit("Drama")).alias("v"))
     .write.mode("overwrite").option("sep", "\u0001").option("quote", "").option("escapeQuotes", False)
     .option("encoding", "ISO-8859-1").csv(f"{root}/movies.dat"))
    ratings, items = ds.load_dataset(spark, "ml1m", root)
    return ratings.join(items, "item_id").select("user_id", "item_id", "rating", "title")


@query("X3_load_split_halves", with_views("""
select c.user_id, c.item_id, c.rating, a.title, case when s.user_id is not null then 'sample' else 'rest' end as part
from core c left join sel s using (user_id) join (select item_id, 'The "' || title || '", part 2' as title from CAT_A) a using (item_id)
""", "RAT", "CAT_A", extra=_SPLIT_CTES))
def q_load_split(spark, sf_dir):
    root = scratch_path(spark, "split-layout")
    rat = pinned(filters.core_users(_rated(spark, sf_dir, "ts"), 20), "core")
    lab = splits.split_users_disjoint(rat, split_target(rat), SEED)
    wr.write_split(lab.select("user_id", "item_id", "rating", _epoch_seconds(F.col("ts")).alias("ts"), "part"), root)
    title = F.concat(F.lit('The "'), "title", F.lit('", part 2'))  # quotes are doubled in the file
    (fx.catalog_a(spark, sf_dir).select("item_id", title.alias("title")).write.mode("overwrite").option("header", True)
     .option("escape", '"').csv(f"{root}/movies.csv"))
    out = None
    for part in ("sample", "rest"):
        ratings, items = ds.load_dataset(spark, f"split_{part}", root)
        one = (ratings.join(items, "item_id").select("user_id", "item_id", "rating", "title").withColumn("part", F.lit(part)))
        out = one if out is None else out.unionByName(one)
    return out


@query("X1_metrics_by_name", with_views("""
select sid, tid, greatest(length(s_key), length(t_key)) - levenshtein(s_key, t_key) as levenshtein,
       round(jaro_similarity(s_key, t_key), 6) as jaro, round(jaro_winkler_similarity(s_key, t_key), 6) as jaro_winkler
from pr
""", "CAT_A", "CAT_B", extra=_PAIRS_SQL))
def q_metrics_by_name(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    s, t = F.col("s_key"), F.col("t_key")
    value = {n: sim.metric(n)(s, t) for n in ("levenshtein", "jaro", "jaro_winkler")}
    return p.select("sid", "tid", value["levenshtein"].alias("levenshtein"),
                    *(r6(value[n]).alias(n) for n in ("jaro", "jaro_winkler")))


@query("X2_embeddings_by_name", with_views("""
select method, id, 8::bigint as dim, true as finite
from (select distinct item_id as id from RAT) d cross join (values ('random'), ('svd'), ('word2vec')) m(method)
""", "RAT"))
def q_embeddings_by_name(spark, sf_dir):
    rat = cut_lineage(fx.ratings(spark, sf_dir))
    out = None
    for method in ("random", "svd", "word2vec"):
        one = em.init_embeddings(rat, 8, method, seed=SEED).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return _shape(out).select("method", "id", "dim", "finite")


@query("C2_clean_special_documents", f"""
select doc_id, md5({tx.sql_clean_special('lower(text)')}) as h, length({tx.sql_clean_special('lower(text)')}) as n
from documents
""")
def q_clean_documents(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    c = tx.clean_special(F.lower(F.col("text")))
    return d.select("doc_id", F.md5(c).alias("h"), F.length(c).cast("long").alias("n"))


@query("C3_preprocess_documents", f"""
select doc_id, md5({tx.sql_preprocess_title('text')}) as h, length({tx.sql_preprocess_title('text')}) as n
from documents
""")
def q_preprocess_documents(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    c = tx.preprocess_title(F.col("text"))
    return d.select("doc_id", F.md5(c).alias("h"), F.length(c).cast("long").alias("n"))


@query("A10_group_rmse", with_views("""
select dataset, method, init, lim, round(avg(rmse2), 6) as rmse_mean, round(stddev_samp(rmse2), 6) as rmse_std,
       count(rmse2) as count
from r5 group by dataset, method, init, lim
""", "RUNS", extra=_NESTED_CTES))
def q_group_rmse(spark, sf_dir):
    r = ru.dedupe_runs(ru.normalize_run_labels(ru.complete_runs(_nested_runs(spark, sf_dir))))
    r = r.withColumn("method", ru._map(F.col("method"), ru.METHOD_RENAMES))
    return _r6_cols(ru.group_rmse(ru.align_epoch(r)), ["rmse_mean", "rmse_std"])


@query("O2_init_ordinal", with_views("""
select distinct init, case init when 'random' then 0 when 'pca' then 1 when 'word2vec' then 2 end as init_order
from RUNS
""", "RUNS"))
def q_init_ordinal(spark, sf_dir):
    return ru.init_ordinal(fx.runs(spark, sf_dir).select("init").distinct())


@query("O3_limit_transfer", with_views("""
select source_item, target_item, stage from (
  select *, row_number() over (order by stage, source_item) - 1 as rk from mp) r
where rk < (select ceil(count(*) * 0.3) from CAT_B)
""", "CAT_A", "CAT_B", extra=_LEFT_CTES + """,
mp as (select source_item, min(target_item) as target_item, 1 as stage from p1 group by source_item
       union all select source_item, min(target_item) as target_item, 2 as stage from p2 group by source_item)
"""))
def q_limit_transfer(spark, sf_dir):
    import math

    a, b = _cats(spark, sf_dir)
    m = mt.match_items(a, b, fuzzy=False).select("source_item", "target_item", "stage")
    n_emb = math.ceil(b.count() * 0.3)
    return mt.transfer_rank(m).filter(F.col("rank") < n_emb).select("source_item", "target_item", "stage")

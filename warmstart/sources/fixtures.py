"""Analysis inputs derived from the driver tables (``/root/testdata/sf*/``).

The reference reads public rating dumps that are not shipped. These builders
derive inputs of the same shape from the given tables with ordinary DataFrame
jobs, so every query's work grows with the tables. ``*_SQL`` holds the same
definition as DuckDB text; the oracle queries use it as a CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- RAT: explicit ratings 1..5, one row per (user, item) ---------------------------------
RAT_SQL = """
select o.o_custkey as user_id, l.l_partkey as item_id,
       cast(max(floor((l.l_quantity - 1) / 10) + 1) as double) as rating, max(o.o_orderdate) as ts
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
group by o.o_custkey, l.l_partkey
"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (li.join(od, li.l_orderkey == od.o_orderkey)
            .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
            .agg(F.max(F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double").alias("rating"),
                 F.max("o_orderdate").alias("ts")))


# --- CAT_A / CAT_B: two catalogs of the same items; B ids = A ids + 1,000,000 ------------------
CAT_A_SQL = """
select p_partkey as item_id,
       concat(case when p_partkey % 5 = 0 then replace(p_name,'e','é') else p_name end, ' & ', p_brand, ' ', p_type, ' ',
              cast(p_partkey as varchar), ' (', cast(1990 + p_size % 30 as varchar), ')') as title,
       1990 + p_size % 30 as year
from part
"""

CAT_B_SQL = """
select p_partkey + 1000000 as item_id,
       case p_partkey % 4
         when 0 then concat(case when p_partkey % 5 = 0 then replace(p_name,'e','é') else p_name end, ' & ', p_brand, ' ', p_type, ' ',
                            cast(p_partkey as varchar), ' (', cast(1990 + p_size % 30 as varchar), ')')
         when 1 then concat(p_name, ' and ', p_brand, ' ', p_type, ' ', cast(p_partkey as varchar), ' (', cast(1991 + p_size % 30 as varchar), ')')
         when 2 then concat(p_name, ' ', p_brand, ' ', p_type, 's ', cast(p_partkey as varchar), ' (', cast(1991 + p_size % 30 as varchar), ')')
         else concat('unrelated ', substr(md5(cast(p_partkey as varchar)), 1, 12))
       end as title,
       1990 + p_size % 30 as year
from part
"""


def _accented_name():
    return F.when(F.col("p_partkey") % 5 == 0, F.regexp_replace("p_name", "e", "é")).otherwise(F.col("p_name"))


def catalog_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    year = F.lit(1990) + F.col("p_size") % 30
    return p.select(
        F.col("p_partkey").alias("item_id"),
        F.concat(_accented_name(), F.lit(" & "), "p_brand", F.lit(" "), "p_type", F.lit(" "),
                 F.col("p_partkey").cast("string"), F.lit(" ("), year.cast("string"), F.lit(")")).alias("title"),
        year.alias("year"))


def catalog_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    y0 = (F.lit(1990) + F.col("p_size") % 30).cast("string")
    y1 = (F.lit(1991) + F.col("p_size") % 30).cast("string")
    t0 = F.concat(_accented_name(), F.lit(" & "), "p_brand", F.lit(" "), "p_type", F.lit(" "),
                  k.cast("string"), F.lit(" ("), y0, F.lit(")"))
    t1 = F.concat("p_name", F.lit(" and "), "p_brand", F.lit(" "), "p_type", F.lit(" "),
                  k.cast("string"), F.lit(" ("), y1, F.lit(")"))
    t2 = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), "p_type", F.lit("s "),
                  k.cast("string"), F.lit(" ("), y1, F.lit(")"))
    t3 = F.concat(F.lit("unrelated "), F.substring(F.md5(k.cast("string")), 1, 12))
    title = F.when(k % 4 == 0, t0).when(k % 4 == 1, t1).when(k % 4 == 2, t2).otherwise(t3)
    return p.select((k + 1000000).alias("item_id"), title.alias("title"),
                    (F.lit(1990) + F.col("p_size") % 30).alias("year"))


# --- IMPL: implicit interactions (user, item, n); 100 items for every 1,000 events --------------------------
IMPL_SQL = """
select user_id, cast(json_extract(props,'$.k') as bigint) + 100 * (event_id // 1000) as item_id, count(*) as n
from events where event_type in ('view','click','purchase') group by 1, 2
"""


def implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return (ev.filter(F.col("event_type").isin("view", "click", "purchase"))
            .groupBy("user_id", (F.get_json_object("props", "$.k").cast("bigint") + 100 * F.expr("event_id div 1000")).alias("item_id"))
            .agg(F.count(F.lit(1)).alias("n")))


# --- RUN_METRICS / RUNS: an experiment grid; two runs for every 40 events, of 13 to 27 epochs each ----------
_RUN_SQL = """cast(2 * floor(event_id / 40) + case when event_id % 40 < 13 + floor(event_id / 40) % 7 then 0 else 1 end as int)"""
RUN_METRICS_SQL = f"""
select run_id, cast(row_number() over (partition by run_id order by ts, event_id) - 1 as int) as epoch,
       value / 100 as loss, (value + 5) / 100 as val_loss
from (select *, {_RUN_SQL} as run_id from events) e
"""

RUNS_SQL = """
select run_id, case when run_id % 2 = 0 then 'ML1M' else 'ExplicitMLTransfer' end as dataset,
       concat('Pretrained from src_', case cast(floor(run_id / 165) as int) % 3 when 0 then 'random' when 1 then 'pca' else 'word2vec' end) as method,
       case cast(floor(run_id / 55) as int) % 3 when 0 then 'random' when 1 then 'pca' else 'word2vec' end as init,
       cast(cast(floor(run_id / 5) as int) % 11 / 10.0 as double) as lim,
       run_id % 5 + 1 as split, count(*) as last_epoch, run_id % 13 <> 0 as is_complete
from RUN_METRICS group by run_id
"""


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    run = F.expr(_RUN_SQL)
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    return (ev.withColumn("run_id", run)
            .select("run_id", (F.row_number().over(w) - 1).cast("int").alias("epoch"),
                    (F.col("value") / 100).alias("loss"), ((F.col("value") + 5) / 100).alias("val_loss")))


def _level(c):
    return F.when(c == 0, "random").when(c == 1, "pca").otherwise("word2vec")


def runs(spark: SparkSession, sf_dir: str, metrics: DataFrame | None = None) -> DataFrame:
    m = metrics if metrics is not None else run_metrics(spark, sf_dir)
    r = F.col("run_id")
    return (m.groupBy("run_id").agg(F.count(F.lit(1)).alias("last_epoch"))
            .select("run_id",
                    F.when(r % 2 == 0, "ML1M").otherwise("ExplicitMLTransfer").alias("dataset"),
                    F.concat(F.lit("Pretrained from src_"), _level(F.floor(r / 165).cast("int") % 3)).alias("method"),
                    _level(F.floor(r / 55).cast("int") % 3).alias("init"),
                    ((F.floor(r / 5).cast("int") % 11) / 10.0).cast("double").alias("lim"),
                    (r % 5 + 1).alias("split"), "last_epoch", (r % 13 != 0).alias("is_complete")))


# --- FAC0 / FAC1: two factor models (dim 64) over the ids of RAT ----------------------------
def _fac_sql(side: str, model: int) -> str:
    col = "item_id" if side == "item" else "user_id"
    n = "(select count(*) from embeddings)"
    if side == "item":
        vec = f"r.item_id % {n}" if model == 0 else f"(r.item_id * 7 + 3) % {n}"
        bias = "(r.item_id % 11 - 5) / 10.0"
    else:
        vec = f"(r.user_id * 3 + 1) % {n}" if model == 0 else f"(r.user_id * 11 + 5) % {n}"
        bias = "(r.user_id % 7 - 3) / 10.0"
    return (f"select r.{col} as id, e.embedding as vec, cast({bias} as double) as bias "
            f"from (select distinct {col} from RAT) r join embeddings e on e.vec_id = {vec}")


FAC_SQL = {(side, m): _fac_sql(side, m) for side in ("item", "user") for m in (0, 1)}


def factors(spark: SparkSession, sf_dir: str, side: str, model: int, rat: DataFrame | None = None) -> DataFrame:
    """``(id, vec, bias double)`` for one side of fixture model 0 or 1; ``vec`` is array<float> as in the table, doubles where they are worked on."""
    rat = rat if rat is not None else ratings(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    i, n = F.col("id"), F.lit(emb.count())  # every vector of the table is used
    if side == "item":
        vec_id = i % n if model == 0 else (i * 7 + 3) % n
        bias = (i % 11 - 5) / 10.0
    else:
        vec_id = (i * 3 + 1) % n if model == 0 else (i * 11 + 5) % n
        bias = (i % 7 - 3) / 10.0
    ids = rat.select(F.col("item_id" if side == "item" else "user_id").alias("id")).distinct()
    return (ids.withColumn("vec_id", vec_id).join(emb, "vec_id")
            .select("id", "vec", bias.cast("double").alias("bias")))


def with_views(sql: str, *names: str, extra: str = "") -> str:
    """Prefix an oracle query with the fixture views it uses, as CTEs (DuckDB).

    ``extra`` holds further ``name as (...)`` CTE definitions, comma separated."""
    defs = {"RAT": RAT_SQL, "CAT_A": CAT_A_SQL, "CAT_B": CAT_B_SQL, "IMPL": IMPL_SQL,
            "RUN_METRICS": RUN_METRICS_SQL, "RUNS": RUNS_SQL}
    for side in ("item", "user"):
        for m in (0, 1):
            defs[f"FAC{m}_{side.upper()}"] = FAC_SQL[(side, m)]
    order = ["RAT", "CAT_A", "CAT_B", "IMPL", "RUN_METRICS", "RUNS",
             "FAC0_ITEM", "FAC0_USER", "FAC1_ITEM", "FAC1_USER"]
    wanted = set(names)
    if wanted & {"RUNS"}:
        wanted.add("RUN_METRICS")
    if any(n.startswith("FAC") for n in wanted):
        wanted.add("RAT")
    ctes = [f"{n} as ({defs[n].strip()})" for n in order if n in wanted]
    if extra.strip():
        ctes.append(extra.strip())
    if not ctes:
        return sql.strip()
    return "with " + ",\n".join(ctes) + "\n" + sql.strip()

"""Analysis inputs derived from the given tables, written twice with the same
expressions: as Spark DataFrames and as SQL CTEs for the DuckDB oracle.

The base tables have no nulls or duplicates, so "dirty" inputs are derived
deterministically from ids (null when ``event_id % 7 = 0`` etc.). The full
tables are always used; the modulo rules only decide *which* cells are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------ fx_dirty

def fx_dirty(spark, d):
    e = table(spark, d, "events")
    eid = F.col("event_id")
    base = e.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.when(eid % 7 == 0, F.lit(None)).otherwise(F.col("value")).cast("double").alias("value_n"),
        F.when(eid % 4 == 0, F.lit(None)).otherwise(F.col("event_type")).cast("string").alias("type_n"),
        F.when(eid % 3 == 0, F.col("user_id")).cast("bigint").alias("sparse_n"),
        F.lit(1.0).alias("k"),
        (F.col("value") * 2 + 1).alias("value2"),
    )
    return base.unionByName(base.filter(eid % 10 == 0))


SQL_FX_DIRTY = """fx_dirty_base AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS DOUBLE) AS value_n,
         CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS VARCHAR) AS type_n,
         CAST(CASE WHEN event_id % 3 = 0 THEN user_id END AS BIGINT) AS sparse_n,
         CAST(1.0 AS DOUBLE) AS k,
         value * 2 + 1 AS value2
  FROM events),
fx_dirty AS (SELECT * FROM fx_dirty_base UNION ALL SELECT * FROM fx_dirty_base WHERE event_id % 10 = 0)"""

DIRTY_NUMERIC = ["event_id", "user_id", "value", "value_n", "sparse_n", "k", "value2"]


# ------------------------------------------------------------------ fx_strings

def fx_strings(spark, d):
    e = table(spark, d, "events")
    eid, v = F.col("event_id"), F.col("value").cast("string")
    return e.select(
        "event_id",
        F.when(eid % 10 == 0, F.lit("x")).otherwise(v).alias("s_num90"),
        F.when(eid % 3 == 0, F.lit("x")).otherwise(v).alias("s_num67"),
        F.when(eid % 10 == 1, F.lit("1d")).when(eid % 10 == 2, F.lit("NA"))
         .when(eid % 10 == 3, F.lit("")).otherwise(v).alias("s_mixed"),
        F.col("ts").cast("string").alias("s_ts"),
        F.col("event_type").alias("s_cat"),
    )


SQL_FX_STRINGS = """fx_strings AS (
  SELECT event_id,
         CASE WHEN event_id % 10 = 0 THEN 'x' ELSE CAST(value AS VARCHAR) END AS s_num90,
         CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(value AS VARCHAR) END AS s_num67,
         CASE WHEN event_id % 10 = 1 THEN '1d' WHEN event_id % 10 = 2 THEN 'NA'
              WHEN event_id % 10 = 3 THEN '' ELSE CAST(value AS VARCHAR) END AS s_mixed,
         CAST(ts AS VARCHAR) AS s_ts,
         event_type AS s_cat
  FROM events)"""


# ------------------------------------------------------------------ time series

def fx_ts_regular(spark, d):
    e = table(spark, d, "events")
    return (e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
            .agg(F.sum("value").alias("value_sum"), F.avg("value").alias("value_avg"),
                 F.max("value").alias("value_max"), F.count(F.lit(1)).cast("bigint").alias("n")))


SQL_FX_TS_REGULAR = """fx_ts_regular AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, sum(value) AS value_sum,
         avg(value) AS value_avg, max(value) AS value_max, CAST(count(*) AS BIGINT) AS n
  FROM events GROUP BY 1)"""


def fx_orders_daily(spark, d):
    o = table(spark, d, "orders")
    return (o.groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day"))
            .agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).cast("bigint").alias("n_orders")))


SQL_FX_ORDERS_DAILY = """fx_orders_daily AS (
  SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day, sum(o_totalprice) AS revenue,
         CAST(count(*) AS BIGINT) AS n_orders
  FROM orders GROUP BY 1)"""


# ------------------------------------------------------------------ categorical

def fx_cat(spark, d):
    li = table(spark, d, "lineitem")
    p = table(spark, d, "part")
    # part is the dimension side: Catalyst broadcasts it only under the configured size threshold
    return li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
        "p_size", "p_retailprice", "l_linestatus", "l_returnflag", "p_type", "p_brand", "l_extendedprice")


SQL_FX_CAT = """fx_cat AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, p_size, p_retailprice,
         l_linestatus, l_returnflag, p_type, p_brand, l_extendedprice
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


# ------------------------------------------------------------------ A/B inputs

def fx_ab_cont(spark, d):
    e = table(spark, d, "events")
    return e.filter(F.col("event_type").isin("click", "view")).select(
        "event_id", F.col("event_type").alias("arm"),
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("value")).cast("double").alias("outcome"),
        (F.col("user_id") % 5).alias("segment"))


SQL_FX_AB_CONT = """fx_ab_cont AS (
  SELECT event_id, event_type AS arm,
         CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS DOUBLE) AS outcome,
         user_id % 5 AS segment
  FROM events WHERE event_type IN ('click', 'view'))"""


def fx_ab_bin(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.col("l_linestatus").alias("arm"),
                     (F.col("l_returnflag") == "R").cast("int").alias("outcome"),
                     F.col("l_returnflag").alias("segment"))


SQL_FX_AB_BIN = """fx_ab_bin AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus AS arm,
         CAST(l_returnflag = 'R' AS INTEGER) AS outcome, l_returnflag AS segment
  FROM lineitem)"""


# ------------------------------------------------------------------ causal input

def fx_causal(spark, d, confounded: bool = False):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    if confounded:
        u = ((F.col("o_orderkey") * 7919) % 1009) / 1009.0
        p = (F.col("c_acctbal") + 1000.0) / 11000.0
        t = (u < p).cast("int")
        y = F.col("o_totalprice") + 0.1 * F.col("c_acctbal") + 5000.0 * t
    else:
        t = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")
        y = F.col("o_totalprice")
    return j.select("o_orderkey", t.alias("treated"), y.alias("outcome"),
                    "c_acctbal", "c_nationkey", "c_mktsegment")


SQL_FX_CAUSAL = """fx_causal AS (
  SELECT o_orderkey, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS treated,
         o_totalprice AS outcome, c_acctbal, c_nationkey, c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

SQL_FX_CAUSAL_CONF = """fx_causal_conf AS (
  SELECT o_orderkey,
         CAST(((o_orderkey * 7919) % 1009) / 1009.0 < (c_acctbal + 1000.0) / 11000.0 AS INTEGER) AS treated,
         o_totalprice + 0.1 * c_acctbal
           + 5000.0 * CAST(((o_orderkey * 7919) % 1009) / 1009.0 < (c_acctbal + 1000.0) / 11000.0 AS INTEGER) AS outcome,
         c_acctbal, c_nationkey, c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


# ------------------------------------------------------------------ scored outputs

def fx_scored(spark, d):
    lb = table(spark, d, "labels")
    dc = table(spark, d, "documents")
    score = F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 6)
    return lb.join(dc, "doc_id").select("doc_id", F.col("quality").alias("label"), score.alias("score"),
                                        (score > 0.5).cast("int").alias("prediction"))


SQL_FX_SCORED = """fx_scored AS (
  SELECT doc_id, quality AS label, round(n_chars / (n_chars + 2000.0), 6) AS score,
         CAST(round(n_chars / (n_chars + 2000.0), 6) > 0.5 AS INTEGER) AS prediction
  FROM labels JOIN documents USING (doc_id))"""


def fx_scored_reg(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.col("l_extendedprice").alias("actual"),
                     (F.col("l_quantity") * 1500.0).alias("predicted"))


SQL_FX_SCORED_REG = """fx_scored_reg AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS actual,
         l_quantity * 1500.0 AS predicted
  FROM lineitem)"""


def fx_multiclass(spark, d):
    """3-class labels with a deterministic 'prediction' (for confusion / report)."""
    li = table(spark, d, "lineitem")
    pred = (F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.07, "N").otherwise("R"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.col("l_returnflag").alias("label"), pred.alias("prediction"))


SQL_FX_MULTICLASS = """fx_multiclass AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS label,
         CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END AS prediction
  FROM lineitem)"""


def with_ctes(body: str, *ctes: str) -> str:
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body

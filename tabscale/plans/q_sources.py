"""Registered source / sink queries (S1-S7) and the order primitives (J1, W1, W2, R1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import order as O
from ..session import scratch_path
from ..sources import readers as R
from ..sources import sinks as S
from . import fixtures as X
from . import q_clean, q_profile  # noqa: F401 - their oracles count the report sections
from .registry import ORACLES, register

_NUM_RE = r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*"
_NA_SQL = ", ".join("'" + t + "'" for t in R.NA_TOKENS)


def _na(c):
    return f"CASE WHEN {c} IN ({_NA_SQL}) THEN NULL ELSE {c} END"


@register("scan_csv", X.with_ctes(
    f"""SELECT CAST(event_id AS DOUBLE) AS event_id,
       CASE WHEN regexp_full_match(s_num90, '{_NUM_RE}') THEN TRY_CAST(trim(s_num90) AS DOUBLE) END AS s_num90,
       {_na('s_num67')} AS s_num67, {_na('s_mixed')} AS s_mixed,
       CAST(try_strptime(s_ts, ['%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S']) AS TIMESTAMP) AS s_ts, s_cat
    FROM fx_strings""", X.SQL_FX_STRINGS))
def q_scan_csv(spark, d):
    path = scratch_path(spark, "csv") + "/fx_strings.csv"
    X.fx_strings(spark, d).write.option("header", True).csv(path)
    return R.scan_csv(spark, path, order_by=["event_id"])


@register("scan_parquet", """SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 45""")
def q_scan_parquet(spark, d):
    return R.scan_parquet(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_extendedprice"],
                          F.col("l_quantity") > 45)


@register("load_table", "SELECT * FROM orders")
def q_load_table(spark, d):
    df, _ = R.load_table(spark, f"{d}/orders.parquet", with_meta=False)
    return df


@register("table_meta", """SELECT 'events.parquet' AS filename, CAST(count(*) AS BIGINT) AS n_rows, 6 AS n_cols,
    CAST(sum((event_id IS NULL)::INT + (ts IS NULL)::INT + (user_id IS NULL)::INT + (event_type IS NULL)::INT
         + (value IS NULL)::INT + (props IS NULL)::INT) AS BIGINT) AS missing_cells,
    TRUE AS is_ts, 'ts' AS datetime_col, 'T' AS ts_freq FROM events""")
def q_table_meta(spark, d):
    df, meta = R.load_table(spark, f"{d}/events.parquet", order_by=["event_id"])
    return spark.createDataFrame([(meta.filename, meta.n_rows, meta.n_cols, meta.missing_cells, meta.is_ts,
                                   meta.datetime_col, meta.ts_freq)],
                                 "filename string, n_rows long, n_cols int, missing_cells long, is_ts boolean, "
                                 "datetime_col string, ts_freq string")


@register("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def q_preview(spark, d):
    return R.preview(X.table(spark, d, "orders"), ["o_orderkey"], 10)


@register("save_model", X.with_ctes("SELECT hour, true AS equal FROM fx_ts_regular", X.SQL_FX_TS_REGULAR))
def q_save_model(spark, d):
    from ..operators import models as ML
    from .q_models import REG_X, fx_model_reg
    df = fx_model_reg(spark, d)
    model = ML.fit_cached(ML.build_pipeline(ML.regression_models(df.count())["Ridge"], REG_X, "value_sum", "regression"), df)
    path = S.save_model(model, scratch_path(spark, "model"))
    again = S.load_model(path)
    a = model.transform(df).select("hour", F.col("prediction").alias("p1"))
    b = again.transform(df).select("hour", F.col("prediction").alias("p2"))
    return a.join(b, "hour").select("hour", (F.abs(F.col("p1") - F.col("p2")) < 1e-9).alias("equal"))


def _report_sql():
    parts = {"outliers": "outlier_summary", "describe": "describe_numeric", "nulls": "null_counts"}
    return " UNION ALL ".join(f"SELECT '{k}' AS section, (SELECT count(*) FROM ({ORACLES[v]})) AS n_rows" for k, v in parts.items())


@register("write_report_tables", _report_sql())
def q_write_report_tables(spark, d):
    from ..operators import clean as C
    from ..operators import profile as P
    fx = X.fx_dirty(spark, d)
    return S.write_report_tables(spark, {"outliers": C.outlier_summary(fx), "describe": P.describe_numeric(fx),
                                         "nulls": C.null_counts(fx)}).select("section", "n_rows")


# ------------------------------------------------------------------ order primitives

@register("row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders")
def q_row_index(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return O.row_index(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "idx")


@register("midrank", """SELECT o_orderkey, o_orderstatus,
    rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0 AS rank
  FROM orders""")
def q_midrank(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return O.midrank(o, "o_totalprice", by=["o_orderstatus"]).select("o_orderkey", "o_orderstatus", "rank")


@register("nearest_join", """SELECT l.o_orderkey, round(min(abs(l.o_totalprice - r.v)), 6) AS distance
  FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') l,
       (SELECT o_totalprice AS v FROM orders WHERE o_orderpriority <> '1-URGENT') r
  GROUP BY l.o_orderkey""")
def q_nearest_join(spark, d):
    o = X.table(spark, d, "orders")
    left = o.filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_totalprice")
    right = o.filter(F.col("o_orderpriority") != "1-URGENT").select("o_totalprice")
    return O.nearest_join(left, right, "o_totalprice").select("o_orderkey", F.round("distance", 6).alias("distance"))


@register("sample_per_group_counts", """SELECT o_orderstatus, least(50, count(*)) AS n, least(50, count(*)) AS of_group
  FROM orders GROUP BY o_orderstatus""")
def q_sample_per_group_counts(spark, d):
    o = X.table(spark, d, "orders").select("o_orderstatus", "o_orderkey")
    s = O.sample_per_group(o, 50, by=["o_orderstatus"], id_col="o_orderkey").select("o_orderstatus", "o_orderkey")
    back = s.join(o, ["o_orderstatus", "o_orderkey"], "left_semi").groupBy("o_orderstatus").agg(F.count_distinct("o_orderkey").alias("of_group"))
    return s.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).join(back, "o_orderstatus")


@register("sample_per_group")
def q_sample_per_group(spark, d):
    o = X.table(spark, d, "orders")
    s = O.sample_per_group(o, 50, by=["o_orderstatus"], id_col="o_orderkey")
    return s.select("o_orderstatus", "o_orderkey")

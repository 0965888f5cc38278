"""Registered type-coercion and detection queries (T1-T9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from . import fixtures as X
from .registry import register
from .sqlgen import union_all

COL = '"column"'
# same pattern as detect.NUMERIC_PATTERN (DuckDB regexp_full_match)
_NUM_RE = r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*"


def _num_sql(c):
    return f"CASE WHEN regexp_full_match({c}, '{_NUM_RE}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


@register("coerce_numeric", X.with_ctes(
    f"SELECT event_id, {_num_sql('s_num90')} AS s_num90, s_num67, s_mixed, s_ts, s_cat FROM fx_strings",
    X.SQL_FX_STRINGS))
def q_coerce_numeric(spark, d):
    out, _ = D.coerce_numeric(X.fx_strings(spark, d), ["s_num90", "s_num67", "s_mixed", "s_ts", "s_cat"])
    return out


_SHARES = union_all([f"SELECT '{c}' AS {COL}, round(count({_num_sql(c)}) / count(*), 6) AS numeric_share, "
                     f"count({_num_sql(c)}) / count(*) > 0.8 AS coerced FROM fx_strings"
                     for c in ["s_num90", "s_num67", "s_mixed", "s_ts", "s_cat"]])


@register("numeric_shares", X.with_ctes(_SHARES, X.SQL_FX_STRINGS))
def q_numeric_shares(spark, d):
    sh = D.numeric_shares(X.fx_strings(spark, d), ["s_num90", "s_num67", "s_mixed", "s_ts", "s_cat"])
    return spark.createDataFrame([(c, round(v, 6), v > 0.8) for c, v in sh.items()],
                                 "column string, numeric_share double, coerced boolean")


@register("coerce_datetime", X.with_ctes(
    "SELECT event_id, CAST(try_strptime(s_ts, ['%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S']) AS TIMESTAMP) AS s_ts, "
    "s_num67, s_cat FROM fx_strings", X.SQL_FX_STRINGS))
def q_coerce_datetime(spark, d):
    df = X.fx_strings(spark, d).select("event_id", "s_ts", "s_num67", "s_cat")
    out, _ = D.coerce_datetime(df, ["s_ts", "s_num67", "s_cat"], order_by=["event_id"])
    return out


def _task_sql(src, cols_types):
    parts = []
    for c, is_str in cols_types:
        t = "'classification'" if is_str else \
            f"CASE WHEN count(DISTINCT {c}) <= 20 THEN 'classification' ELSE 'regression' END"
        parts.append(f"SELECT '{c}' AS {COL}, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, {t} AS task_type FROM {src}")
    return union_all(parts)


_CAT_COLS = [("l_orderkey", False), ("l_linenumber", False), ("l_partkey", False), ("l_suppkey", False),
             ("l_quantity", False), ("l_discount", False), ("p_size", False), ("p_retailprice", False),
             ("l_linestatus", True), ("l_returnflag", True), ("p_type", True), ("p_brand", True),
             ("l_extendedprice", False)]


@register("infer_task_type", X.with_ctes(_task_sql("fx_cat", _CAT_COLS), X.SQL_FX_CAT))
def q_infer_task_type(spark, d):
    return D.task_types(X.fx_cat(spark, d))


@register("detect_datetime_col", X.with_ctes(
    "SELECT 's_ts' AS datetime_col, CAST(count(try_strptime(s_ts, ['%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S'])) AS BIGINT) "
    "AS n_non_null FROM fx_strings", X.SQL_FX_STRINGS))
def q_detect_datetime_col(spark, d):
    c, n = D.detect_datetime_col(X.fx_strings(spark, d))
    return spark.createDataFrame([(c, n)], "datetime_col string, n_non_null long")


_MONO_SQL = """SELECT '{name}' AS series,
  COALESCE(bool_and(p IS NULL OR t >= p), TRUE) AND count(t) = count(*) AS increasing,
  COALESCE(bool_and(p IS NULL OR t <= p), TRUE) AND count(t) = count(*) AS decreasing
FROM (SELECT {t} AS t, lag({t}) OVER (ORDER BY {o}) AS p FROM {src})"""


@register("is_monotonic", union_all([
    _MONO_SQL.format(name="events_by_id", t="ts", o="event_id", src="events"),
    _MONO_SQL.format(name="orders_by_key", t="o_orderdate", o="o_orderkey", src="orders"),
    _MONO_SQL.format(name="orders_by_date", t="o_orderdate", o="o_orderdate, o_orderkey", src="orders")]))
def q_is_monotonic(spark, d):
    e = X.table(spark, d, "events")
    o = X.table(spark, d, "orders")
    rows = []
    for name, df, t, order in (("events_by_id", e, "ts", ["event_id"]), ("orders_by_key", o, "o_orderdate", ["o_orderkey"]),
                               ("orders_by_date", o, "o_orderdate", ["o_orderdate", "o_orderkey"])):
        m = D.monotonic(df, t, order)
        rows.append((name, m["increasing"], m["decreasing"]))
    return spark.createDataFrame(rows, "series string, increasing boolean, decreasing boolean")


@register("infer_freq", X.with_ctes(
    """SELECT 'events_hourly' AS series, CASE WHEN min(g) = max(g) AND min(g) = 3600 THEN 'h' END AS freq
       FROM (SELECT epoch(hour) - epoch(lag(hour) OVER (ORDER BY hour)) AS g FROM fx_ts_regular)
    UNION ALL
    SELECT 'orders_daily', CASE WHEN min(g) = max(g) AND min(g) = 86400 THEN 'D' END
       FROM (SELECT epoch(day) - epoch(lag(day) OVER (ORDER BY day)) AS g FROM fx_orders_daily)""",
    X.SQL_FX_TS_REGULAR, X.SQL_FX_ORDERS_DAILY))
def q_infer_freq(spark, d):
    rows = [("events_hourly", D.infer_freq(X.fx_ts_regular(spark, d), "hour")),
            ("orders_daily", D.infer_freq(X.fx_orders_daily(spark, d), "day"))]
    return spark.createDataFrame(rows, "series string, freq string")


def _est_sql(name, t, src):
    return f"""SELECT '{name}' AS series, round(med, 6) AS median_gap_s,
      CASE WHEN med < 3600 THEN 'T' WHEN med < 86400 THEN 'H' WHEN med < 345600 THEN 'D' WHEN med < 864000 THEN 'W'
           WHEN med < 3024000 THEN 'M' WHEN med < 8640000 THEN 'Q' ELSE 'A' END AS freq
    FROM (SELECT quantile_cont(g, 0.5) AS med FROM (
      SELECT (epoch_us({t}) - epoch_us(lag({t}) OVER (ORDER BY {t}))) / 1e6 AS g FROM {src} WHERE {t} IS NOT NULL)
      WHERE g IS NOT NULL)"""


@register("estimate_freq", X.with_ctes(union_all([
    _est_sql("events", "ts", "events"), _est_sql("orders", "o_orderdate", "orders"),
    _est_sql("orders_daily", "day", "fx_orders_daily")]), X.SQL_FX_ORDERS_DAILY))
def q_estimate_freq(spark, d):
    rows = []
    for name, df, t in (("events", X.table(spark, d, "events"), "ts"), ("orders", X.table(spark, d, "orders"), "o_orderdate"),
                        ("orders_daily", X.fx_orders_daily(spark, d), "day")):
        f, med = D.estimate_freq(df, t)
        rows.append((name, None if med is None else round(med, 6), f))
    return spark.createDataFrame(rows, "series string, median_gap_s double, freq string")


def _summary_sql(name, t, order, src, regular_alias):
    mono = f"""(SELECT (COALESCE(bool_and(p IS NULL OR x >= p), TRUE) OR COALESCE(bool_and(p IS NULL OR x <= p), TRUE))
                     AND count(x) = count(*) FROM (SELECT {t} AS x, lag({t}) OVER (ORDER BY {order}) AS p FROM {src}))"""
    gaps = f"(SELECT epoch_us({t}) - epoch_us(lag({t}) OVER (ORDER BY {t})) AS g FROM {src} WHERE {t} IS NOT NULL)"
    regular = (f"(SELECT CASE WHEN count(g) >= 2 AND min(g) = max(g) AND min(g) = 3600000000 THEN '{regular_alias}' END "
               f"FROM {gaps})")
    med = f"(SELECT quantile_cont(g / 1e6, 0.5) FROM {gaps} WHERE g IS NOT NULL)"
    bucket = (f"CASE WHEN {med} < 3600 THEN 'T' WHEN {med} < 86400 THEN 'H' WHEN {med} < 345600 THEN 'D' "
              f"WHEN {med} < 864000 THEN 'W' WHEN {med} < 3024000 THEN 'M' WHEN {med} < 8640000 THEN 'Q' ELSE 'A' END")
    return f"""SELECT '{name}' AS dataset, {mono} AS is_ts, '{t}' AS datetime_col,
       CASE WHEN {mono} THEN COALESCE({regular}, {bucket}) END AS freq,
       CASE WHEN {mono} THEN (SELECT CAST(count({t}) AS BIGINT) FROM {src}) ELSE CAST(0 AS BIGINT) END AS n_periods"""


@register("ts_summary", X.with_ctes(union_all([
    _summary_sql("events", "ts", "event_id", "events", "h"),
    _summary_sql("events_hourly", "hour", "hour", "fx_ts_regular", "h"),
    _summary_sql("orders", "o_orderdate", "o_orderkey", "orders", "h")]), X.SQL_FX_TS_REGULAR))
def q_ts_summary(spark, d):
    rows = []
    for name, df, order in (("events", X.table(spark, d, "events"), ["event_id"]),
                            ("events_hourly", X.fx_ts_regular(spark, d), ["hour"]),
                            ("orders", X.table(spark, d, "orders"), ["o_orderkey"])):
        s = D.ts_summary(df, order)
        rows.append((name, s.is_ts, s.datetime_col, s.freq, s.n_periods))
    return spark.createDataFrame(rows, "dataset string, is_ts boolean, datetime_col string, freq string, n_periods long")


def _outcome_sql(src, cols):
    return union_all([
        f"SELECT '{c}' AS {COL}, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, "
        f"CASE WHEN count(DISTINCT {c}) = 2 OR ({str(s).upper()} AND count(DISTINCT {c}) <= 5) THEN 'binary' "
        f"ELSE 'continuous' END AS outcome_type FROM {src}" for c, s in cols])


@register("detect_outcome_type", X.with_ctes(
    _outcome_sql("fx_cat", [("l_linestatus", True), ("l_returnflag", True), ("p_type", True), ("p_brand", True),
                            ("l_quantity", False), ("l_extendedprice", False)]), X.SQL_FX_CAT))
def q_detect_outcome_type(spark, d):
    return D.outcome_types(X.fx_cat(spark, d), ["l_linestatus", "l_returnflag", "p_type", "p_brand",
                                                "l_quantity", "l_extendedprice"])

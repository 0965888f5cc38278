"""Registered profiling queries (E1-E15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from . import fixtures as X
from .registry import register
from .sqlgen import union_all

NUM = X.DIRTY_NUMERIC
ALL_COLS = ["event_id", "ts", "user_id", "event_type", "value", "value_n", "type_n", "sparse_n", "k", "value2"]
CAT = ["event_type", "type_n"]
COL = '"column"'

# DuckDB type names mapped to Spark's simple type strings.
SPARK_TYPE_SQL = ("CASE typeof({c}) WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' "
                  "WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'INTEGER' THEN 'int' WHEN 'BOOLEAN' THEN 'boolean' END")


def _w(body, *ctes):
    return X.with_ctes(body, X.SQL_FX_DIRTY, *ctes)


_DESC = union_all([
    f"""SELECT '{c}' AS {COL}, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25,
       round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max,
       round(CASE WHEN count({c}) >= 3 AND stddev_pop({c}) > 0 THEN skewness({c}) END, 6) AS skew,
       round(CASE WHEN count({c}) >= 4 AND stddev_pop({c}) > 0 THEN kurtosis({c}) END, 6) AS kurtosis FROM fx_dirty"""
    for c in NUM])


@register("describe_numeric", _w(_DESC))
def q_describe_numeric(spark, d):
    return P.describe_numeric(X.fx_dirty(spark, d))


def _top_sql(c, k, src="fx_dirty"):
    return (f"SELECT v, cnt, row_number() OVER (ORDER BY cnt DESC, v) AS rk FROM "
            f"(SELECT CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM {src} WHERE {c} IS NOT NULL GROUP BY 1) "
            f"QUALIFY rk <= {k}")


_CATSQL = union_all([
    f"""SELECT '{c}' AS {COL}, CAST(count(DISTINCT {c}) AS BIGINT) AS "unique",
       (SELECT v FROM ({_top_sql(c, 1)})) AS top, CAST((SELECT cnt FROM ({_top_sql(c, 1)})) AS BIGINT) AS top_freq,
       round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct FROM fx_dirty""" for c in CAT])


@register("describe_categorical", _w(_CATSQL))
def q_describe_categorical(spark, d):
    return P.describe_categorical(X.fx_dirty(spark, d))


_SCHEMA = union_all([
    f"SELECT '{c}' AS {COL}, any_value({SPARK_TYPE_SQL.format(c=c)}) AS dtype, {i} AS position, "
    f"CAST(count(*) AS BIGINT) AS n_rows, {len(ALL_COLS)} AS n_cols FROM fx_dirty" for i, c in enumerate(ALL_COLS)])


@register("schema_profile", _w(_SCHEMA))
def q_schema_profile(spark, d):
    return P.schema_profile(X.fx_dirty(spark, d))


def _overview_sql():
    parts = []
    for c in ALL_COLS:
        head = (f"SELECT '{c}' AS {COL}, any_value({SPARK_TYPE_SQL.format(c=c)}) AS dtype, "
                f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, "
                f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, ")
        if c in NUM:
            parts.append(head + f"round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, "
                         f"round(stddev_samp({c}), 6) AS std, "
                         f"round(CASE WHEN count({c}) >= 3 AND stddev_pop({c}) > 0 THEN skewness({c}) END, 6) AS skew, "
                         f"CAST(NULL AS VARCHAR) AS top_values FROM fx_dirty")
        else:
            parts.append(head + "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, "
                         "CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS skew, "
                         f"(SELECT string_agg(v, ', ' ORDER BY rk) FROM ({_top_sql(c, 3)})) AS top_values FROM fx_dirty")
    return union_all(parts)


@register("column_overview", _w(_overview_sql()))
def q_column_overview(spark, d):
    return P.column_overview(X.fx_dirty(spark, d))


def _corr_sql(c1, c2, src="fx_dirty"):
    a = f"CASE WHEN {c2} IS NOT NULL THEN {c1} END"
    b = f"CASE WHEN {c1} IS NOT NULL THEN {c2} END"
    return (f"CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN NULL "
            f"ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END")


_PAIRS = [(i, j) for i in range(len(NUM)) for j in range(i + 1, len(NUM))]
_CORR = union_all([
    f"SELECT '{NUM[i]}' AS col_a, '{NUM[j]}' AS col_b, {i} AS i, {j} AS j, round({_corr_sql(NUM[i], NUM[j])}, 6) AS r "
    f"FROM fx_dirty" for i, j in _PAIRS])


@register("corr_matrix", _w(_CORR))
def q_corr_matrix(spark, d):
    return P.corr_long(X.fx_dirty(spark, d))


@register("high_corr_pairs", _w(
    f"SELECT col_a, col_b, round(abs(r), 6) AS abs_r FROM ({_CORR}) WHERE abs(r) > 0.95 ORDER BY j, i LIMIT 5"))
def q_high_corr_pairs(spark, d):
    return P.high_corr_pairs(X.fx_dirty(spark, d))


_NULLPCT = union_all([f"SELECT '{c}' AS {COL}, round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct "
                      f"FROM fx_dirty" for c in ALL_COLS])


@register("flag_high_null", _w(f"SELECT * FROM ({_NULLPCT}) WHERE null_pct > 20"))
def q_flag_high_null(spark, d):
    return P.flag_high_null(X.fx_dirty(spark, d))


@register("flag_zero_variance", _w(
    "SELECT * FROM (" + union_all([f"SELECT '{c}' AS {COL}, stddev_samp({c}) AS s FROM fx_dirty" for c in NUM])
    + f") WHERE s = 0"))
def q_flag_zero_variance(spark, d):
    return P.flag_zero_variance(X.fx_dirty(spark, d)).withColumn("s", F.lit(0.0))


_CB = ("SELECT CAST(l_returnflag AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS count, "
       "round(count(*) / sum(count(*)) OVER (), 6) AS share FROM fx_cat WHERE l_returnflag IS NOT NULL GROUP BY 1")


@register("class_balance", X.with_ctes(_CB, X.SQL_FX_CAT))
def q_class_balance(spark, d):
    return P.class_balance(X.fx_cat(spark, d), "l_returnflag")


@register("flag_class_imbalance", X.with_ctes(
    f"""SELECT 'l_returnflag' AS target, value AS minority_class, round(share * 100, 4) AS minority_pct,
       CASE WHEN share * 100 < 10 THEN 'severe' WHEN share * 100 < 30 THEN 'mild' ELSE 'none' END AS severity
    FROM ({_CB}) ORDER BY count, value LIMIT 1""", X.SQL_FX_CAT))
def q_flag_class_imbalance(spark, d):
    return P.flag_class_imbalance(X.fx_cat(spark, d), "l_returnflag")


@register("flag_issues", _w(
    f"""SELECT 'high_null' AS kind, {COL}, null_pct AS value,
       printf('%.1f %% of %s is missing', null_pct, {COL}) AS message FROM ({_NULLPCT}) WHERE null_pct > 20
    UNION ALL
    SELECT 'high_corr', col_b || '|' || col_a, round(abs(r), 6),
       printf('|r| of %s with %s is %.2f', col_a, col_b, round(abs(r), 6))
    FROM (SELECT * FROM ({_CORR}) WHERE abs(r) > 0.95)
    UNION ALL
    SELECT 'zero_variance', {COL}, 0.0, printf('%s holds one value only', {COL})
    FROM (""" + union_all([f"SELECT '{c}' AS {COL}, stddev_samp({c}) AS s FROM fx_dirty" for c in NUM]) + ") WHERE s = 0"))
def q_flag_issues(spark, d):
    return P.flag_issues(X.fx_dirty(spark, d))


def _hist_sql(src, col, bins, by=None):
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    j = f"USING ({by})" if by else "ON TRUE"
    return f"""SELECT {g}bin, round(lo0 + bin * (hi0 - lo0) / {bins}, 6) AS lo, round(lo0 + (bin + 1) * (hi0 - lo0) / {bins}, 6) AS hi,
       CAST(count(*) AS BIGINT) AS count FROM (
      SELECT {g}t.lo0, t.hi0, CAST(CASE WHEN t.hi0 > t.lo0 THEN LEAST(floor(({col} - t.lo0) / ((t.hi0 - t.lo0) / {bins})), {bins - 1}) ELSE 0 END AS INTEGER) AS bin
      FROM {src} JOIN (SELECT {g}min({col}) AS lo0, max({col}) AS hi0 FROM {src} WHERE {col} IS NOT NULL {'GROUP BY ' + by if by else ''}) t {j}
      WHERE {col} IS NOT NULL) GROUP BY ALL"""


@register("histogram", _w(_hist_sql("fx_dirty", "value", 40)))
def q_histogram(spark, d):
    return P.histogram(X.fx_dirty(spark, d), "value", 40)


@register("histogram_by_group", X.with_ctes(_hist_sql("fx_ab_cont", "outcome", 30, by="arm"), X.SQL_FX_AB_CONT))
def q_histogram_by_group(spark, d):
    return P.histogram(X.fx_ab_cont(spark, d), "outcome", 30, by=["arm"])


@register("target_distribution", X.with_ctes(_hist_sql("fx_cat", "l_extendedprice", 40), X.SQL_FX_CAT))
def q_target_distribution(spark, d):
    return P.target_distribution(X.fx_cat(spark, d), "l_extendedprice", "regression")


@register("target_distribution_cls", X.with_ctes(_CB, X.SQL_FX_CAT))
def q_target_distribution_cls(spark, d):
    return P.target_distribution(X.fx_cat(spark, d), "l_returnflag", "classification")


@register("ts_line", """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, CAST(count(*) AS BIGINT) AS n,
    round(avg(value), 6) AS value_avg, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max,
    round(avg(user_id), 6) AS user_id_avg, round(min(user_id), 6) AS user_id_min, round(max(user_id), 6) AS user_id_max
  FROM events GROUP BY 1""")
def q_ts_line(spark, d):
    return P.ts_line(X.table(spark, d, "events"), "ts", ["value", "user_id"], "1 day")


@register("box_stats", X.with_ctes("""SELECT arm, CAST(count(*) AS BIGINT) AS n, round(min(outcome), 6) AS min,
    round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3, round(max(outcome), 6) AS max,
    round(min(CASE WHEN outcome >= q1 - 1.5 * (q3 - q1) THEN outcome END), 6) AS whisker_lo,
    round(max(CASE WHEN outcome <= q3 + 1.5 * (q3 - q1) THEN outcome END), 6) AS whisker_hi,
    CAST(count_if(outcome < q1 - 1.5 * (q3 - q1) OR outcome > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
  FROM fx_ab_cont JOIN (SELECT arm, quantile_cont(outcome, 0.25) AS q1, quantile_cont(outcome, 0.5) AS med,
                               quantile_cont(outcome, 0.75) AS q3 FROM fx_ab_cont GROUP BY arm) USING (arm)
  WHERE outcome IS NOT NULL GROUP BY arm""", X.SQL_FX_AB_CONT))
def q_box_stats(spark, d):
    return P.box_stats(X.fx_ab_cont(spark, d), "outcome", by=["arm"])

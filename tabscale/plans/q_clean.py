"""Registered cleaning queries (C1-C15) on the dirty events fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from . import fixtures as X
from .registry import register
from .sqlgen import union_all

CTE = X.SQL_FX_DIRTY
ALL_COLS = ["event_id", "ts", "user_id", "event_type", "value", "value_n", "type_n", "sparse_n", "k", "value2"]
NUM = X.DIRTY_NUMERIC


def _w(body, *ctes):
    return X.with_ctes(body, CTE, *ctes)


@register("drop_duplicates", _w("SELECT DISTINCT * FROM fx_dirty"))
def q_drop_duplicates(spark, d):
    return C.drop_duplicates(X.fx_dirty(spark, d))


@register("count_duplicates", _w(
    "SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_distinct, "
    "CAST(sum(c - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS c FROM fx_dirty GROUP BY ALL_COLS)"
    .replace("ALL_COLS", ", ".join(ALL_COLS))))
def q_count_duplicates(spark, d):
    return C.count_duplicates(X.fx_dirty(spark, d))


_NULLS = union_all([
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_null, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct FROM fx_dirty" for c in ALL_COLS])


@register("null_counts", _w(f"SELECT * FROM ({_NULLS}) WHERE n_null > 0"))
def q_null_counts(spark, d):
    return C.null_counts(X.fx_dirty(spark, d))


_STRAT = union_all([
    f"SELECT '{c}' AS \"column\", (count(*) - count({c})) * 1.0 / count(*) AS frac, "
    + (f"skewness({c})" if c in NUM else "CAST(NULL AS DOUBLE)") + f" AS skew, {str(c in NUM).upper()} AS num FROM fx_dirty"
    for c in ALL_COLS])


@register("auto_null_strategy", _w(
    f"""SELECT "column", round(frac * 100, 2) AS null_pct, round(skew, 6) AS skew,
       CASE WHEN frac > 0.5 THEN 'drop_col' WHEN num AND abs(skew) > 1 THEN 'median'
            WHEN num THEN 'mean' ELSE 'mode' END AS strategy
    FROM ({_STRAT}) WHERE frac > 0"""))
def q_auto_null_strategy(spark, d):
    return C.auto_null_strategy(X.fx_dirty(spark, d))


@register("impute_mean", _w(
    "SELECT event_id, round(COALESCE(value_n, (SELECT avg(value_n) FROM fx_dirty)), 6) AS value_n FROM fx_dirty"))
def q_impute_mean(spark, d):
    df = C.impute(X.fx_dirty(spark, d), ["value_n"], "mean")
    return df.select("event_id", F.round("value_n", 6).alias("value_n"))


@register("impute_median", _w(
    "SELECT event_id, round(COALESCE(value_n, (SELECT quantile_cont(value_n, 0.5) FROM fx_dirty)), 6) AS value_n "
    "FROM fx_dirty"))
def q_impute_median(spark, d):
    df = C.impute(X.fx_dirty(spark, d), ["value_n"], "median")
    return df.select("event_id", F.round("value_n", 6).alias("value_n"))


_MODE = ("(SELECT type_n FROM (SELECT type_n, count(*) AS c FROM fx_dirty WHERE type_n IS NOT NULL GROUP BY 1) "
         "ORDER BY c DESC, type_n LIMIT 1)")


@register("impute_mode", _w(f"SELECT event_id, COALESCE(type_n, {_MODE}) AS type_n FROM fx_dirty"))
def q_impute_mode(spark, d):
    return C.impute(X.fx_dirty(spark, d), ["type_n"], "mode").select("event_id", "type_n")


@register("impute_zero", _w("SELECT event_id, COALESCE(CAST(sparse_n AS DOUBLE), 0.0) AS sparse_n FROM fx_dirty"))
def q_impute_zero(spark, d):
    return C.impute(X.fx_dirty(spark, d), ["sparse_n"], "zero").select("event_id", "sparse_n")


@register("drop_null_cols", _w("SELECT * EXCLUDE (sparse_n) FROM fx_dirty"))
def q_drop_null_cols(spark, d):
    return C.drop_null_cols(X.fx_dirty(spark, d), ["sparse_n", "k"])


def _bounds_sql(src, cols):
    return union_all([
        f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src}"
        for c in cols])


_OUT = union_all([
    f"""SELECT '{c}' AS "column", CAST(count_if({c} < b.q1 - 1.5 * (b.q3 - b.q1) OR {c} > b.q3 + 1.5 * (b.q3 - b.q1)) AS BIGINT) AS n_outliers,
       round(count_if({c} < b.q1 - 1.5 * (b.q3 - b.q1) OR {c} > b.q3 + 1.5 * (b.q3 - b.q1)) * 100.0 / count(*), 2) AS pct,
       round(any_value(b.q1 - 1.5 * (b.q3 - b.q1)), 4) AS lower, round(any_value(b.q3 + 1.5 * (b.q3 - b.q1)), 4) AS upper
    FROM fx_dirty, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM fx_dirty) b"""
    for c in NUM])


@register("outlier_summary", _w(f"SELECT * FROM ({_OUT})"))
def q_outlier_summary(spark, d):
    return C.outlier_summary(X.fx_dirty(spark, d))


@register("iqr_bounds", _w(
    "SELECT \"column\", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS lower, "
    f"round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM ({_bounds_sql('fx_dirty', NUM)})"))
def q_iqr_bounds(spark, d):
    b = C.iqr_bounds(X.fx_dirty(spark, d))
    rows = [(c, *[None if v is None else round(v, 6) for v in vals]) for c, vals in b.items()]
    return spark.createDataFrame(rows, "column string, q1 double, q3 double, lower double, upper double")


_CLIP_COLS = ["value", "value_n", "value2"]


def _clip_sql(c):
    return (f"CASE WHEN {c} IS NULL THEN NULL ELSE round(LEAST(GREATEST({c}, "
            f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM fx_dirty)), "
            f"(SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM fx_dirty)), 6) END AS {c}")


@register("outliers_clip", _w("SELECT event_id, " + ", ".join(_clip_sql(c) for c in _CLIP_COLS) + " FROM fx_dirty"))
def q_outliers_clip(spark, d):
    df, _ = C.outliers_clip(X.fx_dirty(spark, d).select("event_id", *_CLIP_COLS), cols=_CLIP_COLS)
    return df.select("event_id", *[F.round(c, 6).alias(c) for c in _CLIP_COLS])


def _drop_chain_sql(cols, src="fx_dirty"):
    ctes, prev = [], src
    for i, c in enumerate(cols):
        b = (f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
             f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {prev})")
        ctes.append(
            f"s{i} AS (SELECT p.* FROM {prev} p, {b} b WHERE "
            f"(SELECT count_if({c} < b.lo OR {c} > b.hi) FROM {prev}) = 0 OR b.lo IS NULL "
            f"OR p.{c} BETWEEN b.lo AND b.hi)")
        prev = f"s{i}"
    return ctes, prev


_DROP_CTES, _DROP_LAST = _drop_chain_sql(NUM)


@register("outliers_drop", X.with_ctes(f"SELECT * FROM {_DROP_LAST}", CTE, *_DROP_CTES))
def q_outliers_drop(spark, d):
    df, _ = C.outliers_drop(X.fx_dirty(spark, d))
    return df


@register("null_map", _w(
    "SELECT bucket, \"column\", round(avg(z), 6) AS null_rate, CAST(count(*) AS BIGINT) AS n FROM ("
    + union_all([
        f"SELECT CAST(LEAST(floor((event_id - (SELECT min(event_id) FROM fx_dirty)) / "
        f"(((SELECT max(event_id) FROM fx_dirty) - (SELECT min(event_id) FROM fx_dirty) + 1) / 20.0)), 19) AS BIGINT) AS bucket, "
        f"'{c}' AS \"column\", CAST({c} IS NULL AS INTEGER) AS z FROM fx_dirty" for c in ALL_COLS if c != "event_id"])
    + ") GROUP BY 1, 2"))
def q_null_map(spark, d):
    return C.null_map(X.fx_dirty(spark, d), "event_id", buckets=20)


# full chain: dedupe -> auto strategies (sparse_n dropped, value_n median, type_n mode) -> clip all numeric
_CLEAN_NUM = ["event_id", "user_id", "value", "value_n", "k", "value2"]
_CLEAN_CTES = [
    "dd AS (SELECT DISTINCT * FROM fx_dirty)",
    "filled AS (SELECT event_id, ts, user_id, event_type, value, "
    "COALESCE(value_n, (SELECT quantile_cont(value_n, 0.5) FROM dd)) AS value_n, "
    "COALESCE(type_n, (SELECT type_n FROM (SELECT type_n, count(*) AS c FROM dd WHERE type_n IS NOT NULL GROUP BY 1) "
    "ORDER BY c DESC, type_n LIMIT 1)) AS type_n, k, value2 FROM dd)",
]


def _clip_from(c, src):
    lo = f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {src})"
    hi = f"(SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {src})"
    return f"round(CASE WHEN {c} IS NULL THEN NULL ELSE LEAST(GREATEST(CAST({c} AS DOUBLE), {lo}), {hi}) END, 6) AS {c}"


@register("clean", X.with_ctes(
    "SELECT ts, event_type, type_n, " + ", ".join(_clip_from(c, "filled") for c in _CLEAN_NUM) + " FROM filled",
    CTE, *_CLEAN_CTES))
def q_clean(spark, d):
    df, _ = C.clean(X.fx_dirty(spark, d))
    return df.select("ts", "event_type", "type_n",
                     *[F.round(F.col(c).cast("double"), 6).alias(c) for c in _CLEAN_NUM])


_KNN_FEATS = ["user_id", "value", "value_n", "sparse_n", "k", "value2", "event_id"]


def _knn_sql():
    p = len(_KNN_FEATS)
    both = [f"(r.{c} IS NOT NULL AND d.{c} IS NOT NULL)" for c in _KNN_FEATS]
    m = " + ".join(f"CAST({b} AS INTEGER)" for b in both)
    s2 = " + ".join(f"CASE WHEN {b} THEN (r.{c} - d.{c}) * (r.{c} - d.{c}) ELSE 0 END" for b, c in zip(both, _KNN_FEATS))
    return f"""dd AS (SELECT DISTINCT * FROM fx_dirty),
rec AS (SELECT * FROM dd WHERE value_n IS NULL),
don AS (SELECT * FROM dd WHERE value_n IS NOT NULL),
pairs AS (SELECT r.event_id AS rid, d.event_id AS did, d.value_n AS v,
                 sqrt({p}.0 / ({m}) * ({s2})) AS dist FROM rec r, don d),
ranked AS (SELECT rid, v, row_number() OVER (PARTITION BY rid ORDER BY dist, did) AS rn FROM pairs),
fill AS (SELECT rid, avg(v) AS v FROM ranked WHERE rn <= 5 GROUP BY rid)"""


@register("impute_knn", X.with_ctes(
    "SELECT dd.event_id, round(COALESCE(dd.value_n, fill.v), 6) AS value_n FROM dd LEFT JOIN fill ON dd.event_id = fill.rid",
    CTE, _knn_sql()))
def q_impute_knn(spark, d):
    from ..operators.knn import knn_impute
    dd = C.drop_duplicates(X.fx_dirty(spark, d))
    out = knn_impute(dd, ["value_n"], id_col="event_id", k=5)
    return out.select("event_id", F.round("value_n", 6).alias("value_n"))

"""Registered feature-engineering queries (F1-F11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from . import fixtures as X
from .registry import register
from .sqlgen import union_all

COL = '"column"'
IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ID_SQL = ", ".join(IDS)


def _r(cols, digits=6):
    return [F.round(F.col(c).cast("double"), digits).alias(c) for c in cols]


@register("date_parts", """SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month,
    CAST(day(ts) AS INTEGER) AS ts_day, CAST(isodow(ts) - 1 AS INTEGER) AS ts_dayofweek, CAST(hour(ts) AS INTEGER) AS ts_hour
  FROM events""")
def q_date_parts(spark, d):
    return FE.date_parts(X.table(spark, d, "events").select("event_id", "ts"))


_TS3 = ["value_sum", "value_avg", "value_max"]
_LAGS = [1, 7, 30]


@register("lag_features", X.with_ctes(
    "SELECT * FROM (SELECT hour, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _TS3) + ", "
    + ", ".join(f"round(lag({c}, {k}) OVER (ORDER BY hour), 6) AS {c}_lag{k}" for c in _TS3 for k in _LAGS)
    + " FROM fx_ts_regular) WHERE " + " AND ".join(f"{c}_lag{k} IS NOT NULL" for c in _TS3 for k in _LAGS), X.SQL_FX_TS_REGULAR))
def q_lag_features(spark, d):
    out = FE.lag_features(X.fx_ts_regular(spark, d), ["hour"], _LAGS, cols=_TS3)
    return out.select("hour", "n", *_r(_TS3 + [f"{c}_lag{k}" for c in _TS3 for k in _LAGS]))


_WINS = [7, 30]


def _roll_sql(c, w):
    fr = f"OVER (ORDER BY hour ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return (f"round(CASE WHEN count({c}) {fr} = {w} THEN avg({c}) {fr} END, 6) AS {c}_roll_mean_{w}, "
            f"round(CASE WHEN count({c}) {fr} = {w} THEN stddev_samp({c}) {fr} END, 6) AS {c}_roll_std_{w}")


_ROLL_COLS = [f"{c}_roll_{s}_{w}" for c in _TS3 for w in _WINS for s in ("mean", "std")]


@register("rolling_features", X.with_ctes(
    "SELECT * FROM (SELECT hour, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _TS3) + ", "
    + ", ".join(_roll_sql(c, w) for c in _TS3 for w in _WINS) + " FROM fx_ts_regular) WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _ROLL_COLS), X.SQL_FX_TS_REGULAR))
def q_rolling_features(spark, d):
    out = FE.rolling_features(X.fx_ts_regular(spark, d), ["hour"], _WINS, cols=_TS3)
    return out.select("hour", "n", *_r(_TS3 + _ROLL_COLS))


_CATC = ["l_linestatus", "l_returnflag", "p_type", "p_brand"]


@register("auto_encoding", X.with_ctes(union_all([
    f"SELECT '{c}' AS {COL}, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, CASE WHEN count(DISTINCT {c}) <= 2 THEN 'label' "
    f"WHEN count(DISTINCT {c}) <= 20 THEN 'onehot' ELSE 'target' END AS encoding FROM fx_cat" for c in _CATC]),
    X.SQL_FX_CAT))
def q_auto_encoding(spark, d):
    df = X.fx_cat(spark, d)
    from ..operators.detect import distinct_counts
    enc = FE.auto_encoding(df, _CATC, "regression")
    dc = distinct_counts(df, _CATC)
    return spark.createDataFrame([(c, int(dc[c]), enc[c]) for c in _CATC], "column string, n_unique long, encoding string")


_TE_CTE = "te AS (SELECT p_brand AS cat, avg(l_extendedprice) AS te FROM fx_cat WHERE p_brand IS NOT NULL GROUP BY 1)"


@register("target_encode", X.with_ctes(
    f"SELECT {ID_SQL}, round(te.te, 6) AS p_brand FROM fx_cat LEFT JOIN te ON p_brand = te.cat", X.SQL_FX_CAT, _TE_CTE))
def q_target_encode(spark, d):
    df = X.fx_cat(spark, d).select(*IDS, "p_brand", "l_extendedprice")
    return FE.target_encode(df, "p_brand", "l_extendedprice").select(*IDS, F.round("p_brand", 6).alias("p_brand"))


# categories of this fixture (sorted; the first of each is the dropped reference level)
_RF = ["N", "R"]
_PT = ["LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_OH_SQL = ", ".join([f"(l_returnflag IS NOT DISTINCT FROM '{v}') AS l_returnflag_{v}" for v in _RF]
                    + [f"(p_type IS NOT DISTINCT FROM '{v}') AS p_type_{v}" for v in _PT])


@register("one_hot", X.with_ctes(f"SELECT {ID_SQL}, {_OH_SQL} FROM fx_cat", X.SQL_FX_CAT))
def q_one_hot(spark, d):
    return FE.one_hot(X.fx_cat(spark, d).select(*IDS, "l_returnflag", "p_type"), ["l_returnflag", "p_type"])


_LABEL_SQL = "CAST(dense_rank() OVER (ORDER BY COALESCE(CAST(l_linestatus AS VARCHAR), 'nan')) - 1 AS BIGINT)"


@register("label_encode", X.with_ctes(f"SELECT {ID_SQL}, {_LABEL_SQL} AS l_linestatus FROM fx_cat", X.SQL_FX_CAT))
def q_label_encode(spark, d):
    return FE.label_encode(X.fx_cat(spark, d).select(*IDS, "l_linestatus"), "l_linestatus")


@register("drop_encoded", X.with_ctes("SELECT * EXCLUDE (p_brand) FROM fx_cat", X.SQL_FX_CAT))
def q_drop_encoded(spark, d):
    return FE.drop_encoded(X.fx_cat(spark, d), ["p_brand"])


@register("drop_zero_variance", X.with_ctes(
    "SELECT * EXCLUDE (k) FROM fx_dirty WHERE (SELECT min(k) = max(k) FROM fx_dirty)", X.SQL_FX_DIRTY))
def q_drop_zero_variance(spark, d):
    return FE.drop_zero_variance(X.fx_dirty(spark, d))


def _corr_pairs_sql(cols, src):
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = cols[i], cols[j]
            xa = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
            xb = f"CASE WHEN {a} IS NOT NULL THEN {b} END"
            parts.append(f"SELECT '{b}' AS col_b, {j} AS j, CASE WHEN max({xa}) > min({xa}) AND max({xb}) > min({xb}) "
                         f"THEN corr({xa}, {xb}) END AS r FROM {src}")
    return union_all(parts)


@register("drop_correlated", X.with_ctes(
    f"SELECT DISTINCT col_b AS {COL} FROM ({_corr_pairs_sql(X.DIRTY_NUMERIC, 'fx_dirty')}) WHERE abs(r) > 0.95",
    X.SQL_FX_DIRTY))
def q_drop_correlated(spark, d):
    cols = FE.correlated_columns(X.fx_dirty(spark, d))
    return spark.createDataFrame([(c,) for c in cols], "column string")


@register("drop_correlated_table", X.with_ctes(
    union_all([f"SELECT event_id AS id, '{c}' AS {COL}, round(CAST({c} AS DOUBLE), 6) AS v FROM fx_dirty "
               f"WHERE '{c}' NOT IN (SELECT col_b FROM gone)" for c in X.DIRTY_NUMERIC]), X.SQL_FX_DIRTY,
    f"gone AS (SELECT DISTINCT col_b FROM ({_corr_pairs_sql(X.DIRTY_NUMERIC, 'fx_dirty')}) WHERE abs(r) > 0.95)"))
def q_drop_correlated_table(spark, d):
    """The pruned table, a row for every cell of the columns that stay."""
    out = FE.drop_correlated(X.fx_dirty(spark, d).withColumn("id", F.col("event_id")), X.DIRTY_NUMERIC)
    cells = [F.struct(F.lit(c).alias("column"), F.round(F.col(c).cast("double"), 6).alias("v")) for c in X.DIRTY_NUMERIC if c in out.columns]
    return out.select("id", F.inline(F.array(*cells)))


_SC = ["value", "value_n", "value2", "k"]


def _scale_sql(kind):
    out = []
    for c in _SC:
        if kind == "standard":
            e = (f"({c} - (SELECT avg({c}) FROM fx_dirty)) / (SELECT CASE WHEN min({c}) = max({c}) THEN 1 "
                 f"ELSE stddev_pop({c}) END FROM fx_dirty)")
        elif kind == "minmax":
            e = (f"({c} - (SELECT min({c}) FROM fx_dirty)) / (SELECT CASE WHEN min({c}) = max({c}) THEN 1 "
                 f"ELSE max({c}) - min({c}) END FROM fx_dirty)")
        else:
            e = (f"({c} - (SELECT quantile_cont({c}, 0.5) FROM fx_dirty)) / (SELECT CASE WHEN quantile_cont({c}, 0.75) "
                 f"= quantile_cont({c}, 0.25) THEN 1 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END FROM fx_dirty)")
        out.append(f"round({e}, 6) AS {c}")
    return X.with_ctes("SELECT event_id, " + ", ".join(out) + " FROM fx_dirty", X.SQL_FX_DIRTY)


def _scale_q(kind):
    def run(spark, d):
        df = X.fx_dirty(spark, d).select("event_id", *_SC)
        return FE.scale(df, _SC, kind).select("event_id", *_r(_SC))
    return run


register("scale_standard", _scale_sql("standard"))(_scale_q("standard"))
register("scale_minmax", _scale_sql("minmax"))(_scale_q("minmax"))
register("scale_robust", _scale_sql("robust"))(_scale_q("robust"))


_F11_NUM = ["l_quantity", "l_discount", "p_size", "p_retailprice", "l_linestatus", "p_brand"]


def _std(c):
    return (f"round(({c} - avg({c}) OVER ()) / CASE WHEN min({c}) OVER () = max({c}) OVER () THEN 1 "
            f"ELSE stddev_pop({c}) OVER () END, 6) AS {c}")


@register("engineer_features", X.with_ctes(
    f"SELECT {ID_SQL}, " + ", ".join(_std(c) for c in _F11_NUM) + ", l_extendedprice, "
    + ", ".join([f"l_returnflag_{v}" for v in _RF] + [f"p_type_{v}" for v in _PT]) + " FROM enc",
    X.SQL_FX_CAT, _TE_CTE,
    f"""enc AS (SELECT {ID_SQL}, l_quantity, l_discount, p_size, p_retailprice, {_LABEL_SQL} AS l_linestatus,
        te.te AS p_brand, l_extendedprice, {_OH_SQL} FROM fx_cat LEFT JOIN te ON p_brand = te.cat)"""))
def q_engineer_features(spark, d):
    df = X.fx_cat(spark, d)
    model = FE.engineer_features(df, "l_extendedprice", "regression", keep_cols=IDS)
    out = model.transform(df)
    dbl = [c for c in _F11_NUM if c in out.columns]
    return out.select(*IDS, *_r(dbl), "l_extendedprice", *[c for c in out.columns if c.startswith(("l_returnflag_", "p_type_"))])


def _chain_roundtrip(df, target, keys, **how):
    """Fit, save, load, and score rows that lack the target: every value as before saving."""
    from ..session import scratch_path
    from ..sources.sinks import load_model, save_model
    model = FE.FeatureChain(target, "regression", keep_cols=keys, **how).fit(df)
    from pyspark.ml import PipelineModel
    path = save_model(PipelineModel([model]), scratch_path(df.sparkSession, "chain"))
    again = load_model(path)
    a, b = model.transform(df).drop(target), again.transform(df.drop(target))
    # every row of one must be a row of the other, as often
    both = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
    left = both.groupBy(*a.columns).agg(F.sum("_s").alias("_s"))
    return left.groupBy(*keys).agg((F.max(F.abs("_s")) == 0).alias("equal"))


@register("feature_chain_roundtrip", X.with_ctes(f"SELECT DISTINCT {ID_SQL}, true AS equal FROM fx_cat", X.SQL_FX_CAT))
def q_feature_chain_roundtrip(spark, d):
    return _chain_roundtrip(X.fx_cat(spark, d), "l_extendedprice", IDS)


@register("feature_chain_roundtrip_ts", X.with_ctes(
    """SELECT hour, true AS equal FROM (SELECT hour, row_number() OVER (ORDER BY hour) AS i FROM fx_ts_regular) WHERE i > 9""", X.SQL_FX_TS_REGULAR))
def q_feature_chain_roundtrip_ts(spark, d):
    # a lag of 3 and windows of 7 rows: the first 3 and then 6 rows have no features
    df = X.fx_ts_regular(spark, d).select("hour", "value_sum", "value_max", "n")
    return _chain_roundtrip(df, "value_sum", ["hour"], is_ts=True, order_by=["hour"], lags=[1, 3], windows=[7])

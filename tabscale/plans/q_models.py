"""Registered model / metric queries (M1-M20)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import models as ML
from . import fixtures as X
from .registry import register

IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ID_SQL = ", ".join(IDS)


def _q(j):
    return f"(floor((st + n - 1 - {j}) / 5.0) - floor((st - 1 - {j}) / 5.0))"


def _cum(i):
    return " + ".join(_q(j) for j in range(i + 1))


@register("kfold_assign", X.with_ctes(
    f"SELECT {ID_SQL}, CAST(" + " + ".join(f"CASE WHEN ci >= {_cum(i)} THEN 1 ELSE 0 END" for i in range(4))
    + " AS INTEGER) AS fold FROM ci JOIN s USING (l_returnflag)", X.SQL_FX_CAT,
    f"r AS (SELECT *, row_number() OVER (ORDER BY {ID_SQL}) - 1 AS i FROM fx_cat)",
    "c AS (SELECT l_returnflag, min(i) AS f, count(*) AS n FROM r GROUP BY 1)",
    "s AS (SELECT l_returnflag, n, sum(n) OVER (ORDER BY f) - n AS st FROM c)",
    "ci AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY i) - 1 AS ci FROM r)"))
def q_kfold_assign(spark, d):
    df = X.fx_cat(spark, d).select(*IDS, "l_returnflag")
    return ML.kfold_assign(df, IDS, label="l_returnflag").select(*IDS, "fold")


@register("kfold_assign_reg", X.with_ctes(
    """SELECT hour, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
         ELSE (n % 5) + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold
    FROM (SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS i, count(*) OVER () AS n FROM fx_ts_regular)""",
    X.SQL_FX_TS_REGULAR))
def q_kfold_assign_reg(spark, d):
    return ML.kfold_assign(X.fx_ts_regular(spark, d).select("hour"), ["hour"]).select("hour", "fold")


@register("ts_split", X.with_ctes(
    """SELECT hour, idx, CAST(CASE WHEN idx >= n - 5 * (n // 6) THEN (idx - (n - 5 * (n // 6))) // (n // 6) END AS INTEGER) AS test_split
    FROM (SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS idx, count(*) OVER () AS n FROM fx_ts_regular)""",
    X.SQL_FX_TS_REGULAR))
def q_ts_split(spark, d):
    out, _, _ = ML.ts_split(X.fx_ts_regular(spark, d).select("hour"), ["hour"])
    return out.select("hour", "idx", "test_split")


@register("train_test_split", X.with_ctes(
    """SELECT hour, i < CAST(floor(n * 0.8) AS BIGINT) AS is_train
    FROM (SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS i, count(*) OVER () AS n FROM fx_ts_regular)""",
    X.SQL_FX_TS_REGULAR))
def q_train_test_split(spark, d):
    return ML.train_test_split(X.fx_ts_regular(spark, d).select("hour"), ["hour"], positional=True)


@register("train_test_split_stratified", X.with_ctes(
    """SELECT l_returnflag, is_train, CASE WHEN is_train THEN n - t ELSE t END AS count
    FROM (SELECT l_returnflag, count(*) AS n, CAST(ceil(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS t FROM fx_cat GROUP BY 1),
         (SELECT unnest([true, false]) AS is_train)""", X.SQL_FX_CAT))
def q_train_test_split_stratified(spark, d):
    df = X.fx_cat(spark, d).select(*IDS, "l_returnflag")
    out = ML.train_test_split(df, IDS, label="l_returnflag", id_col="l_orderkey")
    return out.groupBy("l_returnflag", "is_train").count()


@register("best_so_far", X.with_ctes(
    """SELECT day, round(revenue, 6) AS revenue,
       round(max(revenue) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS best_so_far
    FROM fx_orders_daily""", X.SQL_FX_ORDERS_DAILY))
def q_best_so_far(spark, d):
    out = M.best_so_far(X.fx_orders_daily(spark, d).select("day", "revenue"), "day", "revenue")
    return out.select("day", F.round("revenue", 6).alias("revenue"), F.round("best_so_far", 6).alias("best_so_far"))


_CM = """cm AS (SELECT a.c AS actual, p.c AS predicted, CAST(COALESCE(x.cnt, 0) AS BIGINT) AS count
    FROM (SELECT DISTINCT c FROM (SELECT label AS c FROM fx_multiclass UNION SELECT prediction FROM fx_multiclass)) a
    CROSS JOIN (SELECT DISTINCT c FROM (SELECT label AS c FROM fx_multiclass UNION SELECT prediction FROM fx_multiclass)) p
    LEFT JOIN (SELECT label AS actual, prediction AS predicted, count(*) AS cnt FROM fx_multiclass GROUP BY 1, 2) x
      ON x.actual = a.c AND x.predicted = p.c)"""


@register("confusion_matrix", X.with_ctes("SELECT * FROM cm", X.SQL_FX_MULTICLASS, _CM))
def q_confusion_matrix(spark, d):
    return M.confusion_matrix(X.fx_multiclass(spark, d), "label", "prediction", zero_cells=True)


@register("classification_report", X.with_ctes(
    """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
      SELECT class, precision, recall, f1, support FROM per
      UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM per
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                       sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per)""",
    X.SQL_FX_MULTICLASS, _CM,
    """b AS (SELECT a.actual AS class, a.tp, a.support, p.npred,
        COALESCE(a.tp / NULLIF(p.npred, 0), 0.0) AS precision, COALESCE(a.tp / NULLIF(a.support, 0), 0.0) AS recall
      FROM (SELECT actual, sum(CASE WHEN actual = predicted THEN count END) AS tp, sum(count) AS support FROM cm GROUP BY 1) a
      JOIN (SELECT predicted, sum(count) AS npred FROM cm GROUP BY 1) p ON a.actual = p.predicted)""",
    """per AS (SELECT class, tp, CAST(support AS BIGINT) AS support, precision, recall,
        CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM b)"""))
def q_classification_report(spark, d):
    return M.classification_report(X.fx_multiclass(spark, d), "label", "prediction")


@register("roc_curve", X.with_ctes(
    """SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
    UNION ALL
    SELECT score, round(sum(fp) OVER (ORDER BY score DESC) / (SELECT count(*) FILTER (WHERE label <> 1) FROM fx_scored), 6),
           round(sum(tp) OVER (ORDER BY score DESC) / (SELECT count(*) FILTER (WHERE label = 1) FROM fx_scored), 6)
    FROM (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS fp
          FROM fx_scored WHERE score IS NOT NULL GROUP BY score)""", X.SQL_FX_SCORED))
def q_roc_curve(spark, d):
    return M.roc_curve(X.fx_scored(spark, d), "label", "score")


@register("roc_auc", X.with_ctes(
    """SELECT round((sum(mr) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
       / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label <> 1)), 6) AS roc_auc
    FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mr
          FROM fx_scored WHERE score IS NOT NULL)""", X.SQL_FX_SCORED))
def q_roc_auc(spark, d):
    return M.roc_auc(X.fx_scored(spark, d), "label", "score")


@register("regression_metrics", X.with_ctes(
    """SELECT round(sqrt(avg((actual - predicted) * (actual - predicted))), 4) AS rmse,
       round(avg(abs(actual - predicted)), 4) AS mae,
       round(1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)), 4) AS r2
    FROM fx_scored_reg""", X.SQL_FX_SCORED_REG))
def q_regression_metrics(spark, d):
    return M.regression_metrics(X.fx_scored_reg(spark, d), "actual", "predicted")


@register("residuals", X.with_ctes(
    f"SELECT {ID_SQL}, round(predicted, 6) AS predicted, round(actual, 6) AS actual, "
    "round(actual - predicted, 6) AS residual FROM fx_scored_reg", X.SQL_FX_SCORED_REG))
def q_residuals(spark, d):
    return M.residuals(X.fx_scored_reg(spark, d), "actual", "predicted", keep=IDS)


@register("primary_metric", X.with_ctes(
    """SELECT 'l_linestatus' AS target, CASE WHEN count(DISTINCT l_linestatus) = 2 THEN 'AUC-ROC' ELSE 'F1 (macro)' END AS metric FROM fx_cat
    UNION ALL SELECT 'l_returnflag', CASE WHEN count(DISTINCT l_returnflag) = 2 THEN 'AUC-ROC' ELSE 'F1 (macro)' END FROM fx_cat
    UNION ALL SELECT 'l_extendedprice', CASE WHEN count(DISTINCT l_extendedprice) <= 20 THEN 'F1 (macro)' ELSE 'RMSE' END FROM fx_cat""",
    X.SQL_FX_CAT))
def q_primary_metric(spark, d):
    from ..operators.detect import distinct_counts, infer_task_type
    df = X.fx_cat(spark, d)
    dc = distinct_counts(df, ["l_linestatus", "l_returnflag", "l_extendedprice"])
    rows = [(t, ML.primary_metric(infer_task_type(df, t), dc[t])) for t in ["l_linestatus", "l_returnflag", "l_extendedprice"]]
    return spark.createDataFrame(rows, "target string, metric string")


# ------------------------------------------------------------------ model fits (rows checks)

def fx_model_cls(spark, d):
    lb = X.table(spark, d, "labels")
    dc = X.table(spark, d, "documents")
    return lb.join(dc, "doc_id").select("doc_id", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("n_chars"),
                                        F.col("toxic").cast("double").alias("toxic"),
                                        F.size(F.split("text", r"\s+")).cast("double").alias("n_words"))


CLS_X = ["n_chars", "toxic", "n_words"]


def fx_model_reg(spark, d):
    t = X.fx_ts_regular(spark, d)
    return t.select("hour", "value_sum", F.col("n").cast("double").alias("n"), "value_max",
                    F.hour("hour").cast("double").alias("hod"), F.weekday("hour").cast("double").alias("dow"))


REG_X = ["n", "value_max", "hod", "dow"]


def _fit(spark, d, name, task):
    if task == "classification":
        df, feats, y, key = fx_model_cls(spark, d), CLS_X, "label", "doc_id"
        est = ML.classification_models(df.count(), 2)[name]
    else:
        df, feats, y, key = fx_model_reg(spark, d), REG_X, "value_sum", "hour"
        est = ML.regression_models(df.count())[name]
    model = ML.fit_cached(ML.build_pipeline(est, feats, y, task), df)
    out = model.transform(df)
    return out.select(key, F.col(y).alias("label"), F.col("prediction").cast("double").alias("prediction"))


register("fit_logistic")(lambda spark, d: _fit(spark, d, "LogisticRegression", "classification"))
register("fit_ridge")(lambda spark, d: _fit(spark, d, "Ridge", "regression"))
register("fit_random_forest")(lambda spark, d: _fit(spark, d, "RandomForest", "classification"))
register("fit_gbt")(lambda spark, d: _fit(spark, d, "GradientBoosting", "regression"))
register("fit_svm")(lambda spark, d: _fit(spark, d, "SVM", "classification"))
register("fit_svr")(lambda spark, d: _fit(spark, d, "SVR", "regression"))


_RIDGE_SQL = "SELECT unnest(['intercept', 'n', 'value_max', 'hod', 'dow']) AS term, true AS holds"


@register("fit_ridge_equations", _RIDGE_SQL)
def q_fit_ridge_equations(spark, d):
    """The normal equations at the fitted ridge model: residuals . x = alpha w for every term (alpha = 1)."""
    df = fx_model_reg(spark, d)
    model = ML.fit_cached(ML.build_pipeline(ML.regression_models(df.count())["Ridge"], REG_X, "value_sum", "regression"), df)
    out = model.transform(df).withColumn("_r", F.col("value_sum") - F.col("prediction"))
    sums = out.agg(F.sum("_r").alias("intercept"), *[F.sum(F.col("_r") * F.col(c)).alias(c) for c in REG_X],
                   *[F.sum(F.abs(F.col("value_sum") * F.col(c))).alias(f"_{c}") for c in REG_X], F.sum(F.abs("value_sum")).alias("_intercept"))
    w = dict(zip(REG_X, model.stages[-1].coefficients.toArray().tolist()))
    cells = [F.struct(F.lit(c).alias("term"), (F.abs(F.col(c) - F.lit(w.get(c, 0.0))) <= 1e-6 * F.col(f"_{c}")).alias("holds"))
             for c in ["intercept", *REG_X]]
    return sums.select(F.inline(F.array(*cells)))


@register("gbt_training_loss", "SELECT 100 AS rounds, 0 AS rises, true AS halved")
def q_gbt_training_loss(spark, d):
    """The loss before each boosting round and after the last: it never rises."""
    df = fx_model_reg(spark, d)
    model = ML.fit_cached(ML.build_pipeline(ML.regression_models(df.count())["GradientBoosting"], REG_X, "value_sum", "regression"), df)
    loss = model.stages[-1].losses
    rises = sum(b > a for a, b in zip(loss, loss[1:]))
    return spark.createDataFrame([(len(loss) - 1, rises, loss[-1] < loss[0] / 2)], "rounds int, rises int, halved boolean")


@register("kernel_objective", "SELECT unnest(['SVM', 'SVR']) AS model, 0 AS rises, true AS fell")
def q_kernel_objective(spark, d):
    """The objective by Newton step of both kernel machines: it never rises."""
    rows = []
    for name, df, feats, y, task in (("SVM", fx_model_cls(spark, d), CLS_X, "label", "classification"),
                                     ("SVR", fx_model_reg(spark, d), REG_X, "value_sum", "regression")):
        est = (ML.classification_models(1, 2) if task == "classification" else ML.regression_models(1))[name]
        trace = ML.fit_cached(ML.build_pipeline(est, feats, y, task), df).stages[-1].objectives[0]
        rows.append((name, int(sum(b > a for a, b in zip(trace, trace[1:]))), bool(trace[-1] < trace[0])))
    return spark.createDataFrame(rows, "model string, rises int, fell boolean")


@register("hyperparam_search_summary", "SELECT 16 AS trials, 16 AS scored, true AS best_is_least, true AS not_worse, true AS in_range")
def q_hyperparam_search_summary(spark, d):
    trials, best, base, score, _ = ML.hyperparam_search(fx_model_reg(spark, d), REG_X, "value_sum", "regression", "Ridge", ["hour"],
                                                        n_trials=16)
    alpha = F.get_json_object("params", "$.alpha").cast("double")
    return trials.agg(F.count(F.lit(1)).cast("int").alias("trials"), F.count("score").cast("int").alias("scored"),
                      (F.min("score") == score).alias("best_is_least"), (F.min("score") <= base * 1.001).alias("not_worse"),
                      F.bool_and(alpha.between(1e-4, 100)).alias("in_range"))


@register("benchmark_models")
def q_benchmark_models(spark, d):
    lb, _, _ = ML.benchmark_models(fx_model_cls(spark, d), CLS_X, "label", "classification", ["doc_id"])
    return lb


@register("benchmark_models_ts")
def q_benchmark_models_ts(spark, d):
    lb, _, _ = ML.benchmark_models(fx_model_reg(spark, d), REG_X, "value_sum", "regression", ["hour"], is_ts=True)
    return lb


@register("hyperparam_search")
def q_hyperparam_search(spark, d):
    trials, _, _, _, _ = ML.hyperparam_search(fx_model_reg(spark, d), REG_X, "value_sum", "regression", "Ridge", ["hour"])
    return M.best_so_far(trials, "trial", "score", higher_is_better=False)


@register("feature_importance")
def q_feature_importance(spark, d):
    df = fx_model_reg(spark, d)
    est = ML.regression_models(df.count())["RandomForest"]
    model = ML.build_pipeline(est, REG_X, "value_sum", "regression").fit(df)
    return ML.feature_importance(model, REG_X)


@register("evaluate_model")
def q_evaluate_model(spark, d):
    out = ML.evaluate_model(fx_model_cls(spark, d), CLS_X, "label", "classification", ["doc_id"], "LogisticRegression",
                            id_col="doc_id")
    return out["classification_report"]


@register("evaluate_model_reg")
def q_evaluate_model_reg(spark, d):
    out = ML.evaluate_model(fx_model_reg(spark, d), REG_X, "value_sum", "regression", ["hour"], "RandomForest", is_ts=True)
    return out["metrics"]

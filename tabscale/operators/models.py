"""Model benchmark, tuning and evaluation on Spark ML.

Folds and splits are columns computed from a distributed row index (never
by collecting rows); each model x fold fit is an ordinary Spark ML job on a
cached frame, and independent fits run concurrently from a thread pool so
the cluster stays busy. Scores are computed with the metric aggregates of
``metrics`` (macro-F1 included, which Spark's evaluators lack).
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import join_null_safe, maybe_broadcast, q
from . import metrics as M
from .boosting import LeafBoosting, dealt
from .forest import Forest
from .kernel import KernelMachine
from .order import prefix_sum, row_index
from .tpe import Param, Search

CV_FOLDS = 5
N_TRIALS = 50
SEED = 42
GBT_ROUNDS = 100      # boosting rounds
GBT_DEPTH = 6
FOREST_TREES = 100
FOREST_DEPTH = 0      # no limit


# ------------------------------------------------------------------ folds and splits

def kfold_assign(df: DataFrame, order_by, label: str | None = None, k: int = CV_FOLDS, name: str = "fold") -> DataFrame:
    """Unshuffled k folds in row order.

    Regression: contiguous folds, the first n % k one row larger. Classification
    (``label``): stratified — classes numbered by first appearance, the quota of
    class c in fold i is the count of c among every k-th entry (offset i) of the
    class-sorted label list, and each class's rows are dealt to folds in row order.
    """
    order_by = list(order_by)
    if label is None:
        x = row_index(df, order_by, name="_i")
        n = x.count()
        qn, r = divmod(n, k)
        big = r * (qn + 1)
        fold = F.when(F.col("_i") < big, F.floor(F.col("_i") / (qn + 1))).otherwise(
            F.lit(r) + F.floor((F.col("_i") - big) / max(qn, 1)))
        return x.withColumn(name, fold.cast("int")).drop("_i")
    x = row_index(df, order_by, name="_i")
    x = row_index(x, ["_i"], by=[label], name="_ci")
    classes = x.groupBy(label).agg(F.min("_i").alias("_f"), F.count(F.lit(1)).alias("_n"))
    end = F.col("_end").cast("long")
    classes = prefix_sum(classes, ["_f"], "_n", name="_end").withColumn("_st", end - F.col("_n"))
    # entries of the class at positions = i (mod k) of the class-sorted list, summed up to fold i
    quota = [F.floor((end - 1 - i) / k) - F.floor((F.col("_st") - 1 - i) / k) for i in range(k)]
    upto, total = [], F.lit(0)
    for c in quota:
        total = total + c
        upto.append(total)
    classes = classes.select(label, F.array(*upto).alias("_upto")).checkpoint()
    x = join_null_safe(x, maybe_broadcast(classes), [label])
    fold = F.size(F.filter("_upto", lambda b: b <= F.col("_ci")))
    return x.withColumn(name, fold.cast("int")).drop("_i", "_ci", "_upto")


def ts_split(df: DataFrame, order_by, n_splits: int = CV_FOLDS, name: str = "test_split") -> DataFrame:
    """Expanding-window splits: test blocks of n // (n_splits + 1) rows at the end; ``test_split``
    is the split whose test block holds the row (null = train only); ``idx`` is the position."""
    x = row_index(df, list(order_by), name="idx")
    n = x.count()
    size = n // (n_splits + 1)
    start = n - n_splits * size
    split = F.when((F.col("idx") >= start) & (size > 0), F.floor((F.col("idx") - start) / max(size, 1)))
    return x.withColumn(name, split.cast("int")), start, size


def train_test_split(df: DataFrame, order_by, test_size: float = 0.2, label: str | None = None,
                     positional: bool = False, seed: int = SEED, id_col: str | None = None) -> DataFrame:
    """Adds boolean ``is_train``. Positional (time series): the first int((1-test) n) rows train.
    Otherwise a seeded hash order (per class when ``label`` is given, i.e. stratified) and the
    first ceil(test_size n_class) rows of it go to test."""
    if positional:
        x = row_index(df, list(order_by), name="_i")
        n = x.count()
        return x.withColumn("is_train", F.col("_i") < int(n * (1 - test_size))).drop("_i")
    key = id_col or list(order_by)[0]
    h = F.xxhash64(q(key), F.lit(seed))
    x = df.withColumn("_h", h)
    by = [label] if label else []
    x = row_index(x, ["_h", key], by=by, name="_i")
    sizes = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    x = join_null_safe(x, maybe_broadcast(sizes.checkpoint()), by) if by else x.withColumn("_n", F.lit(sizes.collect()[0]["_n"]))
    return x.withColumn("is_train", F.col("_i") >= F.ceil(F.col("_n") * test_size)).drop("_i", "_h", "_n")


# ------------------------------------------------------------------ estimators

class Ridge(LinearRegression):
    """Linear regression whose ``regParam`` is the penalty per row of the plain objective, |r|^2 / (2 n) + regParam |w|^2 / 2.

    Spark's solver scales the label to unit deviation and with it the penalty by 1 / deviation; this undoes it."""

    def _fit(self, dataset):
        sd = dataset.agg(F.stddev_pop(q(self.getLabelCol()).cast("double"))).collect()[0][0]
        own = self.copy({self.regParam: self.getRegParam() * sd} if sd else {})
        return super(Ridge, own)._fit(dataset)


def classification_models(n_rows: int, n_classes: int, rounds: int = GBT_ROUNDS, forest_depth: int = FOREST_DEPTH):
    """The benchmark's classifiers; ``rounds`` of boosting and the depth to which forests grow are parameters."""
    return {
        "LogisticRegression": LogisticRegression(regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, maxIter=1000,
                                                 standardization=False),
        "RandomForest": Forest(task="classification", trees=FOREST_TREES, max_depth=forest_depth, seed=SEED),
        "GradientBoosting": LeafBoosting(task="classification", rounds=rounds, max_depth=GBT_DEPTH, seed=SEED),
        "SVM": KernelMachine(task="classification"),
    }


def regression_models(n_rows: int, rounds: int = GBT_ROUNDS, forest_depth: int = FOREST_DEPTH):
    """The benchmark's regressors; parameters as in ``classification_models``."""
    return {
        "Ridge": Ridge(regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False),
        "RandomForest": Forest(task="regression", trees=FOREST_TREES, max_depth=forest_depth, seed=SEED),
        "GradientBoosting": LeafBoosting(task="regression", rounds=rounds, max_depth=GBT_DEPTH, seed=SEED),
        "SVR": KernelMachine(task="regression"),
    }


def fit_cached(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """Iterative estimators re-read their input every iteration: keep it persisted for the fit."""
    from pyspark import StorageLevel
    t = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pipeline.fit(t)
    finally:
        t.unpersist()


def build_pipeline(estimator, features, label: str, task: str) -> Pipeline:
    return Pipeline(stages=[*_stages(features, label, task), _aimed(estimator, label, task)])


def primary_metric(task: str, n_classes: int | None = None) -> str:
    if task == "classification":
        return "AUC-ROC" if n_classes == 2 else "F1 (macro)"
    return "RMSE"


def lower_is_better(metric: str) -> bool:
    return metric in {"RMSE", "MAE"}


def score_predictions(pred: DataFrame, label: str, metric: str) -> float:
    """Primary metric of a scored fold: exact AUC (no curve down-sampling), macro-F1, or RMSE."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
    if metric == "RMSE":
        return RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="rmse").evaluate(pred)
    if metric == "AUC-ROC":
        return BinaryClassificationEvaluator(labelCol="_label", rawPredictionCol="rawPrediction",
                                             metricName="areaUnderROC", numBins=0).evaluate(pred)
    return M.macro_f1(pred, "_label", "prediction")


def _stages(features, label: str, task: str) -> list:
    """What comes before the estimator: features in one vector, classes numbered by their sorted text."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")]
    if task == "classification":
        stages.insert(0, StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"))
    return stages


def _aimed(estimator, label: str, task: str):
    """A copy of the estimator on the columns of ``_stages``."""
    return estimator.copy().setLabelCol("_label" if task == "classification" else label).setFeaturesCol("features")


def _folds(df: DataFrame, features, label: str, task: str, order_by, is_ts: bool, k: int):
    """(preparation, rows, [(train, test) per fold]): rows are assembled once, kept in one persisted frame of the
    vector, the label and the fold, and every model and fold filters that frame."""
    from pyspark import StorageLevel
    data = df.filter(q(label).isNotNull())
    if is_ts:
        data, start, size = ts_split(data, order_by, k)
        names = ["idx", "test_split"]
        conds = [(F.col("idx") < start + i * size, F.col("test_split") == i) for i in range(k)]
    else:
        data = kfold_assign(data, order_by, label if task == "classification" else None, k)
        names = ["fold"]
        conds = [(F.col("fold") != i, F.col("fold") == i) for i in range(k)]
    prep = Pipeline(stages=_stages(features, label, task)).fit(data)
    y = ["_label"] if task == "classification" else []
    data = data.checkpoint()
    rows = dealt(prep.transform(data).select("features", q(label), *y, *names), data.count()).persist(StorageLevel.MEMORY_AND_DISK)
    return prep, rows, [(rows.filter(a), rows.filter(b)) for a, b in conds]


def _cv_fold(est, tr, te, label, task, metric):
    return score_predictions(_aimed(est, label, task).fit(tr).transform(te), label, metric)


def benchmark_models(df: DataFrame, features, label: str, task: str, order_by, is_ts: bool = False,
                     k: int = CV_FOLDS, parallelism: int = 8, models: dict | None = None):
    """k-fold CV mean / std (ddof 0) of the primary metric per model; failed models are
    reported with their error and left out of the ranking; best first (RMSE ascending).
    Returns (leaderboard DataFrame, {name: model refit on all rows}, metric)."""
    spark = df.sparkSession
    prep, data, splits = _folds(df, features, label, task, order_by, is_ts, k)
    n = data.count()
    n_classes = data.select(label).distinct().count() if task == "classification" else None
    metric = primary_metric(task, n_classes)
    models = models or (classification_models(n, n_classes) if task == "classification" else regression_models(n))
    jobs = [(name, i, est, tr, te) for name, est in models.items() for i, (tr, te) in enumerate(splits)]

    def run(job):
        name, i, est, tr, te = job
        try:
            return name, i, _cv_fold(est, tr, te, label, task, metric), None
        except Exception as e:  # noqa: BLE001 - a failing model is reported, not fatal
            return name, i, None, str(e)[:200]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        results = list(pool.map(run, jobs))
    rows, ok = [], []
    for name, est in models.items():
        sc = [r[2] for r in results if r[0] == name and r[2] is not None]
        err = next((r[3] for r in results if r[0] == name and r[3]), None)
        if err or len(sc) < k:
            rows.append((name, metric, None, None, err))
            continue
        rows.append((name, metric, round(float(np.mean(sc)), 4), round(float(np.std(sc)), 4), None))
        ok.append((name, est))

    def refit(item):
        name, est = item
        return name, PipelineModel([*prep.stages, _aimed(est, label, task).fit(data)])
    # refits on all rows are independent Spark jobs too: run them concurrently
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        fitted = dict(pool.map(refit, ok))
    data.unpersist()
    lb = spark.createDataFrame(rows, "model string, metric string, score double, std double, error string")
    lb = lb.filter(F.col("score").isNotNull()).orderBy(F.col("score").asc() if lower_is_better(metric)
                                                       else F.col("score").desc(), "model")
    return lb, fitted, metric


# ------------------------------------------------------------------ tuning

def search_space(model_name: str) -> dict[str, Param]:
    """The tuning ranges of a model. ``C`` and ``alpha`` are penalties per data set, not per row."""
    spaces = {
        "RandomForest": {"trees": Param(50, 500, whole=True), "max_depth": Param(2, 20, whole=True),
                         "min_split": Param(2, 20, whole=True), "min_rows": Param(1, 10, whole=True)},
        "GradientBoosting": {"rounds": Param(50, 500, whole=True), "max_depth": Param(2, 10, whole=True),
                             "learning_rate": Param(1e-3, 0.3, log=True), "subsample": Param(0.5, 1.0),
                             "colsample": Param(0.5, 1.0), "reg_lambda": Param(1e-3, 10.0, log=True),
                             "num_leaves": Param(20, 300, whole=True)},
        "LogisticRegression": {"C": Param(1e-4, 100.0, log=True)},
        "Ridge": {"alpha": Param(1e-4, 100.0, log=True)},
        "SVM": {"C": Param(1e-2, 100.0, log=True)},
        "SVR": {"C": Param(1e-2, 100.0, log=True), "epsilon": Param(1e-3, 1.0, log=True)},
    }
    if model_name not in spaces:
        raise ValueError(f"no search space for {model_name}")
    return spaces[model_name]


def with_params(estimator, params: dict, n_rows: int):
    """A copy of the estimator with the drawn parameters."""
    own = {}
    for name, v in params.items():
        if name == "C" and not estimator.hasParam("C"):
            own["regParam"] = 1.0 / (v * n_rows)
        elif name == "alpha":
            own["regParam"] = v / n_rows
        else:
            own[name] = v
    return estimator.copy({estimator.getParam(k): v for k, v in own.items()})


def hyperparam_search(df: DataFrame, features, label: str, task: str, model_name: str, order_by,
                      n_trials: int = N_TRIALS, is_ts: bool = False, seed: int = SEED, parallelism: int = 8,
                      k: int = CV_FOLDS):
    """Tree-structured Parzen search: batches of ``parallelism`` proposals, each scored by k-fold CV on folds
    computed once, their fits run as concurrent Spark jobs. Returns (trials DataFrame, best params, baseline
    score, best score, model refit on all rows); a failed trial has no score and its error's text."""
    spark = df.sparkSession
    prep, data, splits = _folds(df, features, label, task, order_by, is_ts, k)
    n = data.count()
    n_classes = data.select(label).distinct().count() if task == "classification" else None
    metric = primary_metric(task, n_classes)
    base = (classification_models(n, n_classes) if task == "classification" else regression_models(n))[model_name]

    def cv(params):
        try:
            est = with_params(base, params, n)
            return float(np.mean([_cv_fold(est, tr, te, label, task, metric) for tr, te in splits])), None
        except Exception as e:  # noqa: BLE001 - a failing trial is reported, not fatal
            return None, str(e)[:200]
    search = Search(search_space(model_name), seed, lower_is_better(metric))
    errors = []
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        first = pool.submit(cv, {})
        while len(search.trials) < n_trials:
            batch = [search.ask() for _ in range(min(parallelism, n_trials - len(search.trials)))]
            for (number, _), (score, error) in zip(batch, pool.map(cv, [p for _, p in batch])):
                search.tell(number, score)
                errors.append(error)
        baseline = first.result()[0]
    rows = [(i, json.dumps(p, sort_keys=True), s, e) for i, (p, s, e) in enumerate(zip(search.trials, search.scores, errors))]
    trials = spark.createDataFrame(rows, "trial int, params string, score double, error string")
    best_s, best_p = search.best()
    model = PipelineModel([*prep.stages, _aimed(with_params(base, best_p, n), label, task).fit(data)])
    data.unpersist()
    return trials, best_p, baseline, best_s, model


# ------------------------------------------------------------------ importance / evaluation

def feature_importance(model: PipelineModel, names, top: int | None = None) -> DataFrame | None:
    """Tree importances, else |coefficients| (first class row), sorted desc: all, or the first ``top``."""
    from pyspark.sql import SparkSession
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        vals = np.abs(last.coefficientMatrix.toArray()[0])
    elif hasattr(last, "coefficients"):
        vals = np.abs(last.coefficients.toArray())
    else:
        return None
    names = list(names)
    if len(vals) != len(names):
        names = [f"f{i}" for i in range(len(vals))]
    rows = sorted(zip(names, map(float, vals)), key=lambda t: (-t[1], t[0]))[:top]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, importance double")


def evaluate_model(df: DataFrame, features, label: str, task: str, order_by, model_name: str,
                   is_ts: bool = False, id_col: str | None = None):
    """Split 80/20 -> refit on train -> metrics on test. Returns a dict of DataFrames."""
    data = df.filter(q(label).isNotNull())
    n = data.count()
    split = train_test_split(data, order_by, 0.2, label=label if task == "classification" else None,
                             positional=is_ts, id_col=id_col).checkpoint()
    train, test = split.filter("is_train"), split.filter(~F.col("is_train"))
    n_classes = data.select(label).distinct().count() if task == "classification" else None
    est = (classification_models(n, n_classes) if task == "classification" else regression_models(n))[model_name]
    model = fit_cached(build_pipeline(est, features, label, task), train)
    pred = model.transform(test)
    out = {}
    if task == "classification":
        pred = pred.withColumn("_pred_label", F.element_at(
            F.array(*[F.lit(v) for v in model.stages[0].labels]), F.col("prediction").cast("int") + 1))
        out["confusion_matrix"] = M.confusion_matrix(pred, label, "_pred_label")
        out["classification_report"] = M.classification_report(pred, label, "_pred_label")
        if n_classes == 2:
            s = pred.withColumn("_score", vector_to_array("rawPrediction")[1])
            out["roc_curve"] = M.roc_curve(s, "_label", "_score", positive=1.0)
            out["roc_auc"] = M.roc_auc(s, "_label", "_score", positive=1.0, digits=4)
    else:
        out["metrics"] = M.regression_metrics(pred, label, "prediction")
        out["residuals"] = M.residuals(pred, label, "prediction")
    imp = feature_importance(model, features)
    if imp is not None:
        out["feature_importance"] = imp
    out["model"] = model
    return out
